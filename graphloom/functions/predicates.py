"""Filters and small projections over paths, files and symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_file(location: Column) -> Column:
    """Path of ``path:line``: what stands before the last colon."""
    return F.when(location.contains(":"), F.regexp_extract(location, r"^(.*):[^:]*$", 1)).otherwise(location)


def source_line(location: Column) -> Column:
    """Line of ``path:line``, null if it is not a number."""
    return F.nullif(F.regexp_extract(location, r":(\d+)$", 1), F.lit("")).cast("int")


def subsystem(path: Column) -> Column:
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.when(clean.contains("/"), F.split_part(clean, F.lit("/"), F.lit(1))).otherwise("root")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def display_value(raw: Column, unit: str) -> Column:
    if unit == "normalized":
        return F.format_string("%.2f", raw)
    return F.when(F.abs(raw - F.round(raw)) < 0.005, F.format_string(f"%.0f {unit}", raw)).otherwise(F.format_string(f"%.1f {unit}", raw))


# Files that tell nothing about a change.
PLAIN_NAMES = ["license", "license.md", "copying", "go.sum", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"]
ROUTE_NAMES = ["r", "e", "router", "routes", "route", "mux", "engine", "group", "echo", "app", "api", "server"]


def is_generated(path: Column) -> Column:
    """Vendored folders and generated sources."""
    p = F.lower(F.concat(F.lit("/"), path))
    return p.rlike(r"/(?:vendor|node_modules|dist)/") | p.rlike(r"(?:\.generated\.go|_generated\.go|\.pb\.go)$")


def is_plain(path: Column) -> Column:
    """Documents and lock files, which are no meaningful change."""
    low = F.lower(path)
    return low.rlike(r"\.(?:md|txt|lock)$") | base_name(low).isin(PLAIN_NAMES)


def architecture_bearing(path: Column) -> Column:
    p = F.lower(F.concat(F.lit("/"), path))
    return p.rlike(r"\.(?:proto|sql)$") | p.rlike(r"/openapi|/swagger|/schema/|/migrations/")


def symbol_matches(query: str, show_private: bool = False) -> Column:
    """Over label, file and exported; a missing flag is kept."""
    text = F.lower(F.concat_ws(" ", "label", F.coalesce("file", F.lit(""))))
    found = text.contains(query.strip().lower())
    return found if show_private else found & ~F.col("exported").eqNullSafe(F.lit(False))


def route_receiver(name: Column) -> Column:
    """The last part of a dotted receiver is, or speaks of, a router."""
    last = F.regexp_extract(F.lower(name), r"([^.]*)$", 1)
    return last.isin(ROUTE_NAMES) | last.rlike("route|mux")


def relationship_override(defaults: list[str], include: list[str], exclude: list[str]) -> Column:
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.array_sort(F.array_except(F.array_union(array(defaults), array(include)), array(exclude)))
