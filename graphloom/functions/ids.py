"""Stable identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(kind: Column | str, value: Column) -> Column:
    """``kind:`` and the first 8 bytes of SHA-1 over kind, NUL, value."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(":"), F.substring(F.sha1(F.concat(kind, F.lit("\0"), value).cast("binary")), 1, 16))


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat_ws("|", source, kind, target)


def evidence_id(edge: Column, location: Column, label: Column) -> Column:
    return stable_id("evidence", F.concat_ws("\0", edge, F.coalesce(location, F.lit("")), F.coalesce(label, F.lit(""))))


def short_sha256(value: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(value.cast("binary"), 256), 1, digits)


def repository_id(path: Column) -> Column:
    return short_sha256(path)


def author_key(email: Column) -> Column:
    return short_sha256(F.lower(F.trim(email)))


def map_fingerprint(shape: Column) -> Column:
    """SHA-256 over the sorted ``key=value`` lines of a map."""
    lines = F.array_sort(F.transform(F.map_entries(shape), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("\n"))))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)


def review_id(repository: Column, base: Column, head: Column) -> Column:
    return short_sha256(F.concat_ws("\0", repository, base, head), 24)


def encode_component(text: Column) -> Column:
    """Percent encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def frontier_id(direction: Column, parent: Column, category: Column) -> Column:
    return F.concat_ws(":", direction, encode_component(parent), category)
