"""Leaves of JSON documents by JSON pointer, with variants; no Python reads the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def number_text(d: Column) -> Column:
    """The shortest decimal form of a double, as %g: with an exponent of two digits or more below 1e-4 and from 1e6 on."""
    java, size = d.cast("string"), F.abs(d)  # digits, a point, and an exponent below 1e-3 and from 1e7 on
    short = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    told = java.contains("E")
    power = F.when(told, F.regexp_extract(java, r"E(-?\d+)$", 1).cast("int")).otherwise(6)
    mantissa = F.when(told, F.regexp_extract(java, r"^(-?[\d.]+)E", 1)).otherwise(F.regexp_replace(F.replace(java, F.lit(".")), r"^(-?\d)", "$1."))
    digits = F.abs(power).cast("string")
    far = F.concat(short(mantissa), F.when(power < 0, "e-").otherwise("e+"), F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0")))
    return F.when(d == 0, "0").when((size >= 1e-4) & (size < 1e6), short(java.cast("decimal(38,22)").cast("string"))).otherwise(far)


def _leaf(value: str) -> Column:
    kind = F.schema_of_variant(value)
    get = lambda type_: F.try_variant_get(value, "$", type_)
    text = F.concat(F.lit("string:"), get("string"))
    return F.when(F.is_variant_null(value), "null").when(kind == "STRING", text).when(kind == "BOOLEAN", F.concat(F.lit("bool:"), get("boolean").cast("string"))).otherwise(F.concat(F.lit("number:"), number_text(get("double"))))


def flatten_json(documents: DataFrame, content: str = "content") -> DataFrame:
    """The other columns, path and value of each leaf of JSON texts; a text that is no JSON is an error, a null one has no leaves.

    Values tell their type: null, string:, bool: and number:, the number as a double.
    Empty objects and arrays have no leaves. ``~`` and ``/`` of a key are ~0 and ~1. Levels
    are taken one by one, so there are as many rounds as a document is deep; nothing is
    shuffled, and a round holds the rows that have inner ones only.
    """
    names = [c for c in documents.columns if c != content]
    inner = [f"c{k}" for k in range(len(names))]  # so that no name of the caller's meets another
    rows = documents.select(*(F.col(f"`{n}`").alias(i) for n, i in zip(names, inner, strict=True)), F.lit("/").alias("path"), F.parse_json(F.col(content)).alias("value")).where("value is not null")
    leaves = None
    spark = documents.sparkSession
    while True:
        nested = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
        told = rows.where(~nested).select(*inner, "path", _leaf("value").alias("value"))
        leaves = told if leaves is None else leaves.unionByName(told)
        part = "replace(replace(coalesce(e.key, cast(e.pos as string)), '~', '~0'), '/', '~1')"
        deep = rows.where(nested)
        grown = spark.sql(f"SELECT {''.join(f'd.{i}, ' for i in inner)}concat(if(d.path = '/', '', d.path), '/', {part}) AS path, e.value AS value FROM {{deep}} AS d, LATERAL variant_explode(d.value) AS e", deep=deep)
        rows = materialize(grown, "leaves")
        if rows.isEmpty():
            return leaves.toDF(*names, "path", "value")
