"""Readers of text exports: coverage profiles, telemetry, owner rules, git logs, contracts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, predicates
from .flatten import flatten_json


def without_root(path: Column, root: str, module: str) -> Column:
    """A path without the repository's folder, its module or a leading ``./``."""
    out = F.regexp_replace(path, r"^\./", "")
    for prefix in (module, root):
        if prefix:
            out = F.when(path.startswith(prefix + "/"), F.substr(path, F.lit(len(prefix) + 2))).otherwise(out)
    return out


def read_coverage(spark: SparkSession, path: str, root: str = "", module: str = "") -> DataFrame:
    """(file, start_line, end_line, statements, hits) of a coverage profile; a line of another form is an error."""
    form = r"^(.+):(\d+)\.\d+,(\d+)\.\d+\s+(\d+)\s+(\d+)$"
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, 'mode:')")
    part = lambda k: F.regexp_extract("line", form, k)
    file = F.when(F.col("line").rlike(form), part(1)).otherwise(F.raise_error(F.concat(F.lit("invalid coverage profile line: "), "line")))
    return lines.select(without_root(file, root, module).alias("file"), *[part(k).cast("int").alias(n) for k, n in ((2, "start_line"), (3, "end_line"), (4, "statements"), (5, "hits"))])


_TELEMETRY = "nodeId string, label string, file string, rpm double, qps double, p50 double, p95 double, p99 double, errorRate double, window string, source string, note string"


def read_telemetry(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """Telemetry of known nodes, by id or by a label (and file) that names one node only.

    A rate of 0 counts as observed, an absent one does not. Items without source,
    window or any metric, and unknown or ambiguous labels, are errors.
    """
    items = spark.read.schema(_TELEMETRY).json(path, multiLine=True).withColumn("item", F.monotonically_increasing_id())
    known = nodes.select(F.col("id").alias("found"), F.col("label").alias("l"), predicates.source_file(F.col("file")).alias("f"))
    by_id = F.coalesce("nodeId", F.lit("")) != ""
    own = items.where(by_id).join(known, F.col("nodeId") == F.col("found"), "left")
    anywhere = F.col("file").isNull() | (F.col("file") == "")
    named = items.where(~by_id).join(known, (F.col("label") == F.col("l")) & (anywhere | (F.col("file") == F.col("f"))), "left")
    met = own.union(named)
    told = met.groupBy(*items.columns).agg(F.count("found").alias("n"), F.min("found").alias("node"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    metric = F.col("rpm").isNotNull() | F.col("qps").isNotNull() | F.greatest(*[F.coalesce(c, F.lit(0.0)) != 0 for c in ("p50", "p95", "p99", "errorRate")])
    name = F.coalesce("nodeId", "label", F.lit(""))
    fault = F.when(F.col("n") == 0, F.concat(F.lit("no node matches "), name)).when(F.col("n") > 1, F.concat(name, F.lit(" is ambiguous"))).when(blank("source") | blank("window"), "source and window are required").when(~metric, "at least one metric is required")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return told.select(F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("node")).alias("nodeId"), zero("rpm"), zero("qps"), (F.col("rpm").isNotNull() | F.col("qps").isNotNull()).alias("trafficObserved"), *[zero(c) for c in ("p50", "p95", "p99", "errorRate")], "window", "source", "note")


def owner_pattern(glob: str) -> str | None:
    """Regular expression of an owner rule's glob; null for empty and negated ones."""
    glob = glob.strip().replace("\\", "/")
    if not glob or glob[0] == "!":
        return None
    body = glob[1:] if glob.startswith("/") else glob
    fixed = glob.startswith("/") or "/" in body.rstrip("/")
    folder = body.endswith("/")
    last = body.rstrip("/").rsplit("/", 1)[-1]
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    inner = re.sub(r"\*\*/|\*\*|\*|\?|.", lambda m: parts.get(m[0]) or re.escape(m[0]), body + "**" * folder, flags=re.S)
    below = "" if folder or re.search(r"[*?]", last) else "(?:/.*)?"
    return f"{'^' if fixed else '(?:^|.*/)'}{inner}{below}$"


def owner_rules(spark: SparkSession, text: str) -> DataFrame:
    """(rule_no, pattern, owners) of an owners file, patterns anchored for ``rlike``."""
    rows = []
    for number, line in enumerate(text.splitlines()):
        fields = line.split()
        if len(fields) > 1 and not fields[0].startswith("#") and (pattern := owner_pattern(fields[0])):
            rows.append((number, f"^{pattern}" if not pattern.startswith("^") else pattern, fields[1:]))
    return spark.createDataFrame(rows, "rule_no int, pattern string, owners array<string>")


def _renamed(path: Column) -> tuple[Column, Column, Column]:
    """Old path, new path and whether it is a rename, of ``a/{old => new}/b`` or ``old => new``."""
    is_ = path.contains(" => ")
    brace = r"^([^{}]*)\{([^{}]*) => ([^{}]*)\}(.*)$"
    inner = path.rlike(brace)
    part = lambda k: F.regexp_extract(path, brace, k)
    old = F.when(inner, F.concat(part(1), part(2), part(4))).otherwise(F.regexp_extract(path, r"^(.*?) => ", 1))
    new = F.when(inner, F.concat(part(1), part(3), part(4))).otherwise(F.regexp_extract(path, r"^.*? => (.*)$", 1))
    return F.when(is_, old).otherwise(""), F.when(is_, new).otherwise(path), is_


#: Of the files of a commit, this many at least and this share renamed make it a refactoring.
NOISE_FILES, NOISE_SHARE = 20, 0.8


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Change events of ``git log --numstat`` exports whose header lines are
    ``commit:hash TAB time TAB email TAB parents TAB subject``.

    Files are cut at the headers, so a log of any length is read in parallel.
    Binary changes are left out; a header of another form is an error.
    """
    blocks = spark.read.option("lineSep", "\ncommit:").text(path).select(F.regexp_replace("value", "^commit:", "").alias("value")).where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    head = F.split(lines[0], "\t", 5)
    ok = F.size(head) >= 4
    field = lambda k: F.when(ok, head[k]).otherwise(F.raise_error(F.lit("invalid Git history header")))
    numbers = F.filter(F.slice(lines, 2, 1_000_000_000), lambda x: x.rlike(r"^\d+\t\d+\t."))

    def change(line: Column) -> Column:
        cut = F.split(line, "\t", 3)
        old, new, renamed = _renamed(cut[2])
        made = predicates.is_generated(new)
        return F.struct(new.alias("path"), old.alias("oldPath"), cut[0].cast("int").alias("additions"), cut[1].cast("int").alias("deletions"), made.alias("generated"), renamed.alias("rename"), (made | predicates.is_plain(new)).alias("excluded"))

    rows = blocks.select(field(0).alias("commit"), F.to_timestamp(field(1)).alias("occurredAt"), ids.author_key(field(2)).alias("authorKey"), F.filter(F.split(field(3), " "), lambda p: p != "").alias("parents"), F.get(head, F.lit(4)).alias("summary"), F.transform(numbers, change).alias("files"))
    renames = F.size(F.filter("files", lambda f: f["rename"]))
    noise = (F.size("files") >= NOISE_FILES) & (renames >= NOISE_SHARE * F.size("files"))
    return rows.select(F.concat(F.lit("git:"), "commit").alias("id"), "*", noise.alias("refactorNoise"))


def event_files(events: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Files of events, in the columns that velocity takes; units: path, unit of a file."""
    rows = events.select("id", F.col("occurredAt").alias("occurred_at"), F.col("authorKey").alias("author"), F.col("refactorNoise").alias("noise"), F.explode("files").alias("f"))
    flat = rows.select("id", "occurred_at", "author", "noise", "f.path", "f.rename", (F.col("f.additions") + F.col("f.deletions")).cast("long").alias("lines"))
    return flat if units is None else flat.join(units, "path")


def contract_type(name: str) -> str | None:
    """openapi, kafka or grpc by a file's name; null if it is no contract."""
    low = name.lower()
    if low.endswith(".proto"):
        return "grpc"
    if low.rsplit(".", 1)[-1] in ("yaml", "yml", "json"):
        return "kafka" if "asyncapi" in low else "openapi" if re.search("openapi|swagger", low) else None
    return None


def contract_kind(name: Column) -> Column:
    """As ``contract_type``, of a column."""
    low = F.lower(name)
    text = low.rlike(r"\.(yaml|yml|json)$")
    return F.when(low.endswith(".proto"), "grpc").when(text & low.contains("asyncapi"), "kafka").when(text & low.rlike("openapi|swagger"), "openapi")


def _number(x: float) -> str:
    """Shortest decimal form, with an exponent as for %g: below 1e-4 and from 1e6 on."""
    text = repr(float(x))
    mantissa, _, exponent = text.partition("e")
    digits = mantissa.lstrip("-").replace(".", "").strip("0") or "0"
    power = int(exponent or 0) + (len(mantissa.lstrip("-").split(".")[0]) - 1 if not mantissa.lstrip("-").startswith("0.") else -(len(mantissa.lstrip("-")[2:]) - len(mantissa.lstrip("-")[2:].lstrip("0")) + 1))
    if x and not -4 <= power < 6:
        sign = "-" if x < 0 else ""
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if power < 0 else '+'}{abs(power):02d}"
    whole = format(x, "f") if exponent else text
    return whole.rstrip("0").rstrip(".") if "." in whole else whole


def flatten(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """JSON pointers of a document's leaves and their typed values."""
    if isinstance(value, dict | list):
        items = sorted((str(k), v) for k, v in value.items()) if isinstance(value, dict) else ((str(k), v) for k, v in enumerate(value))
        for key, inner in items:
            yield from flatten(inner, f"{path}/{key.replace('~', '~0').replace('/', '~1')}")
        return
    kinds = ((bool, lambda v: f"bool:{str(v).lower()}"), (int, lambda v: f"number:{v}"), (float, lambda v: f"number:{_number(v)}"), (str, lambda v: f"string:{v}"))
    yield path or "/", "null" if value is None else next((show(value) for kind, show in kinds if isinstance(value, kind)), f"{type(value).__name__}:{value}")


def contract_shape(name: str, content: str) -> list[tuple[str, str]]:
    if name.lower().endswith(".proto"):
        document: object = [x for x in (line.split("//", 1)[0].strip() for line in content.split("\n")) if x]
    else:
        import yaml

        document = yaml.safe_load(content)
    return list(flatten(document))


def contract_fields(files: DataFrame) -> DataFrame:
    """(contract, name, type, path, value) of the leaves of contract files, from (path, content); broken files are errors.

    JSON is read as variants; YAML and protocol files by a small reader in Python.
    """
    kind = contract_kind(F.regexp_extract("path", "[^/]*$", 0))
    told = files.select(F.col("path").alias("name"), kind.alias("type"), "content").where("type is not null")
    json_ = F.lower("name").endswith(".json")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, type_, p, v) for name, type_, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for p, v in contract_shape(name, content)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["name", "type", "path", "value"])

    leaves = told.where(~json_).mapInArrow(read, "name string, type string, path string, value string").unionByName(flatten_json(told.where(json_)))
    return leaves.select(ids.stable_id("contract", F.col("name")).alias("contract"), "name", "type", "path", "value")


def contracts(fields: DataFrame) -> DataFrame:
    """One row per contract with its shape as a map and a fingerprint."""
    rows = fields.groupBy("contract", "name", "type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("shape"))
    return rows.select(F.col("contract").alias("id"), "name", "type", F.col("contract").alias("node"), F.col("name").alias("path"), ids.map_fingerprint(F.col("shape")).alias("fingerprint"), "shape")
