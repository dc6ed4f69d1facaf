"""Registered queries of operators that the derived graph does not reach: readers, stores, outcomes, reasons.

Their inputs are written to scratch files and read back, or derived from the
tables; where the expected rows can only be stated, the SQL states them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import investigation
from ..operators import attention, dataflow, facts, graph, overlays, projection, review
from ..sources import repository, store, text
from . import catalog
from .catalog import query
from .derived import Derived
from .scratch import materialize, scratch_path


def _values(rows: list[tuple], names: str) -> str:
    """SELECT of stated rows."""
    tell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(tell, r)) + ')' for r in rows)}) stated({names})"


# Calls by their receivers, methods and literals

CALLS = [
    (1, "db", "Exec", ["INSERT INTO bookings (id) VALUES (1)"], False), (2, "db", "Query", ["select a from rooms join guests on x = y"], False), (3, "bus", "Publish", ["room.booked"], False),
    (4, "queue", "Receive", ["room.freed"], False), (5, "redis", "Get", ["room:1"], False), (6, "pageCache", "Set", ["page:1"], False), (7, "http", "Get", ["https://rates.example/v1"], True),
    (8, "client", "Post", ["https://user@pay.example/charge"], False), (9, "headers", "Set", ["https://nowhere.example"], False), (10, "queue", "Send", ["not a topic"], False), (11, "log", "Info", ["hello"], False),
]
CLASSES = [
    (1, "writes", "table", "bookings", "INSERT", "persistence"), (2, "reads", "table", "rooms", "SELECT", "persistence"), (2, "reads", "table", "guests", "SELECT", "persistence"), (3, "publishes", "topic", "room.booked", "Publish", "async"),
    (4, "consumes", "topic", "room.freed", "Receive", "async"), (5, "reads", "cache", "room:1", "Get", "persistence"), (6, "writes", "cache", "page:1", "Set", "persistence"), (7, "calls", "external", "rates.example", "GET", "network"),
    (8, "calls", "external", "pay.example", "POST", "network"),
]


@query(f"""classes AS ({_values(CLASSES, "id, kind, target_kind, target, label, boundary")})
SELECT s_suppkey AS id, kind, target_kind, replace(target, 'room', 'room' || s_nationkey) AS target, label, boundary FROM supplier JOIN classes ON s_suppkey % {len(CALLS)} + 1 = classes.id""")
def dataflow_calls(g: Derived) -> DataFrame:
    """Each supplier makes one of the calls, with names of its nation."""
    made = F.broadcast(g.spark.createDataFrame(CALLS, "call int, receiver string, method string, values array<string>, http boolean"))
    rows = g.table("supplier").join(made, F.col("s_suppkey") % len(CALLS) + 1 == F.col("call"))
    own = F.concat(F.lit("room"), F.col("s_nationkey").cast("string"))
    return dataflow.classify_calls(rows.select(F.col("s_suppkey").alias("id"), "receiver", "method", F.transform("values", lambda v: F.replace(v, F.lit("room"), own)).alias("values"), "http"))


# Units of endpoints; ends and roots


@query("""ends AS (SELECT DISTINCT 'endpoint:' || c_mktsegment || c_nationkey AS id, 'package:0' AS pkg FROM customer),
handled AS (SELECT 'endpoint:' || c_mktsegment || c_nationkey AS id, max('package:' || c_nationkey) AS unit FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT node, unit FROM units UNION ALL SELECT id, coalesce(unit, pkg) FROM ends LEFT JOIN handled USING (id)""")
def endpoint_units(g: Derived) -> DataFrame:
    id_ = F.concat(F.lit("endpoint:"), "c_mktsegment", "c_nationkey")
    ends = g.table("customer").select(id_.alias("id"), F.lit("endpoint").alias("kind"), F.lit("package:0").alias("pkg")).distinct()
    handlers = g.table("customer").where("c_acctbal > 0").select(id_.alias("source"), F.lit("calls").alias("kind"), F.concat(F.lit("fn:"), "c_custkey").alias("target"), F.lit("handler").alias("label"))
    return facts.endpoint_units(g.nodes.select("id", "kind", "pkg").union(ends), handlers)


@query("""marked AS (SELECT 'fn:' || c_custkey AS id FROM customer WHERE c_acctbal < 0), seen AS (SELECT source, target FROM edges WHERE kind = 'writes')
SELECT 'package:1' AS id UNION SELECT id FROM marked UNION SELECT source FROM seen UNION SELECT target FROM seen""")
def review_roots(g: Derived) -> DataFrame:
    nodes = g.table("customer").select(F.concat(F.lit("fn:"), "c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "modified").alias("pr"))
    edges = g.edges.select("source", "target", F.when(F.col("kind") == "writes", "added").alias("pr"))
    return projection.review_roots(g.spark.createDataFrame([("package:1",)], "id string"), nodes, edges)


@query("SELECT 'fn:' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'removed' ELSE 'added' END AS status, c_acctbal < 0 AS before, c_acctbal >= 0 AS after, 'legacy-change' AS reason FROM customer WHERE c_mktsegment <> 'BUILDING'")
def legacy_upgrade(g: Derived) -> DataFrame:
    pr = F.when(F.col("c_mktsegment") != "BUILDING", F.when(F.col("c_acctbal") < 0, "removed").otherwise("added"))
    return overlays.upgrade_legacy(g.table("customer").select(F.concat(F.lit("fn:"), "c_custkey").alias("id"), pr.alias("pr")))


@query("""SELECT id, sha256('{"kind":"package","label":"' || label || '"' || CASE WHEN owners IS NULL THEN '' ELSE ',"owners":[' || list_aggregate(list_sort([('"' || x || '"') FOR x IN owners]), 'string_agg', ',') || ']' END || ',"meta":"' || service || '"}') AS fingerprint FROM packages""")
def node_fingerprints(g: Derived) -> DataFrame:
    none = F.lit(None).cast("string")
    tags = F.array().cast("array<string>")
    return g.packages.select("id", overlays.node_fingerprint(F.lit("package"), F.col("label"), none, F.reverse("owners"), tags, F.col("service")).alias("fingerprint"))


@query("""weighted AS (SELECT u, v, count(*) AS w FROM unit_edges GROUP BY u, v),
walks AS (SELECT id AS s, id AS t, 0 AS hop FROM packages UNION SELECT w.s, d.v, w.hop + 1 FROM walks w JOIN deps d ON w.t = d.u WHERE w.hop < 25),
dist AS (SELECT s, t, min(hop) AS d FROM walks GROUP BY s, t),
spaths AS (SELECT id AS s, id AS t, 0 AS hop, 1.0::DOUBLE AS w FROM packages
  UNION ALL SELECT p.s, e.v, p.hop + 1, p.w * e.w FROM spaths p JOIN weighted e ON p.t = e.u JOIN dist x ON x.s = p.s AND x.t = e.v AND x.d = p.hop + 1),
sigma AS (SELECT s, t, hop AS d, sum(w) AS n FROM spaths GROUP BY s, t, hop),
betw AS (SELECT a.t AS id, sum(a.n * b.n / c.n) AS raw FROM sigma a JOIN sigma b ON a.t = b.s JOIN sigma c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d
  WHERE a.s <> a.t AND b.s <> b.t AND a.s <> b.t GROUP BY a.t)
SELECT p.id, round(coalesce(CASE WHEN (SELECT max(raw) FROM betw) > 0 THEN raw / (SELECT max(raw) FROM betw) END, 0.0), 6) AS score FROM packages p LEFT JOIN betw USING (id)""")
def betweenness_multiple(g: Derived) -> DataFrame:
    """The variant that counts parallel edges and takes the first sources by id."""
    return graph.betweenness(catalog._deps(g), g.packages, spaced=False, multiple=True).withColumn("score", F.round("score", 6))


# Rules of a repository


@query(catalog._FANS.rstrip() + ",\n" + catalog._TESTED.rstrip() + ",\n" + catalog._SCC.rstrip() + """,
found AS (SELECT 'cycle' AS rule, component AS node, string_agg(node, ',' ORDER BY node) AS detail FROM scc GROUP BY component
  UNION ALL SELECT 'fan-out', id, fan_out::VARCHAR FROM fans WHERE fan_out > 12
  UNION ALL SELECT 'untested-export', id, '' FROM nodes WHERE exported AND kind IN ('function', 'method') AND id NOT IN (SELECT node FROM tested WHERE node <> test)
  UNION ALL SELECT 'cyclomatic', id, cyclomatic::VARCHAR FROM nodes WHERE kind IN ('function', 'method') AND cyclomatic > 15
  UNION ALL SELECT 'no-owners-file', id, '' FROM nodes WHERE kind = 'service')
SELECT rule, node, detail FROM found""")
def rule_violations(g: Derived) -> DataFrame:
    calls = materialize(g.calls.where("kind in ('calls', 'tests')").select("source", "kind", "target"))  # no rule reads other kinds or ids
    deps = facts.unit_pairs(calls, facts.unit_of(g.nodes)).select(F.col("u").alias("source"), F.lit("depends_on").alias("kind"), F.col("v").alias("target"))
    edges = calls.union(materialize(deps))
    return repository.violations(g.nodes.withColumn("external", F.lit(False)), edges, "")


# Text exports, written to scratch files and read back


def _written(g: Derived, lines: DataFrame, name: str) -> str:
    path = scratch_path(g.spark, name)
    lines.write.text(path)
    return path


@query("SELECT 'pkg/f' || (l_partkey % 200) || '.go' AS file, (l_orderkey % 400)::INT AS start_line, (l_orderkey % 400 + l_linenumber)::INT AS end_line, l_quantity::INT AS statements, l_linenumber::INT - 1 AS hits FROM lineitem")
def coverage_profile(g: Derived) -> DataFrame:
    row = F.col("l_orderkey") % 400
    line = F.concat(F.lit("example.org/inn/pkg/f"), F.col("l_partkey") % 200, F.lit(".go:"), row, F.lit(".1,"), row + F.col("l_linenumber"), F.lit(".9 "), F.col("l_quantity").cast("int"), F.lit(" "), F.col("l_linenumber") - 1)
    head = g.spark.createDataFrame([("mode: count",), ("",)], "value string")
    return text.read_coverage(g.spark, _written(g, g.table("lineitem").select(line.alias("value")).union(head), "coverage"), "", "example.org/inn")


@query("""SELECT 'git:' || event_id AS id, CAST(event_id AS VARCHAR) AS commit, 'src/u' || user_id || CASE event_type WHEN 'view' THEN '.pb.go' WHEN 'error' THEN '.md' ELSE '.go' END AS path, floor(value)::INT AS additions, 1 AS deletions,
  event_type = 'view' AS generated, event_type IN ('view', 'error') AS excluded, 'p' || (event_id % 3) AS parents FROM events""")
def git_log(g: Derived) -> DataFrame:
    e = F.col
    path = F.concat(F.lit("src/u"), "user_id", F.when(e("event_type") == "view", ".pb.go").when(e("event_type") == "error", ".md").otherwise(".go"))
    # an own separator, so that each event is a block of lines whatever the file it lies in
    head = F.concat_ws("\t", F.concat(F.lit("commit:"), "event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.concat(F.lit("user"), "user_id", F.lit("@example.org")), F.concat(F.lit("p"), e("event_id") % 3))
    block = F.concat(head, F.lit("\n\n"), F.floor("value").cast("int"), F.lit("\t1\t"), path, F.lit("\n-\t-\tlogo.png"))
    found = text.read_git_log(g.spark, _written(g, g.table("events").select(block.alias("value")), "log"))
    return found.select("id", "commit", F.explode("files").alias("f"), "parents").select("id", "commit", "f.path", "f.additions", "f.deletions", "f.generated", "f.excluded", F.array_join("parents", " ").alias("parents"))


@query("SELECT 'method:' || s_suppkey AS node, round(s_acctbal, 2) AS rpm, s_acctbal > 0 AS observed, '5m' AS \"window\" FROM supplier")
def telemetry_export(g: Derived) -> DataFrame:
    seen = F.col("s_acctbal") > 0
    item = F.to_json(F.struct(F.concat(F.lit("method:"), "s_suppkey").alias("nodeId"), F.when(seen, F.round("s_acctbal", 2)).alias("rpm"), F.when(~seen, F.lit(12.5)).alias("p95"), F.lit("5m").alias("window"), F.lit("export").alias("source")))
    items = g.table("supplier").select(item.alias("value"))
    found = text.read_telemetry(g.spark, _written_array(g, items), g.nodes)
    balance = g.table("supplier").select(F.concat(F.lit("method:"), "s_suppkey").alias("nodeId"), F.round("s_acctbal", 2).alias("balance"))
    return found.join(balance, "nodeId").select(F.col("nodeId").alias("node"), F.when(F.col("trafficObserved"), F.col("rpm")).otherwise(F.col("balance")).alias("rpm"), F.col("trafficObserved").alias("observed"), "window")


def _written_array(g: Derived, items: DataFrame) -> str:
    """Items as JSON arrays, one a file."""
    part = F.spark_partition_id()
    rows = items.groupBy(part.alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    path = scratch_path(g.spark, "telemetry")
    rows.select("value").repartition(1).write.option("maxRecordsPerFile", 1).text(path)
    return path


# Snapshots: the nations of a region are the nodes of its repository.

_STORE = """regions AS (SELECT r_regionkey AS k, 'inn' || r_regionkey AS repository FROM region), there AS (SELECT 'inn' || n_regionkey AS repository, 'package:' || n_nationkey AS id, n_nationkey % 2 = 0 AS even FROM nation),
ids AS (SELECT k * 4 + 1 AS a, k * 4 + 2 AS b, k * 4 + 3 AS h, k * 4 + 4 AS d, repository FROM regions)
"""


@query(_STORE + """SELECT 'current' AS what, d AS snapshot, repository AS name FROM ids UNION ALL SELECT 'review', b, repository || ':r' FROM ids UNION ALL SELECT 'review', h, repository || ':r' FROM ids
UNION ALL SELECT 'kept', unnest([b, h, d]), repository FROM ids UNION ALL SELECT 'node', d, id FROM there JOIN ids USING (repository) UNION ALL SELECT 'next', (SELECT max(d) + 1 FROM ids), 'inn0'
UNION ALL SELECT 'delta', b, id FROM there JOIN ids USING (repository) WHERE NOT even""")
def snapshot_store(g: Derived) -> DataFrame:
    """For each region an index, a review of two snapshots and another index, then a compaction and a snapshot after it."""
    kept, ids = store.Store(g.spark, scratch_path(g.spark, "store")), []
    rows = materialize(g.table("nation").select(F.concat(F.lit("inn"), "n_regionkey").alias("repository"), F.concat(F.lit("package:"), "n_nationkey").alias("id"), F.lit("package").alias("kind"), F.col("n_name").alias("label"), (F.col("n_nationkey") % 2 == 0).alias("even")))
    names = [r["r"] for r in g.table("region").select(F.concat(F.lit("inn"), "r_regionkey").alias("r")).orderBy("r").collect()]  # a repository each
    for name in names:
        nodes = rows.where(F.col("repository") == name).select("id", "kind", "label", "even")
        kept.register(name, "The Inn")
        first = kept.save(name, "index", "c0", nodes=nodes.where("even"))
        delta = nodes.where("not even").select(F.lit("node").alias("what"), "id", F.lit("added").alias("status"), F.lit("entity-added").alias("reasons"))
        pair = kept.save_pair(name, f"{name}:r", ("c1", "c2"), {"nodes": nodes.where("even")}, {"nodes": nodes}, delta)
        ids.append((name, first, *pair, kept.save(name, "index", "c3", onto=first, nodes=nodes)))
    kept.compact(1)
    told = [("current", kept.current(name), name) for name in names]
    told += [("review", r[side], r["review"]) for r in kept.reviews().collect() for side in ("base", "head")]
    dropped = {first for _, first, *_ in ids}
    told += [("kept", r["snapshot_id"], r["repository_id"]) for r in kept.snapshots().collect() if r["snapshot_id"] not in dropped]
    told.append(("next", kept.save(names[0], "index", "c4", nodes=rows.select("id", "kind", "label")), names[0]))
    out = g.spark.createDataFrame(told, "what string, snapshot long, name string")
    for name, _, base, _, last in ids:
        out = out.union(kept.load("nodes", name, last).select(F.lit("node"), F.lit(last), "id")).union(kept.delta(f"{name}:r").select(F.lit("delta"), F.lit(base), "id"))
    return out


CUTS = ["2024-01-05", "2024-01-10", "2024-01-15", "2024-01-20", "2024-01-25", "2024-01-31"]
_CHAIN = f"""cuts AS (SELECT unnest(range(1, {len(CUTS) + 1})) AS snapshot, unnest({CUTS})::TIMESTAMP AS cut),
held AS (SELECT snapshot, 'user:' || user_id AS id, arg_max(event_type, event_id) AS kind, sum(value) AS total FROM events JOIN cuts ON ts < cut GROUP BY ALL)
"""


@query(_CHAIN + "SELECT 'row' AS what, snapshot, id, kind FROM held WHERE kind <> 'error' UNION ALL SELECT 'snapshot', snapshot, 'users', 'cut ' || left(cut::VARCHAR, 10) FROM cuts")
def snapshot_chain(g: Derived) -> DataFrame:
    """What users did last, day by day: the first snapshot is whole, each other one the difference from that before it."""
    kept = store.Store(g.spark, scratch_path(g.spark, "chain"))
    events, number, out = g.table("events"), None, None
    for cut in CUTS:
        seen = events.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")).groupBy(F.concat(F.lit("user:"), "user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("kind"))
        number = kept.save("users", "index", f"cut {cut}", onto=number, nodes=seen.where("kind <> 'error'"))
        rows = kept.load("nodes", "users", number).select(F.lit("row").alias("what"), F.lit(number).cast("long").alias("snapshot"), "id", "kind")
        out = rows if out is None else out.union(rows)
    line = kept.timeline("users")[0]
    return out.union(line.select(F.lit("snapshot"), "snapshot_id", "repository_id", "commit"))


# Attention beside the scores


@query("""refs AS (SELECT DISTINCT s.unit AS id, 'edge' AS kind, e.id AS ref FROM edges e JOIN units s ON e.source = s.node WHERE e.kind <> 'owns')
SELECT id, kind, ref FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY ref) AS rank FROM refs) WHERE rank <= 50""")
def evidence_cap(g: Derived) -> DataFrame:
    units = facts.unit_of(g.nodes).select(F.col("node").alias("source"), F.col("unit").alias("id"))
    members = g.edges.where("kind <> 'owns'").select("source", F.col("id").alias("ref")).join(units, "source")
    return attention.evidence_refs(members.select("id", F.lit("edge").alias("kind"), "ref"))


@query("SELECT 'customer:' || c_custkey AS id, round(c_acctbal / 100)::INT AS priority FROM customer ORDER BY priority DESC, id LIMIT 200")
def accessible_units(g: Derived) -> DataFrame:
    ranked = g.table("customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.round(F.col("c_acctbal") / 100).cast("int").alias("priority"))
    return attention.accessible(ranked)


@query("""bubbles AS (SELECT 'method:' || s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN sqrt((110 + 700 * (s_suppkey % 101) / 100) / pi()) ELSE 6.0 END AS radius FROM supplier)
SELECT id, round(radius, 6) AS radius FROM bubbles""")
def bubble_order(g: Derived) -> DataFrame:
    """The rows come in the order of painting, which the comparison of sets does not see; a test does."""
    units = g.table("supplier").select(F.concat(F.lit("method:"), "s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("s_suppkey") % 101).alias("velocity"))
    return attention.paint_order(units).withColumn("radius", F.round("radius", 6))


@query("""SELECT 'full' AS "case", true AS history_available, false AS history_shallow, 'business criticality|contract consumers|critical flows|runtime paths' AS signals, '' AS warnings
UNION ALL SELECT 'shallow', true, true, 'business criticality|contract consumers|critical flows|runtime paths', 'Git history is shallow; change velocity may be understated.'
UNION ALL SELECT 'bare', false, false, 'business criticality|contract consumers|critical flows|runtime paths|team ownership', 'Git history is unavailable; change velocity is unknown.'""")
def attention_completeness(g: Derived) -> DataFrame:
    told = lambda name, rows: rows.select(F.lit(name).alias("case"), "history_available", "history_shallow", F.array_join("optional_signals", "|").alias("signals"), F.array_join("warnings", "|").alias("warnings"))
    full, shallow, bare = attention.completeness(g.packages, True), attention.completeness(g.packages, True, True), attention.completeness(g.packages.where("owners is null"), False)
    return told("full", full).union(told("shallow", shallow)).union(told("bare", bare))


# Reviews


@query("""b AS (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0), h AS (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0),
told AS (SELECT 'method:' || s_suppkey AS id, 'architecture-violation' AS reason FROM h WHERE s_acctbal < 0 AND s_suppkey NOT IN (SELECT s_suppkey FROM b)
  UNION SELECT 'method:' || s_suppkey, 'architecture-violation-resolved' FROM b WHERE s_acctbal < 0 AND s_suppkey NOT IN (SELECT s_suppkey FROM h)
  UNION SELECT 'method:' || s_suppkey, 'runtime-changed' FROM supplier WHERE (s_suppkey % 5 <> 0) <> (s_suppkey % 4 <> 0)
  UNION SELECT 'method:' || s_suppkey, 'complexity-changed' FROM b WHERE s_suppkey % 4 <> 0 AND s_nationkey % 2 = 0
  UNION SELECT 'method:' || s_suppkey, 'test-protection-changed' FROM b WHERE s_suppkey % 4 <> 0 AND s_nationkey % 3 = 0
  UNION SELECT 'method:1', 'contract-changed')
SELECT id, status, reasons FROM (
  SELECT t.id, CASE WHEN t.id = 'method:2' THEN 'added' ELSE 'modified' END AS status, string_agg(reason, ',' ORDER BY reason) AS reasons
  FROM (SELECT * FROM told UNION SELECT 'method:2', 'entity-added') t GROUP BY t.id)""")
def review_reasons(g: Derived) -> DataFrame:
    """Reasons of violations, contracts, telemetry, complexity and coverage in one delta."""
    k, id_ = F.col("s_suppkey"), F.concat(F.lit("method:"), "s_suppkey")

    def side(kept: str, odd: bool) -> dict[str, DataFrame]:
        rows = g.table("supplier").where(kept)
        body = lambda n: F.when((F.col("s_nationkey") % n == 0) & F.lit(odd), "changed").otherwise("same")
        shape = g.spark.createDataFrame([("contract:1", "/a", "integer" if odd else "string"), ("contract:2", "/a", "string")], "contract string, path string, value string")
        return {"violations": rows.where("s_acctbal < 0").select(F.concat(F.lit("v"), k).alias("id"), id_.alias("node")), "telemetry": rows.select(id_.alias("node_id"), F.lit("same").alias("body")), "complexity": rows.select(id_.alias("node_id"), body(2).alias("body")), "coverage": rows.select(id_.alias("node_id"), body(3).alias("body")), "contracts": shape}

    homes = g.spark.createDataFrame([("contract:1", "method:1"), ("contract:2", "method:2")], "contract string, node string")
    reasons = review.analysis_reasons(side("s_suppkey % 5 <> 0", False), side("s_suppkey % 4 <> 0", True), homes)
    delta = g.spark.createDataFrame([("method:2", "added", "entity-added")], "id string, status string, reasons string")
    return review.with_reasons(delta, reasons, g.nodes)


@query("""SELECT 'impact' AS policy, id FROM nodes UNION ALL SELECT 'blast-radius', id FROM nodes
UNION ALL SELECT 'changes-only', id FROM (SELECT 'fn:1' AS id UNION SELECT 'package:1' UNION SELECT 'method:1')""")
def review_policies(g: Derived) -> DataFrame:
    changed = g.spark.createDataFrame([("fn:1",)], "id string")
    touched = g.spark.createDataFrame([("package:1|owns|method:1",)], "id string")
    out = None
    for policy in ("impact", "blast-radius", "changes-only"):
        told = overlays.review_graph(policy, g.nodes, g.edges, changed, touched)[0].select(F.lit(policy).alias("policy"), "id")
        out = told if out is None else out.union(told)
    return out


@query("""SELECT 0 AS place, 'set-projection' AS command, 'what-changed-architecturally' AS value UNION ALL SELECT 1, 'set-evidence', 'observed' UNION ALL SELECT 2, 'set-depth', '1'
UNION ALL SELECT (row_number() OVER (ORDER BY n_name) + 2)::INT, 'pin', n_name FROM nation QUALIFY row_number() OVER (ORDER BY n_name) <= 3""")
def planned_commands(g: Derived) -> DataFrame:
    """The nations are what changed; of them the first are pinned."""
    changed = [r["n_name"] for r in g.table("nation").select("n_name").collect()]
    commands = investigation.plan("Show only risky paths introduced by this PR?", changed)
    first = lambda c: next(str(v) for k, v in c.items() if k != "command")
    return g.spark.createDataFrame([(k, c["command"], first(c)) for k, c in enumerate(commands)], "place int, command string, value string")
