"""Indexing a repository: files to nodes, edges, analysis facts and rules."""

from __future__ import annotations

import os
import re
import subprocess
import tarfile
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, predicates
from ..operators import cycles, dataflow, facts, graph
from ..plans.scratch import materialize
from . import golang, text

# Folders that are not walked, besides those with a leading dot.
IGNORED = {"node_modules", "vendor", "dist", "build", "coverage"}
FAN_OUT, CYCLOMATIC = 12, 15


def walk(root: str) -> list[str]:
    """Paths of the Go and contract files below a folder, relative, sorted."""
    found = []
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in IGNORED and not d.startswith("."))
        found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names if n.endswith(".go") or text.contract_type(n)]
    return sorted(found)


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of ``walk``; for repositories on the driver's disk."""
    rows = [(p, Path(root, p).read_text()) for p in walk(root)]
    return spark.createDataFrame(rows, "path string, content string")


def files_of(spark: SparkSession, location: str) -> DataFrame:
    """(path, content) of the sources below a location of any file system, read in parallel."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    path = F.regexp_replace(F.substring_index("path", location.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "^/+", "")
    kept = rows.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))
    skipped = "|".join(sorted(IGNORED))
    return kept.where((F.col("path").endswith(".go") | text.contract_kind(F.regexp_extract("path", "[^/]*$", 0)).isNotNull()) & ~F.concat(F.lit("/"), "path").rlike(rf"/(?:\.[^/]*|{skipped})/"))


def module_name(root: str) -> str:
    path = Path(root, "go.mod")
    found = re.search(r"^module\s+(\S+)", path.read_text(), re.M) if path.exists() else None
    return found[1] if found else ""


def owners_text(root: str) -> str:
    """The first owners file that is there, blank without one."""
    return next((Path(root, p).read_text() for p in (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS") if Path(root, p).exists()), "")


def head_commit(root: str) -> str:
    """The commit that is checked out, by git or, without it, by the repository's own files; blank if unknown."""
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    except OSError:
        done = None
    return done.stdout.strip() if done is not None and done.returncode == 0 else _stored_head(Path(root, ".git"))


def _stored_head(folder: Path) -> str:
    """A detached head's commit, else that of its branch, which lies alone or among the packed ones."""
    known = lambda name: (folder / name).read_text() if (folder / name).is_file() else ""
    head = known("HEAD").strip()
    if not head.startswith("ref: "):
        return head
    branch = head.removeprefix("ref: ")
    packed = re.search(rf"^(\S+) {re.escape(branch)}$", known("packed-refs"), re.M)
    return known(branch).strip() or (packed[1] if packed else "")


@contextmanager
def tree_of(root: str, ref: str) -> Iterator[str]:
    """A folder of the driver with the files of a commit, removed on leaving; the working tree itself for WORKTREE."""
    if ref == "WORKTREE":
        yield root
        return
    with tempfile.TemporaryDirectory(prefix="graphloom-tree-") as target:
        with tempfile.TemporaryFile() as archive:
            subprocess.run(["git", "-C", root, "archive", "--format=tar", ref], stdout=archive, check=True)
            archive.seek(0)
            with tarfile.open(fileobj=archive) as tar:
                tar.extractall(target, filter="data")
        yield target


def files_at(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """(path, content) of ``walk`` at a commit, as a table in the shared folder that executors read."""
    with tree_of(root, ref) as tree:
        return materialize(files(spark, tree), "tree")


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


class Index:
    """Relations of one repository's sources, from (path, content)."""

    def __init__(self, sources: DataFrame, service: str, module: str = "", owners: str = ""):
        self.spark, self.service, self.module = sources.sparkSession, service, module
        self.service_id = F.lit(service)
        go = sources.where("path like '%.go' and not endswith(lower(path), '.generated.go')")
        self.rows = materialize(golang.declarations(go), "declarations")
        self.contract_fields = materialize(text.contract_fields(sources), "contracts")
        self.rules = text.owner_rules(self.spark, owners)

    def package_id(self, folder: Column, name: Column) -> Column:
        return ids.stable_id("package", F.when(folder == ".", name).otherwise(folder))

    def packages(self) -> DataFrame:
        """(folder, id, label) of each folder with Go files or contracts."""
        named = self.rows.where("row = 'package'").groupBy(_folder(F.col("file")).alias("folder")).agg(F.min_by("name", "file").alias("name"))
        held = self.contract_fields.select(_folder(F.col("name")).alias("folder")).distinct().join(named, "folder", "left_anti")
        both = named.union(held.select("folder", F.regexp_extract("folder", r"([^/]*)$", 1).alias("name")))
        return both.select("folder", self.package_id(F.col("folder"), F.col("name")).alias("id"), F.when(F.col("folder") == ".", F.col("name")).otherwise(F.col("folder")).alias("label"))

    def import_edges(self) -> DataFrame:
        """(pkg, target, label, external, location) of imports."""
        home = self.packages().select("folder", F.col("id").alias("pkg"))
        rows = self.rows.where("row = 'import'").drop("pkg").withColumn("folder", _folder(F.col("file"))).join(home, "folder")
        path = F.col("target")
        root = self.packages().where("folder = '.'").select(F.col("id").alias("root_id"))
        rows = rows.join(F.broadcast(root), F.lit(True), "left")  # one row at most
        local = (path == self.module) | path.startswith(self.module + "/") if self.module else F.lit(False)
        inner = F.when(path == self.module, F.coalesce("root_id", ids.stable_id("package", F.lit(self.service)))).otherwise(ids.stable_id("package", F.substr(path, F.lit(len(self.module) + 2))))
        return rows.select("pkg", F.when(local, inner).otherwise(ids.stable_id("package", path)).alias("target"), path.alias("label"), (~local).alias("external"), F.concat_ws(":", "file", "line").alias("location"))

    def symbols(self) -> DataFrame:
        """Functions, methods and tests: id, kind, label, pkg, pkg_name, file, line, end_line, exported, cyclomatic, loc, fingerprint."""
        home = self.packages().select("folder", F.col("id").alias("pkg_id"))
        rows = self.rows.where("row = 'func'").withColumn("folder", _folder(F.col("file"))).join(home, "folder")
        test = F.lower("file").endswith("_test.go") & F.regexp_extract("name", r"([^.]*)$", 1).startswith("Test")
        kind = F.when(test, "test").when(F.col("recv") != "", "method").otherwise("function")
        return rows.select(ids.stable_id(kind, F.concat_ws(":", "file", "name")).alias("id"), kind.alias("kind"), F.col("name").alias("label"), F.col("pkg_id").alias("pkg"), F.col("pkg").alias("pkg_name"), "folder", "file", "line", "end_line", "exported", "cyclomatic", (F.col("end_line") - F.col("line") + 1).alias("loc"), "fingerprint")

    def calls(self) -> DataFrame:
        """Call rows with the id of the calling function."""
        caller = self.symbols().select("file", F.col("label").alias("owner"), F.col("id").alias("caller"), F.col("kind").alias("caller_kind"), F.col("pkg").alias("caller_pkg"), "pkg_name", "folder")
        return self.rows.where("row = 'call'").drop("pkg").join(caller, ["file", "owner"])

    def _resolved(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows with ``found`` and ``found_kind``, what a descriptor of ``column`` names among the symbols."""
        symbols = self.symbols().select("pkg", "pkg_name", F.col("label").alias("symbol"), F.col("id").alias("found"), F.col("kind").alias("found_kind"))
        parts = F.split(column, r"\|")
        path, symbol = parts[0], F.when(parts[1] != "", F.concat_ws(".", parts[1], parts[2])).otherwise(parts[2])
        root = self.packages().where("folder = '.'").select(F.col("id").alias("root_id"))
        told = rows.join(F.broadcast(root), F.lit(True), "left")
        inner = F.when(path == "", F.col("caller_pkg")).when(path == self.module, F.col("root_id")).when(path.startswith(self.module + "/") & F.lit(bool(self.module)), ids.stable_id("package", F.substr(path, F.lit(len(self.module) + 2))))
        told = told.withColumns({"__pkg": inner, "__symbol": symbol, "__local": path == ""})
        fit = (F.col("__pkg") == symbols["pkg"]) & (F.col("__symbol") == symbols["symbol"]) & (~F.col("__local") | (told["pkg_name"] == symbols["pkg_name"]))
        return told.join(symbols, fit, "left").drop(symbols["pkg"]).drop(symbols["pkg_name"]).drop("symbol", "root_id", "__pkg", "__symbol", "__local")

    def _homes(self, rows: DataFrame) -> DataFrame:
        """Rows of declarations with ``own``, their package, and the package, type and depth of their target."""
        home = self.packages().select("folder", F.col("id").alias("own"))
        parts = F.split("target", r"\|")
        told = rows.where("target <> ''").withColumn("folder", _folder(F.col("file"))).join(home, "folder")
        return told.select("own", "name", "alias", self._package_of(parts[0], F.col("own")).alias("to_pkg"), parts[1].alias("to_type"), parts[2].cast("int").alias("to_depth"))

    def _package_of(self, path: Column, own: Column) -> Column:
        """Id of the package that an import path names; null for packages of elsewhere and of the root folder."""
        inner = F.when(path == "", own)
        return inner.when(path.startswith(self.module + "/"), ids.stable_id("package", F.substr(path, F.lit(len(self.module) + 2)))) if self.module else inner

    def followed(self) -> DataFrame:
        """(caller, caller_kind, found, method, location) of calls on fields, elements and results, by following their chains."""
        members = self._homes(self.rows.where("row = 'field'")).withColumn("key", F.concat_ws("|", F.lit("f"), "name", "alias"))
        results = self._homes(self.rows.where("row = 'result'"))
        dot = F.when(F.col("name").contains("."), F.regexp_replace("name", r"\.", "|")).otherwise(F.concat(F.lit("|"), "name"))
        members = members.unionByName(results.withColumn("key", F.concat_ws("|", F.lit("c"), dot, "alias")))
        members = materialize(members.select("own", "key", "to_pkg", "to_type", "to_depth").dropDuplicates(["own", "key"]), "members")
        rows = self.calls().where(F.size("chain") > 0)
        base = F.split(F.col("chain")[0], r"\|")
        plain = base[0] == "t"
        rest = F.slice("chain", 2, 1_000_000)
        first = rows.select(
            "caller", "caller_kind", "method", F.concat_ws(":", "file", "line").alias("location"), self._package_of(base[1], F.col("caller_pkg")).alias("own"), F.when(plain, base[2]).otherwise("").alias("type"),
            F.when(plain, base[3].cast("int")).otherwise(0).alias("depth"), F.when(plain, rest).otherwise(F.concat(F.array(F.concat_ws("|", F.lit("c"), base[2], base[3])), rest)).alias("steps"),
        )
        now = materialize(first.where("own is not null"), "chains")
        for _ in range(now.agg(F.max(F.size("steps"))).collect()[0][0] or 0):
            step = F.split(F.get("steps", F.lit(0)), r"\|")
            key = F.when(F.col("depth") == 0, F.when(step[0] == "f", F.concat_ws("|", F.lit("f"), "type", step[1])).when(step[0] == "c", F.concat_ws("|", F.lit("c"), "type", step[1], step[2])))
            told = now.withColumns({"key": F.when(F.size("steps") > 0, key), "e": F.coalesce((step[0] == "e") & (F.col("depth") > 0), F.lit(False)), "done": F.size("steps") == 0})
            met = told.join(members, ["own", "key"], "left").where("done or e or to_type is not null")
            turn = lambda old, new: F.when(F.col("done") | F.col("e"), F.col(old)).otherwise(F.col(new))
            moved = met.select("caller", "caller_kind", "method", "location", turn("own", "to_pkg").alias("own"), turn("type", "to_type").alias("type"), F.when(F.col("e"), F.col("depth") - 1).otherwise(turn("depth", "to_depth")).alias("depth"), F.when(F.col("done"), F.col("steps")).otherwise(F.slice("steps", 2, 1_000_000)).alias("steps"))
            now = materialize(moved.where("own is not null"), "chains")
        symbols = self.symbols().select(F.col("pkg").alias("own"), F.col("label").alias("symbol"), F.col("id").alias("found"))
        ended = now.where("depth = 0 and size(steps) = 0").withColumn("symbol", F.concat_ws(".", "type", "method"))
        return ended.join(symbols, ["own", "symbol"]).select("caller", "caller_kind", "found", "method", "location")

    def call_edges(self) -> DataFrame:
        """(source, kind, target, label, location): calls that resolve; external packages' functions go to the package."""
        rows = self._resolved(self.calls().where("target <> ''"), "target")
        path = F.split("target", r"\|")[0]
        plain = F.split("target", r"\|")[1] == ""
        outer = (path != "") & plain & (F.lit(not self.module) | ~((path == self.module) | path.startswith(self.module + "/")))
        target = F.coalesce("found", F.when(outer, ids.stable_id("package", path)))
        kind = F.when((F.col("caller_kind") == "test") & F.col("found").isNotNull(), "tests").otherwise("calls")
        direct = rows.select(F.col("caller").alias("source"), kind.alias("kind"), target.alias("target"), F.col("method").alias("label"), F.concat_ws(":", "file", "line").alias("location")).where("target is not null")
        through = self.followed().select(F.col("caller").alias("source"), F.when(F.col("caller_kind") == "test", "tests").otherwise("calls").alias("kind"), F.col("found").alias("target"), F.col("method").alias("label"), "location")
        return direct.union(through)

    def flows(self) -> DataFrame:
        """(id, kind, target_kind, target, label, boundary, location) of literal data flow."""
        rows = self.calls().where("receiver <> ''").withColumn("call", F.monotonically_increasing_id())
        rows = materialize(rows.select("call", "caller", "receiver", "method", "values", "http", F.concat_ws(":", "file", "line").alias("location")), "flows")
        told = dataflow.classify_calls(rows.withColumnRenamed("call", "id"))
        return told.join(rows.select(F.col("call").alias("id"), "caller", "location"), "id").select(F.col("caller").alias("id"), "kind", "target_kind", "target", "label", "boundary", "location")

    def endpoints(self) -> DataFrame:
        """(id, label, handler, file, location) of registered routes."""
        path = F.get(F.filter("values", lambda v: v.startswith("/")), F.lit(0))
        rows = self.calls().withColumns({"call": F.monotonically_increasing_id(), "path": path}).where("path is not null")
        rows = materialize(rows, "routes")
        upper = F.upper("method")
        handles = upper.contains("HANDLEFUNC")
        receiver = F.when(F.col("route_type") != "", F.col("route_type")).otherwise(F.col("receiver"))
        verb = upper.isin("GET", "POST", "PUT", "PATCH", "DELETE") & predicates.route_receiver(receiver)
        named = self._resolved(rows.select("call", "caller_pkg", "pkg_name", F.posexplode("args").alias("place", "arg")).where("arg <> 'func'"), "arg")
        handler = named.where("found_kind in ('function', 'method')").groupBy("call").agg(F.max_by("found", "place").alias("handler"))
        told = rows.join(handler, "call", "left")
        inline = F.array_contains("args", "func")
        kept = told.where(handles | (verb & (F.col("handler").isNotNull() | inline | F.col("echo"))))
        prefix = F.regexp_replace("prefix", "^/+|/+$", "")
        route = F.when(F.col("prefix") != "", F.concat(F.lit("/"), prefix, F.lit("/"), F.regexp_replace("path", "^/", ""))).otherwise(F.col("path"))
        verbs = F.coalesce(*[F.when(upper.contains(v), v) for v in ("GET", "POST", "PUT", "PATCH", "DELETE")], F.lit("HTTP"))
        label = F.concat_ws(" ", verbs, route)
        return kept.select(ids.stable_id("endpoint", label).alias("id"), label.alias("label"), F.coalesce("handler", "caller").alias("handler"), "file", F.concat_ws(":", "file", "line").alias("location"))

    def _owned(self, rows: DataFrame) -> DataFrame:
        """Rows with ``path`` and the owners of it."""
        return rows.join(facts.last_owner_match(rows.select("path").distinct(), self.rules), "path", "left")

    def nodes(self) -> DataFrame:
        """id, kind, label, pkg, file, owner, owners, exported, cyclomatic, loc, fingerprint, external."""
        null = lambda t: F.lit(None).cast(t)
        symbols = self._owned(self.symbols().withColumn("path", F.col("file")))
        symbols = symbols.select("id", "kind", "label", "pkg", F.concat_ws(":", "file", "line").alias("file"), F.get("owners", F.lit(0)).alias("owner"), "owners", "exported", "cyclomatic", "loc", "fingerprint", F.lit(False).alias("external"))
        home = self.packages().select("folder", F.col("id").alias("pkg"))
        paths = self.rows.where("row = 'package'").select(F.col("file").alias("path")).union(self.contract_fields.select("name").distinct()).distinct()
        votes = facts.package_owner_votes(self._owned(paths).withColumn("folder", _folder(F.col("path"))).join(home, "folder").select("pkg", F.explode("owners").alias("owner")))
        own = self.packages().join(votes.withColumnRenamed("pkg", "id"), "id", "left")
        blank = [null("boolean").alias("exported"), null("int").alias("cyclomatic"), null("int").alias("loc"), null("string").alias("fingerprint")]
        packages = own.select("id", F.lit("package").alias("kind"), "label", null("string").alias("pkg"), F.col("folder").alias("file"), "owner", "owners", *blank, F.lit(False).alias("external"))
        plain = lambda rows, kind, ext=False: rows.select("id", kind.alias("kind"), "label", null("string").alias("pkg"), null("string").alias("file"), null("string").alias("owner"), null("array<string>").alias("owners"), *blank, F.lit(ext).alias("external")).distinct()
        outer = plain(self.import_edges().where("external").select(F.col("target").alias("id"), "label"), F.lit("package"), True)
        service = plain(self.spark.createDataFrame([(self.service, self.service)], "id string, label string"), F.lit("service"))
        resources = plain(self.flows().select(ids.stable_id(F.col("target_kind"), F.col("target")).alias("id"), F.col("target_kind"), F.col("target").alias("label")), F.col("target_kind"))
        routes = plain(self.endpoints().select("id", "label"), F.lit("endpoint"))
        shapes = self.contract_fields.select(F.col("contract").alias("id"), F.col("name")).distinct().withColumn("folder", _folder(F.col("name"))).join(home, "folder")
        held = self._owned(shapes.withColumn("path", F.col("name"))).select("id", F.lit("contract").alias("kind"), F.regexp_extract("name", r"([^/]*)$", 1).alias("label"), "pkg", F.col("name").alias("file"), F.get("owners", F.lit(0)).alias("owner"), "owners", *blank, F.lit(False).alias("external"))
        out = service
        for part in (packages, outer.join(packages, "id", "left_anti"), symbols, resources, routes, held):
            out = out.unionByName(part)
        return out

    def edges(self) -> DataFrame:
        """Collapsed edges; the first observation is that of the least location."""
        step = lambda rows, source, kind, target, label, boundary, location: rows.select(source.alias("source"), kind.alias("kind"), target.alias("target"), label.alias("label"), boundary.alias("boundary"), location.alias("ord"))
        c, none = F.col, F.lit(None).cast("string")
        flow = self.flows()
        held = self.contract_fields.select("contract", "name").distinct().withColumn("folder", _folder(c("name"))).join(self.packages().select("folder", c("id").alias("pkg")), "folder")
        parts = [
            step(self.packages(), F.lit(self.service), F.lit("owns"), c("id"), F.lit("contains"), none, c("label")),
            step(self.import_edges(), c("pkg"), F.lit("depends_on"), c("target"), F.lit("imports"), none, c("location")),
            step(self.symbols(), c("pkg"), F.lit("owns"), c("id"), F.lit("declares"), none, F.concat_ws(":", "file", "line")),
            step(held, c("pkg"), F.lit("owns"), c("contract"), F.lit("contains"), none, c("name")),
            step(self.call_edges(), c("source"), c("kind"), c("target"), c("label"), none, c("location")),
            step(flow, c("id"), c("kind"), ids.stable_id(c("target_kind"), c("target")), c("label"), c("boundary"), c("location")),
            step(self.endpoints(), c("id"), F.lit("calls"), c("handler"), F.lit("handler"), none, c("location")),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return facts.collapse_edges(out)


def violations(nodes: DataFrame, edges: DataFrame, owners: str) -> DataFrame:
    """(rule, node, detail): package cycles, fan-out, untested exports, cyclomatic complexity, missing owners file."""
    local = nodes.where("kind = 'package' and not external").select("id")
    deps = edges.where("kind = 'depends_on'").join(local.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("u"), F.col("target").alias("v"))
    rings = cycles.strong_components(deps).groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("detail"))
    fans = facts.fans(edges, nodes)
    covered = graph.covered(nodes, edges).select(F.col("node").alias("id"))
    symbols = nodes.where("kind in ('function', 'method')")
    rows = [
        rings.select(F.lit("cycle").alias("rule"), F.col("component").alias("node"), "detail"),
        fans.where(f"fan_out > {FAN_OUT}").select(F.lit("fan-out"), "id", F.col("fan_out").cast("string")),
        symbols.where("exported").join(covered, "id", "left_anti").select(F.lit("untested-export"), "id", F.lit("")),
        symbols.where(f"cyclomatic > {CYCLOMATIC}").select(F.lit("cyclomatic"), "id", F.col("cyclomatic").cast("string")),
    ]
    if not owners:
        rows.append(nodes.where("kind = 'service'").select(F.lit("no-owners-file"), "id", F.lit("")))
    out = rows[0]
    for part in rows[1:]:
        out = out.union(part)
    return out
