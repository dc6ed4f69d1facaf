"""Snapshots, reviews and memo tables as Parquet under a log of commits.

Rows are written first, into folders that no one else has; a commit then names them.
Snapshots get their numbers in the commit, after all numbers ever given, so two writers
never share one and a dropped one never comes back. A writer that stops before its commit
leaves folders that no reader sees and ``vacuum`` removes. Folders are never written over:
who loaded a review before it was made again still reads what it was.

A snapshot may be kept as its difference from an earlier one; every CHAIN-th is whole.
Stores of the earlier form (a manifest as a table) are read on, and their numbers count.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .log import Action, CommitLog

MANIFEST = "repository_id string, snapshot_id bigint, kind string, commit string, created_at timestamp, storage_bytes bigint"
REVIEWS = "review string, repository string, base bigint, head bigint, created_at timestamp"
PARTS = ("nodes", "edges", "evidence", "analysis")
#: Snapshots of a chain at most, the whole one included.
CHAIN = 10
STATUS = "__status"


class Store:
    """A folder of snapshot tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/_log")
        self._earlier: dict[str, list[dict]] = {}

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read.option("mergeSchema", "true")
        try:
            return (reader.schema(schema) if schema else reader).parquet(f"{self.path}/{name}")
        except Exception as error:  # a table that nothing was written to
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER" in str(error):
                return None
            raise

    def _legacy(self, name: str, schema: str) -> list[dict]:
        """Tables of the earlier form, which nothing writes to any more."""
        if name not in self._earlier:
            rows = self._read(name, schema)
            self._earlier[name] = [] if rows is None else [r.asDict() for r in rows.collect()]  # a row per snapshot or review
        return self._earlier[name]

    def _state(self, commits: list[list[Action]] | None = None) -> tuple[dict[int, dict], list[dict], dict[str, str]]:
        """Snapshots by number (dropped ones marked), reviews in order, names of repositories."""
        snapshots = {r["snapshot_id"]: r | {"parts": None, "base": None, "gone": False} for r in self._legacy("snapshots", MANIFEST)}
        reviews = [r | {"folder": f"deltas/review_id={r['review']}"} for r in sorted(self._legacy("reviews", REVIEWS), key=lambda r: r["created_at"])]
        gone = {r["snapshot_id"] for r in self._legacy("dropped", "snapshot_id bigint")}
        names = {r["repository_id"]: r["name"] for r in sorted(self._legacy("repositories", "repository_id string, name string, at timestamp"), key=lambda r: r["at"])}
        for actions in self.log.actions() if commits is None else commits:
            for action in actions:
                what = action["what"]
                if what == "repository":
                    names[action["repository_id"]] = action["name"]
                elif what == "snapshot":
                    snapshots[action["snapshot_id"]] = action | {"created_at": _time(action["created_at"]), "gone": False}
                elif what == "review":
                    reviews.append(action | {"created_at": _time(action["created_at"])})
                elif what == "drop":
                    gone |= set(action["snapshots"])
        for number in gone & snapshots.keys():
            snapshots[number]["gone"] = True
        return snapshots, reviews, names

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def register(self, repository_id: str, name: str) -> None:
        """Record a repository once; the last name holds."""
        self.log.commit(lambda _: [{"what": "repository", "repository_id": repository_id, "name": name}])

    def repositories(self) -> DataFrame:
        return self._frame(sorted(self._state()[2].items()), "repository_id string, name string")

    def snapshots(self) -> DataFrame:
        """The manifest, but for what was dropped."""
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        return self._frame([tuple(s[n] for n in names) for _, s in sorted(self._state()[0].items()) if not s["gone"]], MANIFEST)

    def _whole(self, snapshot: dict, name: str) -> DataFrame | None:
        """A part of a snapshot: its own rows over those of the snapshots that it builds on."""
        if snapshot["parts"] is None:
            return self._read(f"{name}/repository_id={snapshot['repository_id']}/snapshot_id={snapshot['snapshot_id']}")
        snapshots, chain = self._state()[0], [snapshot]
        while chain[-1]["base"] is not None:
            chain.append(snapshots[chain[-1]["base"]])
        layers = [self._read(link["parts"][name]) for link in reversed(chain) if name in link["parts"]]
        layers = [x for x in layers if x is not None]
        whole = max((k for k, x in enumerate(layers) if STATUS not in x.columns), default=None)
        if whole is None or whole == len(layers) - 1:
            return layers[-1] if layers else None
        columns, rows = layers[whole].columns, None
        for place, layer in enumerate(layers[whole:]):
            told = layer.select(*columns, F.lit(place).alias("__place"), (F.col(STATUS) if place else F.lit("whole")).alias(STATUS))
            rows = told if rows is None else rows.unionByName(told)
        last = rows.groupBy(F.col("id").alias("__id")).agg(F.max_by(F.struct(*columns, STATUS), "__place").alias("x"))
        return last.where(f"x.{STATUS} <> 'removed'").select(*(F.col(f"x.{c}").alias(c) for c in columns))

    def _depth(self, snapshots: dict[int, dict], number: int | None) -> int:
        depth = 0
        while number is not None:
            depth, number = depth + 1, snapshots[number]["base"]
        return depth

    def _write(self, parts: dict[str, DataFrame], onto: dict | None = None) -> tuple[dict[str, str], int]:
        """Write the parts of a snapshot into new folders; returns them and their size as JSON.

        With ``onto`` only the rows that differ from that snapshot's are written, and those it has besides.
        """
        folders, total = {}, 0
        for name in PARTS:
            if name not in parts:
                continue
            rows, folder = parts[name], f"{name}/{uuid.uuid4().hex}"
            before = self._whole(onto, name) if onto is not None else None
            if before is not None and "id" in rows.columns and rows.columns == before.columns:
                same = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
                new, old = rows.withColumn("__body", same(rows)), before.select("id", same(before).alias("__old"))
                fresh = new.join(old, "id", "left").where("__old is null or __body <> __old").select(*rows.columns, F.lit("changed").alias(STATUS))
                gone = before.join(rows.select("id"), "id", "left_anti").select(*before.columns, F.lit("removed").alias(STATUS))
                rows = fresh.unionByName(gone)
            rows.write.parquet(f"{self.path}/{folder}")
            written = self.spark.read.parquet(f"{self.path}/{folder}")
            total += written.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).collect()[0][0] or 0
            folders[name] = folder
        return folders, total

    def _named(self, commits: list[list[Action]], rows: list[tuple[str, str, str, dict[str, str], int, int | None]]) -> list[Action]:
        """Snapshot actions with numbers after all that were ever given."""
        last = max(self._state(commits)[0], default=0)
        now = datetime.datetime.now(datetime.UTC).isoformat()
        return [{"what": "snapshot", "repository_id": r, "snapshot_id": last + 1 + k, "kind": kind, "commit": c, "created_at": now, "storage_bytes": size, "parts": folders, "base": base} for k, (r, kind, c, folders, size, base) in enumerate(rows)]

    def save(self, repository_id: str, kind: str, commit: str, onto: int | None = None, **parts: DataFrame) -> int:
        """Write a snapshot's parts, then its commit; returns its id.

        With ``onto`` it is kept as its difference from that snapshot of the repository, whose
        rows, like its own, have one id each; after CHAIN of them the next one is whole again.
        """
        base = None
        if onto is not None:
            snapshots = self._state()[0]
            base = self._available(repository_id, onto)
            base = base if base["parts"] and set(base["parts"]) == set(parts) and self._depth(snapshots, onto) < CHAIN else None
        folders, size = self._write(parts, base)
        number = None if base is None else base["snapshot_id"]

        def change(commits: list[list[Action]]) -> list[Action]:
            if number is not None and self._state(commits)[0][number]["gone"]:
                raise KeyError(f"snapshot {number} was dropped meanwhile")
            return self._named(commits, [(repository_id, kind, commit, folders, size, number)])

        return self.log.commit(change)[0]["snapshot_id"]

    def save_pair(self, repository_id: str, review_id: str, commits: tuple[str, str], base: dict[str, DataFrame], head: dict[str, DataFrame], delta: DataFrame) -> tuple[int, int]:
        """Write both snapshots of a review and its delta; one commit tells of all three."""
        written = [self._write(parts) for parts in (base, head)]
        folder = self._delta(delta)

        def change(before: list[list[Action]]) -> list[Action]:
            rows = self._named(before, [(repository_id, "review", c, *w, None) for c, w in zip(commits, written, strict=True)])
            return [*rows, *self._reviewed(before, repository_id, review_id, rows[0]["snapshot_id"], rows[1]["snapshot_id"], folder)]

        first, second, *_ = self.log.commit(change)
        return first["snapshot_id"], second["snapshot_id"]

    def timeline(self, repository_id: str) -> tuple[DataFrame, DataFrame]:
        """Snapshots and reviews of a repository, oldest first."""
        rows = self.snapshots().where(F.col("repository_id") == repository_id).orderBy("snapshot_id")
        return rows, self.reviews().where(F.col("repository") == repository_id).orderBy("created_at", "head", "review")

    def _available(self, repository_id: str, snapshot_id: int) -> dict:
        found = self._state()[0].get(snapshot_id)
        if found is None or found["gone"] or found["repository_id"] != repository_id:
            raise KeyError(f"snapshot {snapshot_id} is not available")
        return found

    def load(self, name: str, repository_id: str, snapshot_id: int) -> DataFrame:
        """A part of a snapshot that is there."""
        rows = self._whole(self._available(repository_id, snapshot_id), name)
        if rows is None:
            raise KeyError(f"snapshot {snapshot_id} has no {name}")
        return rows.orderBy(*[c for c in ("kind", "label", "id") if c in rows.columns]) if name == "nodes" else rows

    def fingerprint(self, repository_id: str, snapshot_id: int) -> str:
        """SHA-256 over all parts of a snapshot, whatever the order of their rows and whether they are kept whole."""
        from ..operators import overlays

        out, snapshot = None, self._available(repository_id, snapshot_id)
        for name in PARTS:
            rows = self._whole(snapshot, name)
            if rows is not None:
                told = rows.select(F.sha2(F.concat_ws("\n", F.lit(name), F.to_json(F.struct(*sorted(rows.columns)))).cast("binary"), 256).alias("fp"))
                out = told if out is None else out.union(told)
        return overlays.snapshot_fingerprint(out) if out is not None else ""

    def fingerprints(self) -> DataFrame:
        schema = "snapshot_id bigint, fingerprint string"
        rows = self._read("fingerprints", schema)
        return rows if rows is not None else self.spark.createDataFrame([], schema)

    def backfill(self) -> list[int]:
        """Fingerprints of the snapshots without one; returns their ids."""
        missing = self.snapshots().join(self.fingerprints(), "snapshot_id", "left_anti").orderBy("snapshot_id").collect()  # a row per snapshot
        told = [(r["snapshot_id"], self.fingerprint(r["repository_id"], r["snapshot_id"])) for r in missing]
        if told:
            self.spark.createDataFrame(told, "snapshot_id bigint, fingerprint string").coalesce(1).write.mode("append").parquet(f"{self.path}/fingerprints")
        return [n for n, _ in told]

    def current(self, repository_id: str) -> int | None:
        """The latest indexed snapshot."""
        return max((n for n, s in self._state()[0].items() if not s["gone"] and s["repository_id"] == repository_id and s["kind"] == "index"), default=None)

    def _delta(self, delta: DataFrame) -> str:
        folder = f"deltas/{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.path}/{folder}")
        return folder

    def _reviewed(self, commits: list[list[Action]], repository_id: str, review_id: str, base: int, head: int, folder: str) -> list[Action]:
        """A review's action; what only its former self referred to is dropped with it."""
        snapshots, reviews, _ = self._state(commits)
        now = datetime.datetime.now(datetime.UTC).isoformat()
        newest = {r["review"]: r for r in reviews}
        former = newest.pop(review_id, None)
        used = {base, head} | {r[side] for r in newest.values() for side in ("base", "head")} | _bases(snapshots)
        left = {former["base"], former["head"]} - used if former else set()
        gone = sorted(n for n in left if n in snapshots and not snapshots[n]["gone"] and snapshots[n]["kind"] != "index")
        review = {"what": "review", "review": review_id, "repository": repository_id, "base": base, "head": head, "created_at": now, "folder": folder}
        return [review, *([{"what": "drop", "snapshots": gone}] if gone else [])]

    def save_review(self, repository_id: str, review_id: str, base: int, head: int, delta: DataFrame) -> None:
        """Give a review a new delta (what, id, status, reasons); readers of the former one keep it."""
        folder = self._delta(delta)
        self.log.commit(lambda before: self._reviewed(before, repository_id, review_id, base, head, folder))

    def _reviews(self) -> list[dict]:
        snapshots, reviews, _ = self._state()
        there = {n for n, s in snapshots.items() if not s["gone"]}
        return [r for r in {r["review"]: r for r in reviews}.values() if {r["base"], r["head"]} <= there]

    def reviews(self) -> DataFrame:
        """The newest of each review, if both its snapshots are there."""
        return self._frame([(r["review"], r["repository"], r["base"], r["head"], r["created_at"]) for r in self._reviews()], REVIEWS)

    def latest_review(self, repository_id: str) -> DataFrame:
        rows = self.reviews().where(F.col("repository") == repository_id)
        return rows.orderBy(F.desc("created_at"), F.desc("head"), F.desc("review")).limit(1)

    def delta(self, review_id: str) -> DataFrame:
        found = {r["review"]: r for r in self._state()[1]}.get(review_id)
        if found is None:
            raise KeyError(f"review {review_id} is not available")
        return self.spark.read.parquet(f"{self.path}/{found['folder']}")

    def remember(self, table: str, key: dict[str, str], rows: DataFrame) -> None:
        """Keep a result under its key, as for profiles of a snapshot, model and window."""
        folder = "/".join(f"{k}={v}" for k, v in key.items())
        rows.withColumn("calculated_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.path}/{table}/{folder}")

    def recall(self, table: str, key: dict[str, str], hours: float = 24) -> DataFrame | None:
        """What is kept under a key, unless it is older than ``hours``."""
        folder = "/".join(f"{k}={v}" for k, v in key.items())
        rows = self._read(f"{table}/{folder}")
        if rows is None:
            return None
        fresh = rows.where(age_hours(F.col("calculated_at")) < hours)
        return None if fresh.isEmpty() else fresh.drop("calculated_at")

    def compact(self, keep: int) -> list[int]:
        """Drop the snapshots that no kept review, no current state and no snapshot that stays needs; returns their ids."""
        from ..operators import temporal

        rows = self.snapshots()
        newest = Window.partitionBy("repository_id").orderBy(F.desc("snapshot_id"))
        indexed = rows.where("kind = 'index'").withColumn("r", F.row_number().over(newest)).where("r = 1").select("snapshot_id", F.lit(True).alias("cur"))
        marked = rows.join(indexed, "snapshot_id", "left").select(F.col("snapshot_id").alias("snapshot"), F.coalesce("cur", F.lit(False)).alias("is_current"))
        stay = {r["snapshot"] for r in temporal.compact(marked, self.reviews(), keep).select("snapshot").collect()}
        seen = {r["snapshot"] for r in marked.collect()}  # what is saved meanwhile stays

        def change(commits: list[list[Action]]) -> list[Action]:
            snapshots = self._state(commits)[0]
            left = {n for n, s in snapshots.items() if not s["gone"] and (n in stay or n not in seen)}
            for number in list(left):  # the snapshots that those build on
                while (number := snapshots[number]["base"]) is not None:
                    left.add(number)
            return [{"what": "drop", "snapshots": sorted(n for n in seen - left if not snapshots[n]["gone"])}]

        return self.log.commit(change)[0]["snapshots"]

    def vacuum(self, hours: float = 24) -> list[str]:
        """Remove folders of rows, older than ``hours``, that no snapshot there and no review names; returns them.

        The age must pass that of any writer or reader still at work.
        """
        snapshots, reviews, _ = self._state()
        there = {n: s for n, s in snapshots.items() if not s["gone"]}
        named = {f for s in there.values() for f in (s["parts"] or {}).values()} | {f for n in _bases(there) for f in (snapshots[n]["parts"] or {}).values()} | {r["folder"] for r in {r["review"]: r for r in reviews}.values()}
        path, fs, gone = self.log._path, self.log._fs, []
        for name in (*PARTS, "deltas"):
            if fs.exists(path(f"{self.path}/{name}")):
                for status in fs.listStatus(path(f"{self.path}/{name}")):
                    own = status.getPath().getName()
                    old = status.getModificationTime() / 1000 < datetime.datetime.now().timestamp() - hours * 3600
                    if "=" not in own and old and f"{name}/{own}" not in named:
                        fs.delete(status.getPath(), True)
                        gone.append(f"{name}/{own}")
        return sorted(gone)


def _bases(snapshots: dict[int, dict]) -> set[int]:
    return {s["base"] for s in snapshots.values() if not s["gone"] and s["base"] is not None}


def _time(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text)


def age_hours(at: Column) -> Column:
    return (F.unix_micros(F.current_timestamp()) - F.unix_micros(at)) / 3.6e9
