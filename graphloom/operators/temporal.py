"""Timelines: replay of deltas, introductions, validity of evidence, retention, incremental history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIB = 1024 * 1024


def replay(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """State after all deltas: (id, body). deltas: seq, id, status, body; the last writer wins."""
    rows = base.select(F.lit(-1).cast("long").alias("seq"), "id", F.lit("added").alias("status"), "body").union(deltas.select(F.col("seq").cast("long"), "id", "status", "body"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("status", "body"), "seq").alias("x"))
    return last.where("x.status <> 'removed'").select("id", "x.body")


def dependency_introduction(reviews: DataFrame, added: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(edge, review, snapshot): first review that adds an edge and whose head snapshot is there.

    reviews: review, created_at, head; added: review, edge; snapshots: snapshot.
    """
    rows = added.join(reviews, "review").join(snapshots.select(F.col("snapshot").alias("head")), "head", "left_semi")
    first = rows.groupBy("edge").agg(F.min(F.struct("created_at", "head", "review")).alias("x"))
    return first.select("edge", "x.review", F.col("x.head").alias("snapshot"))


def evidence_validity(snapshot: int, commit: str | None, at: Column) -> Column:
    """valid, stale, future or unscoped, over snapshot_id, commit and valid_until."""
    of, made, until = F.col("snapshot_id"), F.col("commit"), F.col("valid_until")
    other = made.isNotNull() & (F.lit(commit).isNotNull()) & (made != F.lit(commit))
    return F.when(of > snapshot, "future").when((of < snapshot) | other | (until < at), "stale").when(of.isNull() & made.isNull() & until.isNull(), "unscoped").otherwise("valid")


def storage_profile(snapshots: DataFrame) -> DataFrame:
    """One row: number, total and mean of storage_bytes, and how to keep snapshots."""
    sums = snapshots.agg(F.count("*").alias("count"), F.coalesce(F.sum("storage_bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.round(F.avg("storage_bytes")).cast("long"), F.lit(0)).alias("average_bytes"))
    full = (F.col("count") <= 20) & (F.col("average_bytes") <= 25 * MIB)
    return sums.withColumn("recommendation", F.when(full, "full-snapshots").otherwise("checkpoint-deltas"))


def kept_reviews(reviews: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` reviews of each repository: review, repository, created_at, base, head."""
    order = Window.partitionBy("repository").orderBy(F.desc("created_at"), F.desc("head"), F.desc("review"))
    return reviews.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def compact(snapshots: DataFrame, reviews: DataFrame, most: int) -> DataFrame:
    """Snapshots that stay: current ones and those that a kept review refers to."""
    kept = kept_reviews(reviews, most)
    used = kept.select(F.col("base").alias("snapshot")).union(kept.select(F.col("head").alias("snapshot"))).distinct()
    return snapshots.where("is_current").union(snapshots.where("not is_current").join(used, "snapshot", "left_semi").select(snapshots.columns))


def previous_snapshot(snapshots: DataFrame) -> DataFrame:
    """(snapshot, previous): the latest earlier snapshot of the same repository and kind."""
    order = Window.partitionBy("repository", "kind").orderBy("snapshot")
    return snapshots.select("snapshot", F.lag("snapshot").over(order).alias("previous"))


def snapshot_pairs(reviews: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(review, base, head, error): error tells which snapshot is not available."""
    ids = snapshots.select("snapshot", F.lit(True).alias("there"))
    rows = reviews.join(ids.select(F.col("snapshot").alias("base"), F.col("there").alias("b")), "base", "left").join(ids.select(F.col("snapshot").alias("head"), F.col("there").alias("h")), "head", "left")
    missing = F.when(F.col("b").isNull(), F.col("base")).when(F.col("h").isNull(), F.col("head"))
    return rows.select("review", "base", "head", F.when(missing.isNotNull(), F.concat(F.lit("Snapshot "), missing, F.lit(" is unavailable."))).alias("error"))


def merge_history(kept: DataFrame, fresh: DataFrame, since: Column) -> DataFrame:
    """Events of both, the fresh one of equal ids, without those before ``since``; newest first."""
    rows = kept.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    order = Window.partitionBy("id").orderBy(F.desc("__new"))
    last = rows.where(F.col("occurred_at") >= since).withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
    return last.drop("__new", "__rank").orderBy(F.desc("occurred_at"), "id")
