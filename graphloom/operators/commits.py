"""A commit graph, indexed: who is an ancestor of whom, and the commits between two.

Commits are laid on chains along their first parents; of several commits with the same
first parent the newest goes on with its chain, the others begin new ones. Places on a
chain come from pointers that double, so a history of any length takes rounds by its
logarithm. What leads from one chain to another are the other parents of merges and the
first parents of chains' first commits. What a commit reaches is then one number for each
chain: with a commit all older ones of its chain are reached; a round follows the leads
out of the stretches that were added, and there are as many rounds as branches nest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import materialize
from . import temporal


@dataclass(frozen=True)
class CommitIndex:
    """places: commit, chain, place (from 0, the oldest); leads: chain, place, to_chain, to_place."""

    places: DataFrame
    leads: DataFrame


def index(commits: DataFrame) -> CommitIndex:
    """commits: commit, parents (the first one first), committed_at. Parents that are not there end a history (a shallow one)."""
    known = materialize(commits.select("commit", "parents", "committed_at").dropDuplicates(["commit"]), "commits")
    there = known.select(F.col("commit").alias("parent"))
    links = materialize(known.select("commit", "committed_at", F.posexplode("parents").alias("at", "parent")).join(there, "parent", "left_semi"), "links")
    goes_on = Window.partitionBy("parent").orderBy(F.desc("committed_at"), "commit")
    first = links.where("at = 0").withColumn("turn", F.row_number().over(goes_on))
    older = materialize(first.where("turn = 1").select("commit", "parent"), "older")
    # pointers: after k rounds each says where 2^k steps back lead, or the chain's end and how far it is
    hops = materialize(known.select("commit").join(older, "commit", "left").select("commit", F.coalesce("parent", "commit").alias("back"), F.col("parent").isNotNull().cast("long").alias("steps")), "hops")
    while True:
        next_ = hops.select(F.col("commit").alias("back"), F.col("back").alias("further"), F.col("steps").alias("more"))
        doubled = materialize(hops.join(next_, "back").select("commit", F.col("further").alias("back"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")), "hops")
        if doubled.where("moved").isEmpty():
            break
        hops = doubled.drop("moved")
    places = materialize(hops.select("commit", F.col("back").alias("chain"), F.col("steps").alias("place")), "places")
    other = links.join(older, ["commit", "parent"], "left_anti").select("commit", "parent").distinct()
    to = places.select(F.col("commit").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    leads = other.join(places, "commit").join(to, "parent").select("chain", "place", "to_chain", "to_place")
    return CommitIndex(places, materialize(leads, "leads"))


def reached(graph: CommitIndex, ref: str) -> DataFrame:
    """(chain, upto): on each chain the newest commit that ``ref`` has among its ancestors, itself included."""
    upto = front = materialize(graph.places.where(F.col("commit") == ref).select("chain", F.col("place").alias("upto"), F.lit(-1).cast("long").alias("from")), "front")
    upto = upto.drop("from")
    while not front.isEmpty():
        out = graph.leads.join(front, "chain").where("place <= upto and place > from").groupBy(F.col("to_chain").alias("chain")).agg(F.max("to_place").alias("new"))
        front = materialize(out.join(upto, "chain", "left").where("upto is null or new > upto").select("chain", F.col("new").alias("upto"), F.coalesce("upto", F.lit(-1)).alias("from")), "front")
        upto = materialize(upto.join(front.select("chain"), "chain", "left_anti").unionByName(front.drop("from")), "upto")
    return upto


def ancestors(graph: CommitIndex, ref: str) -> DataFrame:
    """(commit): ``ref`` and all that it builds on; none if it is not known."""
    return graph.places.join(reached(graph, ref), "chain").where("place <= upto").select("commit")


def is_ancestor(graph: CommitIndex, old: str, ref: str) -> bool:
    """Whether ``ref`` builds on ``old``, or is it."""
    return not graph.places.where(F.col("commit") == old).join(reached(graph, ref), "chain").where("place <= upto").isEmpty()


def between(graph: CommitIndex, old: str, ref: str) -> DataFrame:
    """(commit): what ``ref`` builds on and ``old`` does not."""
    had = reached(graph, old).withColumnRenamed("upto", "had")
    return graph.places.join(reached(graph, ref), "chain").join(had, "chain", "left").where("place <= upto and (had is null or place > had)").select("commit")


def read_history(graph: CommitIndex, events: DataFrame, ref: str, since: Column) -> DataFrame:
    """Events (id, commit, parents, occurred_at, ...) of ``ref`` from ``since`` on, without merges."""
    return _plain(events, since).join(ancestors(graph, ref), "commit", "left_semi").select(events.columns)


def _plain(events: DataFrame, since: Column) -> DataFrame:
    return events.where((F.col("occurred_at") >= since) & (F.size("parents") < 2))


def update_history(graph: CommitIndex, events: DataFrame, previous: DataFrame | None, previous_ref: str | None, previous_days: int | None, ref: str, days: int, now: Column) -> tuple[DataFrame, bool]:
    """The history of ``ref`` within ``days`` before ``now``, and whether only what is new was read.

    With a previous result of the same window, from a ref that ``ref`` builds on, the events
    between the two are put before those kept; an event of both counts as the new one. Else,
    and whenever a ref is HEAD, which may have moved, all is read. Newest first, then by id.
    """
    if days <= 0:
        raise ValueError("the window must have a day at least")
    since = now - F.make_dt_interval(F.lit(days))
    order = [F.desc("occurred_at"), "id"]
    moved = previous is None or not previous_ref or "HEAD" in (previous_ref, ref) or previous_days != days
    if moved or not is_ancestor(graph, previous_ref, ref):
        return read_history(graph, events, ref, since).orderBy(*order), False
    fresh = _plain(events, since).join(between(graph, previous_ref, ref), "commit", "left_semi").select(previous.columns)
    return temporal.merge_history(previous, fresh, since), True
