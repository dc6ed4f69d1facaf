"""Velocity of change as a stream: the sums of ``attention.velocity``, kept by unit.

Each unit's state has a row for each day of the window: the decayed sums of the day, as of
its end, and a row for each author: the last day. A timer for each day deletes it once the
watermark has left it behind the window, so states stay as small as the window. Events of
one change set must come in one row (``change_sets`` makes them), each once.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.predicates import architecture_bearing, is_generated, is_plain
from ..operators.attention import HALF_LIFE, MOST_LINES, NOISE

DAY_US = 86_400_000_000
OUT = "unit string, as_of_day long, churn double, change_sets double, topology double, weeks long, authors long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change_sets(files: DataFrame) -> DataFrame:
    """(unit, at, author, lines, bears, noise) of change events, each event one file (id, occurred_at, author, unit, path, lines).

    Generated and plain files and renames without changed lines are left out, as in the batch operator.
    """
    kept = files.where(~is_generated(F.col("path")) & ~is_plain(F.col("path")))
    if "rename" in files.columns:
        kept = kept.where(~(F.coalesce("rename", F.lit(False)) & (F.col("lines") == 0)))
    noise = F.when(F.col("noise"), NOISE).otherwise(1.0) if "noise" in files.columns else F.lit(1.0)
    return kept.select("unit", F.col("occurred_at").cast("timestamp").alias("at"), "author", F.least(F.col("lines"), F.lit(MOST_LINES)).cast("double").alias("lines"), architecture_bearing(F.col("path")).alias("bears"), noise.alias("noise"))


class _ByUnit(StatefulProcessor):
    """Sums by day and last days of authors; the report of a unit is as of midnight after its newest event, or a given one."""

    def __init__(self, days: int, as_of: int | None):
        self.days, self.as_of = days, as_of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "day long", "churn double, change_sets double, topology double")
        self.people = handle.getMapState("people", "author string", "day long")

    def _add(self, rows: pd.DataFrame) -> None:
        micros = rows["at"].astype("datetime64[us]").astype("int64")
        day = micros // DAY_US
        weight = (-math.log(2) / HALF_LIFE * ((day + 1) * DAY_US - micros) / DAY_US).map(math.exp) * rows["noise"]
        told = pd.DataFrame({"day": day, "churn": rows["lines"] * weight, "change_sets": weight, "topology": weight.where(rows["bears"], 0.0)})
        for at, own in told.groupby("day").sum().iterrows():
            before = self.sums.getValue((int(at),)) or (0.0, 0.0, 0.0)
            if not self.sums.containsKey((int(at),)):
                self.handle.registerTimer(int((at + 1 + self.days) * DAY_US // 1000))
            self.sums.updateValue((int(at),), tuple(float(a) + float(b) for a, b in zip(before, own[["churn", "change_sets", "topology"]], strict=True)))
        for author, at in day.groupby(rows["author"]).max().items():
            last = self.people.getValue((author,))
            if last is None or last[0] < at:
                self.people.updateValue((author,), (int(at),))

    def _report(self, unit: str) -> Iterator[pd.DataFrame]:
        days = {int(k[0]): v for k, v in self.sums.iterator()}
        now = self.as_of if self.as_of is not None else max(days, default=-1) + 1
        within = {d: v for d, v in days.items() if now - self.days <= d}
        decayed = [math.exp(-math.log(2) / HALF_LIFE * max(0, now - d - 1)) for d in within]
        sums = [sum(v[k] * w for v, w in zip(within.values(), decayed, strict=True)) for k in range(3)]
        weeks = {datetime.date.fromordinal(d + datetime.date(1970, 1, 1).toordinal()).isocalendar()[:2] for d in within}
        authors = sum(now - self.days <= int(v[0]) for _, v in self.people.iterator())
        if within:
            yield pd.DataFrame({"unit": [unit], "as_of_day": [now], "churn": [sums[0]], "change_sets": [sums[1]], "topology": [sums[2]], "weeks": [len(weeks)], "authors": [authors]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            self._add(frame)
        yield from self._report(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        left = expiredTimerInfo.getExpiryTimeInMs() * 1000 // DAY_US - self.days
        for day in [int(k[0]) for k in self.sums.keys() if int(k[0]) < left]:
            self.sums.removeKey((day,))
        for author in [k[0] for k, v in self.people.iterator() if int(v[0]) < left]:
            self.people.removeKey((author,))
        yield from self._report(key[0])

    def close(self) -> None:
        pass


def velocity(files: DataFrame, days: int, as_of: datetime.date | None = None, late: str = "1 day") -> DataFrame:
    """The stream of each unit's velocity, anew whenever it has new change sets or a day leaves the window.

    ``as_of``, a date, fixes the midnight that ages are counted to; then no event may be later.
    Events later than the watermark by ``late`` are dropped. The session's state store must be
    RocksDB (PROVIDER, ROCKS). Write it with output mode update; the newest row of a unit holds.
    """
    midnight = None if as_of is None else as_of.toordinal() - datetime.date(1970, 1, 1).toordinal()
    rows = change_sets(files).where("unit is not null").withWatermark("at", late)
    return rows.groupBy("unit").transformWithStateInPandas(_ByUnit(days, midnight), OUT, "Update", "EventTime")


def once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a velocity stream over all that is there now and stop; the newest row of each unit."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
    names = [c.split()[0] for c in OUT.split(", ")]
    rows = stream.sparkSession.read.schema(f"{OUT}, batch int").parquet(path)
    return rows.groupBy("unit").agg(F.max_by(F.struct(*names[1:]), F.struct("batch", "as_of_day")).alias("x")).select("unit", "x.*")
