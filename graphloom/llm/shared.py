"""Scratch tables in the folder that all executors share, and slices of record batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from graphloom.plans.scratch import materialize, scratch_path, shared_dir

__all__ = ["held", "map_batches", "materialize", "scratch_path", "shared_dir", "slices"]

#: Rows and bytes of a record batch at most (a row that passes the bytes ends its batch): texts pass between Spark and
#: Python in batches, which executors hold beside the heap.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
BYTES_SETTING, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

#: What a worker remembers from task to task, by the module of its operator.
_held: dict[str, tuple] = {}


def held(make: Callable, *args: Any) -> Any:
    """``make(*args)``, kept by a worker until a task of another operator begins: workers outlive the stages of a job."""
    owner, key = make.__module__, (make, args)
    if owner not in _held or _held[owner][0] != key:
        _held.pop(owner, None)
        _held[owner] = (key, make(*args))
    return _held[owner][1]


def _alone(owner: str, batches: Iterator[pa.RecordBatch], change: Callable) -> Iterator[pa.RecordBatch]:
    for other in _held.keys() - {owner}:
        del _held[other]
    yield from change(batches)


def _bytes(told: str) -> int:
    """Of a size as Spark's settings have it: 64m, 2kb, 1000b, 1000."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", told.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def map_batches(df: DataFrame, change: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in a session whose record batches have BATCH rows and about BYTES bytes at most; smaller settings stay.

    What the worker holds for other operators is dropped before.
    """
    conf, owner = df.sparkSession.conf, change.__module__
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH:
        conf.set(BATCH_SETTING, str(BATCH))
    if not 0 < _bytes(conf.get(BYTES_SETTING)) <= BYTES:
        conf.set(BYTES_SETTING, str(BYTES))
    return df.mapInArrow(lambda batches: _alone(owner, batches, change), schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
