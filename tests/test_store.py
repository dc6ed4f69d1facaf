"""The snapshot store: numbers, writers at once, writers that stop, chains of differences, removal."""

from __future__ import annotations

import threading

import pytest

from graphloom.sources import store as store_module
from graphloom.sources.log import CommitLog
from graphloom.sources.store import Store

DELTA = "what string, id string, status string, reasons string"


@pytest.fixture()
def nodes(spark):
    return lambda *ids: spark.createDataFrame([(x, "package", x.upper()) for x in ids], "id string, kind string, label string")


@pytest.fixture()
def delta(spark):
    return lambda *ids: spark.createDataFrame([("node", x, "added", "entity-added") for x in ids], DELTA)


def ids_of(df):
    return sorted(r.id for r in df.collect())


def test_numbers_never_come_back(spark, tmp_path, nodes, delta):
    kept = Store(spark, str(tmp_path))
    first = kept.save("r", "index", "c0", nodes=nodes("a"))
    pair = kept.save_pair("r", "v", ("c1", "c2"), {"nodes": nodes("a")}, {"nodes": nodes("a", "b")}, delta("b"))
    kept.save_review("r", "v", first, first, delta("x"))  # drops the pair, which nothing else refers to
    assert [r.snapshot_id for r in kept.snapshots().collect()] == [first] and pair == (2, 3)
    assert kept.compact(1) == []
    after = kept.save("r", "index", "c3", nodes=nodes("z"))
    assert after == 4 and kept.current("r") == 4 and ids_of(kept.load("nodes", "r", 4)) == ["z"]
    for gone in (*pair, 9):
        with pytest.raises(KeyError):
            kept.load("nodes", "r", gone)
    with pytest.raises(KeyError):
        kept.load("nodes", "other", 4)


def test_writers_at_once_share_no_number(spark, tmp_path, nodes, delta):
    told, errors = [], []

    def write(k):
        try:
            own = Store(spark, str(tmp_path))
            for j in range(3):
                told.append((own.save(f"r{k}", "index", f"{k}.{j}", nodes=nodes(f"n{k}{j}")), f"n{k}{j}", k))
            base, head = own.save_pair(f"r{k}", f"v{k}", ("b", "h"), {"nodes": nodes(f"b{k}")}, {"nodes": nodes(f"h{k}")}, delta(f"d{k}"))
            told.extend([(base, f"b{k}", k), (head, f"h{k}", k)])
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors and sorted(n for n, *_ in told) == list(range(1, 21))
    kept = Store(spark, str(tmp_path))
    for number, name, k in told:
        assert ids_of(kept.load("nodes", f"r{k}", number)) == [name]
    assert {r.review: r.head - r.base for r in kept.reviews().collect()} == {f"v{k}": 1 for k in range(4)}


def test_a_commit_has_one_number(spark, tmp_path):
    one, two = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    assert one.actions() == two.actions() == []
    assert one._put(0, [{"x": 1}]) and not two._put(0, [{"x": 2}])
    seen = []
    two.commit(lambda before: seen.append(len(before)) or [{"x": 3}])
    assert seen == [1] and one.actions() == [[{"x": 1}], [{"x": 3}]] and len(list(tmp_path.glob("_*"))) == 0


@pytest.mark.parametrize("stop", ["nodes", "edges", "delta", "commit"])
def test_a_writer_that_stops_leaves_the_state_whole(spark, tmp_path, nodes, delta, monkeypatch, stop):
    kept = Store(spark, str(tmp_path))
    first = kept.save("r", "index", "c0", nodes=nodes("a"))
    pair = kept.save_pair("r", "v", ("c1", "c2"), {"nodes": nodes("a")}, {"nodes": nodes("a", "b")}, delta("b"))
    reader = kept.delta("v")

    class Stop(Exception):
        pass

    def broken(*_, **__):
        raise Stop

    writer = Store(spark, str(tmp_path))
    if stop == "commit":
        monkeypatch.setattr(writer.log, "commit", broken)
    elif stop == "delta":
        monkeypatch.setattr(writer, "_delta", broken)
    else:
        monkeypatch.setattr(store_module, "PARTS", ("nodes", "edges") if stop == "edges" else ("nodes",))
        monkeypatch.setattr(writer.spark.read.__class__, "parquet", broken)
    with pytest.raises(Stop):
        writer.save_pair("r", "v", ("c3", "c4"), {"nodes": nodes("q"), "edges": nodes("e")}, {"nodes": nodes("q", "s")}, delta("s", "t"))
    monkeypatch.undo()
    again = Store(spark, str(tmp_path))
    assert [r.snapshot_id for r in again.snapshots().collect()] == [first, *pair]
    assert [tuple(r)[:4] for r in again.reviews().collect()] == [("v", "r", *pair)] and ids_of(again.delta("v")) == ids_of(reader) == ["b"]
    left = again.vacuum(hours=-1)
    assert left and again.vacuum(hours=-1) == [] and ids_of(again.load("nodes", "r", pair[1])) == ["a", "b"] and ids_of(again.delta("v")) == ["b"]


def test_readers_of_a_review_keep_what_they_read(spark, tmp_path, nodes, delta):
    kept = Store(spark, str(tmp_path))
    pair = kept.save_pair("r", "v", ("c1", "c2"), {"nodes": nodes("a")}, {"nodes": nodes("b")}, delta("b"))
    before = kept.delta("v")
    newer = kept.save_pair("r", "v", ("c1", "c3"), {"nodes": nodes("a")}, {"nodes": nodes("c")}, delta("c", "d"))
    assert ids_of(before) == ["b"] and ids_of(kept.delta("v")) == ["c", "d"]
    assert {r.snapshot_id for r in kept.snapshots().collect()} == set(newer) and not set(pair) & set(newer)


def test_chains_of_differences(spark, tmp_path):
    states = [{"a": 1, "b": 2}, {"a": 1, "b": 3, "c": None}, {"b": 3}, {"b": 3}, {}, {"a": 9, "b": None}] + [{f"n{k}": k, "a": 9} for k in range(8)]
    frame = lambda state: spark.createDataFrame([(k, "package", v) for k, v in state.items()], "id string, kind string, size long")
    kept, numbers = Store(spark, str(tmp_path)), []
    for state in states:
        numbers.append(kept.save("r", "index", "c", onto=numbers[-1] if numbers else None, nodes=frame(state), edges=frame(state)))
    told = kept._state()[0]
    assert [told[n]["base"] is None for n in numbers] == [k % store_module.CHAIN == 0 for k in range(len(states))]
    sizes = {r.snapshot_id: r.storage_bytes for r in kept.snapshots().collect()}
    assert sizes[numbers[3]] == 0
    whole = Store(spark, str(tmp_path / "whole"))
    for n, state in zip(numbers, states, strict=True):
        assert {(r.id, r.size) for r in kept.load("nodes", "r", n).collect()} == set(state.items())
    same = whole.save("r", "index", "c", nodes=frame(states[5]), edges=frame(states[5]))
    assert whole.fingerprint("r", same) == kept.fingerprint("r", numbers[5])
    assert kept.compact(1) == numbers[: store_module.CHAIN]  # the last one's chain stays
    last = kept.load("nodes", "r", numbers[-1])
    kept.vacuum(hours=-1)
    assert {(r.id, r.size) for r in last.collect()} == set(states[-1].items())
    with pytest.raises(KeyError):
        kept.save("r", "index", "c", onto=numbers[0], nodes=frame({}))
    other = kept.save("r", "index", "c", onto=numbers[-1], nodes=frame({"x": 1}))  # other parts: whole
    assert kept._state()[0][other]["base"] is None
