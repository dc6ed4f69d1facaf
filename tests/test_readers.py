"""Flattened JSON, owner rules of many repositories, and the velocity stream."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import random
import re

import pytest

from graphloom.operators import attention, owners
from graphloom.sources import flatten, text
from graphloom.streaming import velocity


def leaves(value, path="/"):
    if isinstance(value, dict | list):
        items = value.items() if isinstance(value, dict) else enumerate(value)
        return [x for k, v in items for x in leaves(v, ("" if path == "/" else path) + "/" + str(k).replace("~", "~0").replace("/", "~1"))]
    if value is None:
        return [(path, "null")]
    if isinstance(value, bool):
        return [(path, f"bool:{str(value).lower()}")]
    if isinstance(value, str):
        return [(path, f"string:{value}")]
    shown = format(decimal.Decimal(repr(float(value))).normalize(), "e")
    digits, _, power = shown.partition("e")
    if value and not -4 <= int(power) < 6:
        return [(path, f"number:{digits}e{power[0]}{power[1:].zfill(2)}")]
    return [(path, f"number:{format(decimal.Decimal(repr(float(value))).normalize() + 0, 'f')}")]


def test_leaves_of_json(spark):
    deep = {"x": 1}
    for k in range(12):
        deep = {f"k{k}": [deep, k]}
    documents = [
        {"a": {"b/c": [1, 2.5, True, None], "d~": "x", "": {"y": 0}}, "e": {}, "f": [], "g": [[], [[7]]]}, [], {}, "alone", 5, None, True, [None, "~/", {"k": [False]}], deep,
        {"n": [0.1, 1e-4, 9.9e-5, 1e20, 1e21, 123456789012, 999999.5, 1e6, 1234567.25, 9999999, 1e7, 1.5e300, -2.25, 1e-7, 100, 0.00012345678901234567, 12345678901234567890, -0.5, 3.0]},
    ]
    rows = [(k, json.dumps(d), "z") for k, d in enumerate(documents)] + [(99, None, "z")]
    got = flatten.flatten_json(spark.createDataFrame(rows, "path long, content string, value string").selectExpr("path AS id", "content", "value AS c0"))
    assert got.columns == ["id", "c0", "path", "value"]
    assert sorted((r.id, r.path, r.value) for r in got.collect()) == sorted((k, *x) for k, d in enumerate(documents) for x in leaves(d))
    with pytest.raises(Exception, match="(?i)malformed"):
        flatten.flatten_json(spark.createDataFrame([(1, '{"a": ')], "id long, content string")).collect()


def test_contract_files_of_all_kinds(spark):
    files = spark.createDataFrame([("api/openapi.json", '{"a": {"t": 1}}'), ("x/asyncapi.yml", "a: [x]"), ("m.proto", "message A {} // b"), ("other.json", "no")], "path string, content string")
    assert {(r.name, r.type, r.path, r.value) for r in text.contract_fields(files).collect()} == {("api/openapi.json", "openapi", "/a/t", "number:1"), ("x/asyncapi.yml", "kafka", "/a/0", "string:x"), ("m.proto", "grpc", "/0", "string:message A {}")}


GLOBS = ["*", "*.go", "/a/", "a", "a/", "a/b", "/a/*.go", "a/**/z.go", "**/b/*", "/a/b?/x.go", "b*", "x.go", "/", "!a", "", "a+b", "/a/**", "*.tar.gz", "*/b/", "**", "a.go/", "?.go", "/**/z.go", "b/*", "c d", "[a]"]
PARTS = ["a", "b", "b1", "a+b", "c", "c d", "[a]", "axb"]
FILES = ["x.go", "z.go", "y.sql", "k.tar.gz", "a", "b", "axgo", "a.go"]


def test_owners_of_many_repositories(spark):
    rng = random.Random(2)
    paths = sorted({"/".join([*rng.choices(PARTS, k=rng.randrange(4)), rng.choice(FILES)]) for _ in range(160)} | {"./a/x.go"})
    repositories = {f"r{k}": [(n, rng.choice(GLOBS), f"@{n}") for n in range(9)] for k in range(6)} | {f"one{n}": [(0, g, "@g")] for n, g in enumerate(GLOBS)}
    files = spark.createDataFrame([(r, p) for r in repositories for p in paths], "repository string, path string")
    rules = spark.createDataFrame([(r, *x) for r, lines in repositories.items() for x in lines], "repository string, rule_no int, glob string, owners string")
    want = {}
    for r, lines in repositories.items():
        for _, glob, owner in lines:
            pattern = text.owner_pattern(glob)
            for p in paths if pattern else ():
                if re.match(pattern, p.removeprefix("./"), re.S):
                    want[r, p] = owner
    found = owners.owners_of(files, rules)
    assert {(r.repository, r.path): r.owners for r in found.collect()} == want and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_velocity_as_a_stream(spark, tmp_path):
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"g{k}", start + datetime.timedelta(minutes=rng.randrange(k * 55, k * 55 + 400)), f"a{rng.randrange(6)}", f"u{rng.randrange(3)}", rng.choice(["x.go", "x.sql", "x.md", "y.pb.go"]), rng.randrange(2000), rng.random() < 0.1) for k in range(700)]
    schema = "id string, occurred_at timestamp, author string, unit string, path string, lines long, noise boolean"
    rows.sort(key=lambda r: r[1])
    for part in range(4):
        spark.createDataFrame(rows[part * 175 : (part + 1) * 175], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    last = max(r[1] for r in rows if r[4] in ("x.go", "x.sql"))
    now = datetime.date(last.year, last.month, last.day) + datetime.timedelta(days=1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    got = {r.unit: r for r in velocity.once(velocity.velocity(stream, 9, now, "1 day"), str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    whole = {r.unit: r for r in attention.velocity(spark.createDataFrame(rows, schema), f"{now} 00:00:00", 9).collect()}
    assert set(got) == set(whole) == {"u0", "u1", "u2"}
    assert spark.read.schema(f"{velocity.OUT}, batch int").parquet(str(tmp_path / "out")).select("batch").distinct().count() > 2
    for unit, row in whole.items():
        assert (got[unit].weeks, got[unit].authors) == (row.weeks, row.authors)
        assert all(math.isclose(got[unit][c], row[c], rel_tol=1e-9) for c in ("churn", "change_sets", "topology"))
