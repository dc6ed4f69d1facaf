from __future__ import annotations

import json
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import attention, dataflow, facts
from graphloom.sources import golang, repository, text

# A print shop: jobs wait in a queue, three workshops need one another, and the clerk chooses by many conditions.
QUEUE = """package queue

import "net/http"

// Next would "select id from nowhere", says this comment.
func Next(store Store) string {
	row := store.QueryRow("select id from waiting join printers using (printer_id)")
	if row == nil {
		return Idle()
	}
	return Title(row)
}

func Idle() string { return "delete from nowhere" }

func Title(row any) string {
	pageCache.MGet("job:7")
	sheets.MGet("job:8")
	return Idle() + Idle()
}

func Finish(consumer Consumer, store Store) {
	consumer.Subscribe("plates.worn")
	consumer.Subscribe("")
	store.NamedExec("delete from waiting where id = :id")
	http.NewRequest("PUT", "http://ops@floor.print.test:8080/bell", nil)
	postman.Head("http://nowhere.print.test")
}
"""
CLERK = "package clerk\n\nfunc Choose(n int) int {\n" + "".join(f"\tif n == {k} {{\n\t\treturn {k * k}\n\t}}\n" for k in range(16)) + "\treturn n\n}\n\nfunc hidden() { Choose(3) }\n"
WORKSHOPS = {"ink": ("Mix", "paper", "Feed"), "paper": ("Feed", "plate", "Etch"), "plate": ("Etch", "ink", "Mix")}
TREE = {
    "CODEOWNERS": "* @house\n/internal/ @floor\nclerk @desk @house\n*.proto @wire\n",
    "go.mod": "module print.test/press\n\ngo 1.23\n",
    "internal/queue/queue.go": QUEUE,
    "internal/clerk/clerk.go": CLERK,
    "e2e/night_test.go": 'package e2e\n\nimport (\n\t"testing"\n\n\tq "print.test/press/internal/queue"\n)\n\nfunc TestNight(t *testing.T) {\n\tif q.Next(nil) == "" {\n\t\tt.Fatal()\n\t}\n\tq.Next(nil)\n}\n',
    "cmd/press/press.go": 'package main\n\nimport "print.test/press/internal/clerk"\n\nfunc main() { println(clerk.Choose(2)) }\n',
    **{f"shop/{name}/{name}.go": f'package {name}\n\nimport "print.test/press/shop/{other}"\n\nfunc {own}() {{ {other}.{theirs}() }}\n' for name, (own, other, theirs) in WORKSHOPS.items()},
    "api/v1/jobs.proto": 'syntax = "proto3";\nmessage Job { string id = 1; } // one\n',
    "api/swagger.json": '{"swagger": "2.0", "paths": {}}',
    "api/notes.json": "{}",
    "cover.out": "mode: set\nprint.test/press/internal/queue/queue.go:6.31,8.16 2 1\nprint.test/press/internal/queue/queue.go:8.16,10.3 1 0\nprint.test/press/internal/queue/queue.go:14.22,14.53 1 1\nprint.test/press/internal/queue/queue.go:22.45,28.2 5 0\n",
    "vendor/gone/gone.go": "package (",
    ".cache/gone.go": "package (",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("press")
    for path, body in TREE.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(body)
    return str(top)


@pytest.fixture(scope="module")
def index(spark, root):
    made = repository.Index(repository.files(spark, root), "service:press", repository.module_name(root), repository.owners_text(root))
    return made.nodes().cache(), made.edges().cache(), made


def test_walk_skips_ignored_folders(root):
    assert repository.walk(root) == sorted(p for p in TREE if p.endswith((".go", ".proto", "swagger.json")) and "gone" not in p)


def test_files_are_also_read_in_parallel(spark, root):
    assert sorted(r.path for r in repository.files_of(spark, root).collect()) == repository.walk(root)


def test_index_of_a_repository(index):
    nodes, edges, _ = index
    label = {r.id: (r.kind, r.label) for r in nodes.collect()}
    assert len(label) == nodes.count()
    rows, told = edges.collect(), {}
    for r in rows:
        told.setdefault(r.kind, set()).add((label[r.source][1], *label[r.target], r.boundary))
    assert told["reads"] == {("Next", "table", "waiting", "persistence"), ("Next", "table", "printers", "persistence"), ("Title", "cache", "job:7", "persistence")}
    assert told["writes"] == {("Finish", "table", "waiting", "persistence")}
    assert told["consumes"] == {("Finish", "topic", "plates.worn", "async")} and "publishes" not in told
    assert told["tests"] == {("TestNight", "function", "Next", None)}
    within = {(a, b) for a, kind, b, _ in told["calls"] if kind == "function"}
    assert within == {("Next", "Idle"), ("Next", "Title"), ("Title", "Idle"), ("hidden", "Choose"), ("main", "Choose"), ("Mix", "Feed"), ("Feed", "Etch"), ("Etch", "Mix")}
    assert ("Finish", "external", "floor.print.test:8080", "network") in told["calls"] and not any("nowhere" in b for found in told.values() for _, _, b, _ in found)
    needs = {(a, b) for a, _, b, _ in told["depends_on"]}
    assert {(f"shop/{name}", f"shop/{other}") for name, (_, other, _) in WORKSHOPS.items()} | {("e2e", "internal/queue"), ("cmd/press", "internal/clerk")} <= needs
    assert {b for a, kind, b, _ in told["owns"] if kind == "contract"} == {"jobs.proto", "swagger.json"} and ("internal/queue", "function", "Title", None) in told["owns"]
    seen = {(label[r.source][1], label[r.target][1]): r.observations for r in rows if r.kind in ("calls", "tests")}
    assert seen["Title", "Idle"] == 2 and seen["TestNight", "Next"] == 2 and seen["Next", "Idle"] == 1
    owners = {r.label: r.owners for r in nodes.where("kind = 'package' and not external").collect()}
    assert owners["internal/queue"] == ["@floor"] and owners["internal/clerk"] == ["@desk", "@house"] and owners["shop/ink"] == ["@house"]


def test_rules_of_a_repository(index):
    nodes, edges, _ = index
    label = {r.id: r.label for r in nodes.collect()}
    found = {(r.rule, label.get(r.node, ""), r.detail) for r in repository.violations(nodes, edges, "there").collect()}
    rules = {rule: {n for r, n, _ in found if r == rule} for rule, _, _ in found}
    assert rules == {"cycle": {min((i, n) for i, n in label.items() if n.startswith("shop/"))[1]}, "untested-export": {"Finish", "Choose", "Mix", "Feed", "Etch"}, "cyclomatic": {"Choose"}}
    assert [d.count(",") for r, _, d in found if r == "cycle"] == [2] and ("cyclomatic", "Choose", "17") in found
    assert ("no-owners-file", "service:press") in {(r.rule, label[r.node]) for r in repository.violations(nodes, edges, "").collect()}


def test_coverage_of_a_repository(spark, root, index):
    blocks = text.read_coverage(spark, f"{root}/cover.out", root, "print.test/press")
    symbols = index[2].symbols().select("id", "file", "label", F.col("line").alias("first_line"), F.col("end_line").alias("last_line"))
    names = {r.id: r.label for r in symbols.collect()}
    told = {names[r.id]: (r.status, r.percent) for r in facts.coverage_rollup(blocks.select("file", "start_line", "statements", "hits"), symbols.drop("label")).collect()}
    assert told == {"Next": ("partial", 66), "Idle": ("covered", 100), "Finish": ("uncovered", 0)}
    bad = Path(root, "worse.txt")
    bad.write_text("mode: count\nno profile at all\n")
    with pytest.raises(Exception, match="invalid coverage"):
        text.read_coverage(spark, str(bad)).collect()


def test_telemetry_tells_zero_from_absent(spark, tmp_path, index):
    nodes = index[0]
    path = tmp_path / "telemetry.json"

    def read(items):
        path.write_text(json.dumps(items))
        return text.read_telemetry(spark, str(path), nodes).collect()

    one = {"label": "Finish", "file": "internal/queue/queue.go", "window": "1h", "source": "logbook"}
    assert read([one | {"rpm": 0}])[0].trafficObserved and not read([one | {"p99": 184}])[0].trafficObserved
    for broken, what in (({"label": "Nobody"}, "no node"), ({"window": ""}, "required"), ({}, "metric")):
        with pytest.raises(Exception, match=what):
            read([one | broken | ({"rpm": 1} if broken else {})])


ROUTES = """package web
import ("net/http"; echo "github.com/labstack/echo/v4")
type Server struct{}
func (s *Server) List(w http.ResponseWriter, r *http.Request) {}
func Health() {}
func Register(router *Router, e *echo.Echo) {
  s := &Server{}
  router.GET("/health", Health)
  api := router.Group("/api")
  api.POST("/items", s.List)
  group := api.Group("/v2/")
  group.DELETE("/items/{id}", func() {})
  router.Group("/chain").PUT("x", nil)
  http.HandleFunc("/plain", s.List)
  e.GET("/echo", s.List, auth)
  cache.GET("/not-a-route", Health)
  if a := 1; a > 0 && a < 3 || true { switch x := y.(type) { case int: default: } }
}
"""


def test_routes_and_handlers(spark):
    made = repository.Index(spark.createDataFrame([("web/web.go", ROUTES)], "path string, content string"), "service:w")
    label = {r.id: r.label for r in made.symbols().collect()}
    found = {(r.label, label[r.handler]) for r in made.endpoints().collect()}
    assert found == {("GET /health", "Health"), ("POST /api/items", "Server.List"), ("DELETE /api/v2/items/{id}", "Register"), ("HTTP /plain", "Server.List"), ("GET /echo", "Server.List")}
    assert {r.label: r.cyclomatic for r in made.symbols().collect()}["Register"] == 6


FLEET = {
    "lamp/lamp.go": "package lamp\ntype Lamp struct{ wick Wick }\ntype Wick struct{}\nfunc New() *Lamp { return nil }\nfunc (l *Lamp) Light() { l.wick.Burn() }\nfunc (w Wick) Burn() {}\n",
    "fleet/boat.go": """package fleet

import "keep.test/light/lamp"

type Boat struct {
	Name string `json:"name"`
	lamp *lamp.Lamp
	crew []*Sailor
	Log, Spare Book
	holds map[string][]Box
}

type (
	Sailor struct{ Hat Hat }
	Hat    struct{}
	Book   struct{}
	Box    struct{}
)

type List[T any] struct{ items []T }

func (b *Boat) First() (*Sailor, error)              { return b.crew[0], nil }
func (b *Boat) Go()                                  {}
func (h Hat) Wear()                                  {}
func (b Book) Write(s string)                        {}
func (b Box) Open()                                  {}
func Load(names ...string) (boat *Boat, err error) { return nil, nil }
""",
    "fleet/sail.go": """package fleet

import "keep.test/light/lamp"

func Range(boats []*Boat) {
	for _, boat := range boats {
		boat.Go()
	}
}
func Field(b *Boat)   { b.lamp.Light() }
func Result(b *Boat)  { s, err := b.First(); s.Hat.Wear(); err.Error() }
func Function()       { b, _ := Load("a"); b.Go() }
func Package()        { l := lamp.New(); l.Light() }
func Nested(b *Boat)  { for _, x := range b.holds["a"] { x.Open() } }
func Copied(b *Boat)  { m := b.Spare; m.Write("y") }
func Unknown(b *Boat) { b.Name.Go(); other.lamp.Light(); b.crew[0].Hat.Wear() }
""",
}


def test_calls_on_fields_elements_and_results_resolve(spark):
    made = repository.Index(spark.createDataFrame(list(FLEET.items()), "path string, content string"), "service:light", "keep.test/light")
    label = {r.id: r.label for r in made.symbols().collect()}
    found = {(label[r.caller], label[r.found]) for r in made.followed().collect()}
    want = {("Range", "Boat.Go"), ("Field", "Lamp.Light"), ("Result", "Hat.Wear"), ("Function", "Boat.Go"), ("Package", "Lamp.Light"), ("Nested", "Box.Open"), ("Copied", "Book.Write"), ("Lamp.Light", "Wick.Burn")}
    assert found == want, found ^ want
    edges = {(label.get(r.source), label.get(r.target)) for r in made.call_edges().collect()}
    assert want <= edges and ("Package", "New") in edges


def test_scanner_refuses_broken_files():
    for source in ("func x() {}", "package p\nfunc x() {", "package p\nvar a = `x"):
        with pytest.raises(golang.GoSyntaxError):
            golang.File("a.go", source).read()


def test_scanner_reads_generic_and_grouped_declarations():
    rows = golang.File("a.go", 'package p\nimport x "a/b/v2"\nimport "c/d/v3"\nfunc Map[T any, U any](a, b []T, f func(T) U) (out []U, err error) { return f2[T](a) }\nfunc (l *List[T]) Len() int { return l.n.Size() }\nfunc outside()\nfunc After() struct{ A int } { var q x.Thing; q.Do("z") ; return y }\n').read()
    names = {r["name"]: r for r in rows if r["row"] == "func"}
    assert list(names) == ["Map", "List.Len", "outside", "After"]
    assert {r["alias"]: r["target"] for r in rows if r["row"] == "import"} == {"x": "a/b/v2", "d": "c/d/v3"}
    assert [(r["target"], r["values"]) for r in rows if r["row"] == "call" and r["owner"] == "After"] == [("a/b/v2|Thing|Do", ["z"])]


@pytest.mark.parametrize(
    ("path", "owners"),
    [("notes.txt", ["@keepers"]), ("lamp/east/glass.go", ["@glaziers", "@keepers"]), ("glass.go", ["@keepers"]), ("coast/sea/reef.txt", ["@divers"]), ("sea/north.chart", ["@cartographers"])],
)
def test_last_owner_rule_wins(spark, path, owners):
    rules = text.owner_rules(spark, "* @keepers\n/lamp/**/glass.go @glaziers @keepers\n\n# the water\nsea/ @divers\n*.chart @cartographers\n!y @nobody\nbare\n")
    assert facts.last_owner_match(spark.createDataFrame([(path,)], "path string"), rules).collect()[0].owners == owners


@pytest.mark.parametrize(
    ("glob", "hit", "miss"),
    [("docs", "a/docs/b.md", "docsx/a"), ("/docs", "docs/b", "a/docs/b"), ("apps/", "x/apps/a/b", "apps"), ("a/*.go", "a/b.go", "a/c/b.go"), ("a/**/z", "a/b/c/z", "b/a/z"), ("?.md", "a.md", "ab.md")],
)
def test_owner_globs(glob, hit, miss):
    import re

    pattern = re.compile(text.owner_pattern(glob))
    assert pattern.search(hit) and pattern.match(hit) and not pattern.match(miss)


LOG = "commit:f00d\t2025-03-09T21:30:00-02:30\tMate@Keep.Test\tcafe beef\tMove the lamp\n\n7\t4\tlamp/{east => west}/glass.go\n300\t1\tsignals/horn.pb.go\n-\t-\tview.jpg\n"


def test_git_log(spark, tmp_path):
    mass = "commit:face\t2025-03-10T00:00:00Z\tx@y\t\n" + "".join(f"0\t0\tdeck{k}.go => hold{k}.go\n" for k in range(20)) + "1\t0\tREADME.md\n"
    (tmp_path / "log.txt").write_text(LOG + mass)
    events = {r.commit: r for r in text.read_git_log(spark, str(tmp_path / "log.txt")).collect()}
    moved = events["f00d"]
    assert moved.id == "git:f00d" and str(moved.occurredAt) == "2025-03-10 00:00:00" and moved.parents == ["cafe", "beef"] and len(moved.files) == 2
    assert (moved.files[0].oldPath, moved.files[0].path, moved.files[0].rename) == ("lamp/east/glass.go", "lamp/west/glass.go", True)
    assert moved.files[1].generated and moved.files[1].excluded and not moved.refactorNoise
    assert events["face"].refactorNoise and events["face"].files[-1].excluded and events["face"].files[3].path == "hold3.go"
    import hashlib

    assert moved.authorKey == hashlib.sha256(b"mate@keep.test").hexdigest()[:16]
    flat = text.event_files(spark.createDataFrame(list(events.values())), spark.createDataFrame([("lamp/west/glass.go", "u")], "path string, unit string"))
    assert attention.velocity(flat, "2025-03-10 00:00:00", 30).collect()[0].churn == 11
    (tmp_path / "bad.txt").write_text("commit:f00d and no more\n")
    with pytest.raises(Exception, match="invalid Git"):
        text.read_git_log(spark, str(tmp_path / "bad.txt")).collect()


def test_contract_shapes():
    shape = dict(text.contract_shape("a.yaml", "a: {b/c: [1, 2.5, true, null], d~: x}\n"))
    assert shape == {"/a/b~1c/0": "number:1", "/a/b~1c/1": "number:2.5", "/a/b~1c/2": "bool:true", "/a/b~1c/3": "null", "/a/d~0": "string:x"}
    assert dict(text.contract_shape("x.proto", "syntax; // note\n\n message A {}\n")) == {"/0": "string:syntax;", "/1": "string:message A {}"}
    assert [text._number(x) for x in (1.0, 0.1, 1e21, 1e20, 1e-5, 123456.75, 1e6, 1234567.5, -2e6)] == ["1", "0.1", "1e+21", "1e+20", "1e-05", "123456.75", "1e+06", "1.2345675e+06", "-2e+06"]
    assert [text.contract_type(n) for n in ("openapi.yaml", "a.swagger.json", "asyncapi.yml", "x.proto", "x.json")] == ["openapi", "openapi", "kafka", "grpc", None]


def test_calls_have_one_class(spark):
    rows = [
        (1, "db", "Query", ["x", "select a from b join c.d on x"], False), (2, "kafkaProducer", "Send", ["a b", "orders"], False), (3, "redisCache", "MGet", ["k"], False), (4, "cache", "Get", ["from t"], False),
        (5, "httpClient", "Post", ["http://u@host:8080/x?y"], False), (6, "q", "Consume", ["t"], False), (7, "other", "Send", ["t"], False), (8, "h", "Get", ["https://pkg.example"], True), (9, "cache", "Del", ["k2"], False),
    ]
    found = {(r.id, r.kind, r.target_kind, r.target, r.boundary) for r in dataflow.classify_calls(spark.createDataFrame(rows, "id int, receiver string, method string, values array<string>, http boolean")).collect()}
    assert found == {
        (1, "reads", "table", "b", "persistence"), (1, "reads", "table", "c.d", "persistence"), (2, "publishes", "topic", "orders", "async"), (3, "reads", "cache", "k", "persistence"), (4, "reads", "table", "t", "persistence"),
        (5, "calls", "external", "host:8080", "network"), (6, "consumes", "topic", "t", "async"), (8, "calls", "external", "pkg.example", "network"), (9, "writes", "cache", "k2", "persistence"),
    }


def test_trees_of_commits_leave_the_working_tree_alone(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.go").write_text("package a\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.go").write_text("package b\n")
    with repository.tree_of(str(tmp_path), "HEAD") as tree:
        assert Path(tree, "a.go").read_text() == "package a\n" and (tmp_path / "a.go").read_text() == "package b\n"
    assert not Path(tree).exists() and [tuple(r) for r in repository.files_at(spark, str(tmp_path), "HEAD").collect()] == [("a.go", "package a\n")]
    with repository.tree_of(str(tmp_path), "WORKTREE") as tree:
        assert tree == str(tmp_path) and len(repository.head_commit(str(tmp_path))) == 40


def test_head_is_known_without_git(tmp_path, monkeypatch):
    def none(*a, **k):
        raise OSError("no git here")

    monkeypatch.setattr(repository.subprocess, "run", none)
    folder = tmp_path / ".git"
    assert repository.head_commit(str(tmp_path)) == ""
    (folder / "refs" / "heads").mkdir(parents=True)
    (folder / "HEAD").write_text("ref: refs/heads/dusk\n")
    assert repository.head_commit(str(tmp_path)) == ""
    (folder / "packed-refs").write_text("# pack-refs with: peeled\nbeef refs/heads/dawn\ncafe refs/heads/dusk\n")
    assert repository.head_commit(str(tmp_path)) == "cafe"
    (folder / "refs" / "heads" / "dusk").write_text("f00d\n")
    assert repository.head_commit(str(tmp_path)) == "f00d"
    (folder / "HEAD").write_text("face\n")
    assert repository.head_commit(str(tmp_path)) == "face"
