"""The engine on small source trees, and the parts that SQL doesn't reach."""

import itertools
import json
import random

import pytest
import yaml
from pyspark.sql import functions as F

from sinkweave.functions import helpers as h
from sinkweave.operators import link, paths, render, report, traces
from sinkweave.operators.extract import ast_dump, extract_file
from sinkweave.plans.engine import Engine, Options
from sinkweave.sources import scan, sinks
from sinkweave.sources.catalog import builtin_catalog, catalog_frame, normalized_sink

PY = """import os
from flask import Flask
app = Flask(__name__)

@app.route('/run')
def run():
    cmd = request.args['c']
    return helper(cmd)

class Store:
    x = make()

    def save(self, q):
        cursor.execute(f"insert {q}")

def helper(c):
    os.system(c)
    Store().save(c)
"""
JS = """app.get('/x', (req, res) => { doIt(req.query.q); });
app.post('/y', handler);
function handler(req, res) { // eval(no)
  db.query("select " + req.body.id);
}
class Foo {
  bar(a) { return eval(`x ${a}`); }
}
"""
PHP = """<?php
Route::get('/u', function() { return $_GET['x']; });
require_once 'a.php'; // include 'no.php'
class C { public function m($a) { mysqli_query($c, "select " . $_POST['a']); $pdo->query($a); } }
"""
JAVA = """public class B {
  @GetMapping("/x")
  public String run(String a) throws IOException { Runtime.getRuntime().exec(a + "x"); return h(a); }
  private String h(String s) { if (s != null) { new ProcessBuilder(s).start(); } return s; }
}
"""
GO = """package main
func main() { http.HandleFunc("/x", serve) }
func (s *T) Do(a string) { exec.Command("sh" + a) }
func serve(w http.ResponseWriter, r *http.Request) { db.Query(r.FormValue("a")) }
"""
RUBY = """class U
  def show
    system("ls #{params[:a]}")
    helper(1)
  end
end
def helper(x)
  eval(x)
end
"""
CS = """class P {
  [HttpGet("x")]
  public IActionResult Go(string a) { Process.Start(a); return View(); }
}
"""
FILES = [("r", "app/views.py", "python", PY), ("r", "srv/routes.js", "javascript", JS), ("r", "index.php", "php", PHP), ("r", "a/B.java", "java", JAVA), ("r", "m/main.go", "go", GO), ("r", "a.rb", "ruby", RUBY), ("r", "P.cs", "c_sharp", CS)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "repo string, path string, lang string, text string")


@pytest.mark.parametrize(
    "k, nodes, edges, entries",
    [
        (0, {"app.views.run", "app.views.Store.save", "app.views.helper"}, {("app.views.run", "helper"), ("app.views.Store", "make"), ("app.views.Store.save", "cursor.execute"), ("app.views.helper", "os.system")}, {"app.views.run"}),
        (1, {"srv.routes.handler", "srv.routes.Foo.bar", "srv.routes.<anon@1>"}, {("srv.routes.handler", "db.query"), ("srv.routes.Foo.bar", "eval")}, {"srv.routes.handler", "srv.routes.<anon@1>", "srv.routes.<global>"}),
        (2, {"index.C.m", "index.<anon@2>"}, {("index.C.m", "mysqli_query"), ("index.C.m", "$pdo.query"), ("index.<global>", "require_once")}, {"index.<anon@2>", "index.<global>"}),
        (3, {"a.B.B.run", "a.B.B.h"}, {("a.B.B.run", "Runtime.getRuntime.exec"), ("a.B.B.run", "h"), ("a.B.B.h", "ProcessBuilder")}, {"a.B.B.run"}),
        (4, {"m.main.Do", "m.main.serve"}, {("m.main.Do", "exec.Command"), ("m.main.serve", "db.Query")}, {"m.main.serve", "m.main.<global>"}),
        (5, {"a.U.show", "a.helper"}, {("a.U.show", "system"), ("a.helper", "eval")}, set()),
        (6, {"P.P.Go"}, {("P.P.Go", "Process.Start")}, {"P.P.Go"}),
    ],
)
def test_extraction(k, nodes, edges, entries):
    f = extract_file(*FILES[k])
    assert nodes <= {n["uid"] for n in f.nodes}
    assert edges <= {(e["src"], e["callee"]) for e in f.edges}
    assert {n["uid"] for n in f.nodes if n["is_entry"]} == entries
    assert not {"eval", "include"} & {e["callee"] for e in f.edges if e["line"] == 3}


def test_broken_files_have_no_rows():
    for lang in ("python", "javascript", "php", "java", "go", "ruby", "c_sharp", "cobol"):
        for text in ("", "def (", "}}}{{{", "\x00", "'" * 50, "/* never", "(" * 500):
            extract_file("r", "x", lang, text)


def test_engine_end_to_end(spark, files, tmp_path):
    engine = Engine(spark, files, Options(config={"function_patterns": ["^run$"]}))
    found = {(r["head"], r["sink"], tuple(r["path"])) for r in engine.paths.collect()}
    assert ("app.views.run", "builtin.python.os.system", ("app.views.run", "app.views.helper", "builtin.python.os.system")) in found
    assert {h for h, _, _ in found} <= {"app.views.run", "a.B.B.run", "index.<global>", "index.C.m", "index.<anon@2>"}
    assert ("a.B.B.run", "builtin.java.Runtime.getRuntime.exec", ("a.B.B.run", "builtin.java.Runtime.getRuntime.exec")) in found
    texts = {r["trace_id"]: r["text"] for r in engine.rendered().collect()}
    kept = engine.traces.collect()
    assert sorted(texts) == sorted(r["trace_id"] for r in kept) == list(range(1, len(kept) + 1))
    for r in kept:
        (root,) = yaml.safe_load(texts[r["trace_id"]])
        depth, node = 1, root
        while node.get("calls"):
            depth, node = depth + 1, node["calls"][0]
        assert depth == len(r["path"]) and root["function"].split(" ")[0] == r["path"][0].rsplit(".", 1)[-1]
    assert engine.verdicts().count() == len(kept)
    engine.register("t_")
    assert spark.sql("SELECT count(*) FROM t_traces").first()[0] == len(kept)
    sinks.export_texts(engine.rendered("flat"), str(tmp_path / "out"))
    assert scan.read_traces(spark, str(tmp_path / "out")).count() == len(kept)
    sinks.write_graph(engine.nodes, engine.edge_sites, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph/nodes")).count() == engine.nodes.count()


def test_generations(spark, files):
    forward = Engine(spark, files, Options.generation("core1")).paths.collect()
    assert forward and all(len(r["path"]) <= 17 for r in forward)
    everything = Engine(spark, files, Options.generation("core2")).paths.count()
    assert everything >= Engine(spark, files, Options.generation("core4")).paths.count()


def test_reading_repositories(spark, tmp_path):
    for name, path, text in (("one", "a/x.py", b"print(1)\xff\n"), ("one", "node_modules/y.js", b"f()"), ("two", "z.PHP", b"<?php"), (".hid", "q.py", b""), ("one", "notes.txt", b"no")):
        (tmp_path / name / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name / path).write_bytes(text)
    (tmp_path / "two/.git").mkdir()
    got = {(r["repo"], r["path"], r["lang"], r["text"]) for r in scan.read_repositories(spark, f"file:{tmp_path}").collect()}
    assert ("one", "a/x.py", "python", "print(1)\n") in got and ("one", "node_modules/y.js", "javascript", "f()") in got and not [g for g in got if g[0] == ".hid"]
    assert {r["path"] for r in scan.read_repositories(spark, f"file:{tmp_path}", exclude_dirs=("node_modules",)).collect()} >= {"a/x.py"}
    assert "node_modules/y.js" not in {r["path"] for r in scan.read_repositories(spark, f"file:{tmp_path}", enable_js=False).collect()}
    assert scan.repositories(str(tmp_path)) == ["one", "two"] and scan.repositories(str(tmp_path), git_only=True) == ["two"]
    (tmp_path / "g.json").write_text(json.dumps({"repository": "r", "nodes": [{"uid": "m.f", "name": "f", "file": "m.py", "line": 1}], "edges": [{"src": "m.f", "dst": "eval", "file": "m.py", "line": 2}]}))
    nodes, edges = scan.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first()["lang"] == "python" and edges.first()["callee"] == "eval"


def sequential(nodes, edges, sinks_by_lang, n):
    """Linking as one edge after another: the model that ``compat`` must equal."""
    known, order, out = {}, [], []

    def add(uid, name):
        if uid not in known:
            known[uid] = name
            order.append(uid)

    for uid, name in nodes:
        add(uid, name)
    for src, callee, lang in edges:
        add(src, src.rsplit(".", 1)[-1])
        if any(callee == s or callee.endswith("." + s) for s in sinks_by_lang.get(lang, ())):
            uid = f"builtin.{lang}.{callee}"
        else:
            local = f"{src.rsplit('.', 1)[0]}.{callee}" if "." not in callee else None
            named = next((u for u in order if known[u] == callee.rsplit(".", 1)[-1]), None)
            uid = local if local in known else named or f"ext.{lang}.{callee}"
        add(uid, callee)
        out.append(uid)
    return out


def test_compat_linking_equals_the_sequence(spark):
    rng = random.Random(9)
    for _ in range(4):
        names = ["a", "b", "c", "s"]
        nodes = list(dict.fromkeys((f"m{rng.randrange(3)}.{x}", x) for x in rng.choices(names, k=4)))
        edges = [(f"m{rng.randrange(3)}.{rng.choice(names + ['z'])}", rng.choice(["a", "b", "q", "s", "x.s", "y.c", "p.q", "z"]), rng.choice(["python", "go"])) for _ in range(25)]
        frame = spark.createDataFrame([("r", u, n, "f", 1, 1, False, False, False, False, "python", k) for k, (u, n) in enumerate(nodes)], "repo string, uid string, name string, file string, line int, end_line int, is_sink boolean, is_entry boolean, is_source boolean, is_builtin boolean, lang string, ordinal long")
        raw = spark.createDataFrame([("r", s, c, "f", k, lang, k) for k, (s, c, lang) in enumerate(edges)], "repo string, src string, callee string, file string, line int, lang string, ordinal long")
        got = {r["ordinal"]: r["dst_uid"] for r in link.resolve(frame, raw, catalog_frame(spark, {"python": ["s"]}), compat=True).collect()}
        assert [got[k] for k in range(len(edges))] == sequential(nodes, edges, {"python": ["s"]}, len(nodes))


def test_simple_paths_of_a_complete_graph(spark):
    pairs = [(a, b) for a in "vwxyz" for b in "vwxyz" if a != b]
    edges = spark.createDataFrame(pairs, "src_uid string, dst_uid string")
    got = [tuple(r["path"]) for r in paths.backward_paths(spark.createDataFrame([("z",)], "uid string"), edges).collect()]
    assert len(got) == len(set(got)) and all(len(set(p)) == len(p) and p[-1] == "z" for p in got)
    assert [sum(len(p) == n for p in got) for n in (2, 3, 4, 5)] == [4, 12, 24, 24]
    heads = spark.createDataFrame([("v",)], "uid string")
    assert {tuple(r["path"]) for r in paths.backward_paths(spark.createDataFrame([("z",)], "uid string"), edges, heads).collect()} == {p for p in got if p[0] == "v"}
    with pytest.raises(ValueError):
        paths.backward_paths(heads, edges, max_paths=10)


def test_numbers_are_dense_and_ordered(spark):
    rows = [(k * 7919 % 1000,) for k in range(1000)]
    got = link.numbered(spark.createDataFrame(rows, "x long"), "x").collect()
    assert sorted((r["trace_id"], r["x"]) for r in got) == [(k + 1, k) for k in range(1000)]


def test_greedy_equals_the_sequence_and_containment(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        own = sorted(rng.sample("abcdefg", rng.randint(1, 5)))
        rows.append((f"s{rng.randrange(3)}", [*own, "end"], "+".join(own), own))
    rows = [r for k, r in enumerate(rows) if r[:2] not in [x[:2] for x in rows[:k]]]
    frame = spark.createDataFrame(rows, "sink string, path array<string>, code_hash string, functions array<string>")
    kept = []
    for sink, path, code, functions in sorted(rows, key=lambda r: (r[0], len(r[1]), ">".join(r[1]))):
        hit = next((t for t in kept if code in t["hashes"]), None) or next((t for t in kept if len(t["path"]) < len(path) and set(t["functions"]) <= set(functions)), None)
        if hit is None:
            hit = {"path": path, "functions": functions, "sinks": set(), "hashes": set()}
            kept.append(hit)
        elif len(path) > len(hit["path"]):
            hit["path"], hit["functions"] = path, functions
        hit["sinks"].add(sink)
        hit["hashes"].add(code)
    got = traces.deduplicate(frame, "greedy").collect()
    assert sorted((tuple(r["path"]), tuple(r["sinks"])) for r in got) == sorted((tuple(t["path"]), tuple(sorted(t["sinks"]))) for t in kept)
    sets = frame.select("code_hash", "functions").distinct()
    pairs = {(r["inner"], r["outer"]) for r in traces.contained(sets, "code_hash", "functions").collect()}
    own = {r["code_hash"]: set(r["functions"]) for r in sets.collect()}
    assert pairs == {(a, b) for a, b in itertools.permutations(own, 2) if own[a] < own[b]}
    for mode in ("exact", "maximal"):
        once = traces.deduplicate(frame, mode)
        assert sum(r["n_merged"] for r in once.collect()) <= len(rows)
    with pytest.raises(ValueError):
        traces.deduplicate(frame, "other")


def test_shown_once():
    hop = lambda n, line, code: {"hop": n, "file": "f", "line": line, "code": code}
    assert dict(traces.lines_of([hop(0, 2, "b\nc"), hop(1, 1, "a\nb\nc\nd"), hop(2, 1, None)])) == {0: ["b", "c"], 1: ["a", "", "d"], 2: []}


def test_triage_tries_again():
    calls, waits = [], []

    def ask(text):
        calls.append(text)
        if len(calls) < 3:
            raise RuntimeError("429")
        return {"vulnerability": True}

    assert report.asked(ask, "t", sleep=waits.append)["vulnerability"] is True and len(calls) == 3 and 1 <= waits[0] < 2 <= waits[1] < 3
    failed = report.asked(lambda t: 1 / 0, "t", retries=2, sleep=waits.append)
    assert failed["vulnerability"] is False and "ZeroDivisionError" in failed["error"]
    assert report.backoff(10) == 60


def test_helpers(tmp_path):
    assert h.glob_matches("a/b/api/x/y.py", "**/api/**/*.py") and h.glob_matches("routes.py", "**/routes.py") and not h.glob_matches("xroutes.py", "**/routes.py")
    assert not h.glob_matches("x/api/u.py", "**/api/**/*.py", compat=True) and h.glob_matches("x/api/v/u.py", "**/api/**/*.py", compat=True) and not h.glob_matches("routes.py", "**/routes.py", compat=True)
    assert h.glob_matches("a/b.py", "[ab].py") and not h.glob_matches("a/c.py", "[!c].py")
    assert h.config_errors({"function_patterns": ["run"], "file_patterns": [{"pattern": "x"}]}) == []
    wrong = h.config_errors({"file_patterns": [1, {}], "function_patterns": ["(", ""], "function_names": "x", "source_indicators": 1, "language_specific": {"a": 1, "b": {}, "c": {"patterns": ["["]}}})
    assert len(wrong) == 9
    assert h.parse_model("gpt://folder/name/v1") == ("name", "v1") and h.parse_model("plain") == ("plain", "latest")
    assert h.split_prompt("sys\nTrace: TRACE x") == ("sys", "Trace: TRACE x")
    with pytest.raises(PermissionError):
        h.safe_path(str(tmp_path), "../x")
    assert h.safe_path(str(tmp_path), "a/b").endswith("a/b")


def test_catalog():
    own = builtin_catalog()
    assert {k: len(v) for k, v in own.items()} == {"python": 45, "javascript": 36, "java": 30, "php": 38, "go": 25, "ruby": 35, "c_sharp": 29, "typescript": 26, "tsx": 21}
    first = builtin_catalog(first_generation=True)
    assert {k: len(v) for k, v in first.items()} == {"python": 41, "javascript": 34, "java": 27, "php": 34, "go": 24, "ruby": 32, "c_sharp": 26, "typescript": 24, "tsx": 19}
    assert Options.generation("core1").catalog == first and "fmt.Sprintf" in first["go"] and Options.generation("core2").catalog is None
    assert normalized_sink("PDO->query") == "PDO.query" and normalized_sink("new RegExp") == "RegExp" and normalized_sink("Runtime.getRuntime().exec") == "Runtime.getRuntime.exec"


def test_ast_dump(spark, files):
    rows = ast_dump(files).orderBy("place").collect()
    assert rows[0]["type"] == "Module" and {"FunctionDef", "Call"} <= {r["type"] for r in rows}


def test_stream(spark, files, tmp_path):
    from sinkweave.streaming.incremental import extract_into, watch

    files.write.parquet(str(tmp_path / "in"))
    run = extract_into(watch(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/nodes")).where("uid = 'app.views.run'").count() == 1


def test_yaml_quotes_what_needs_it(spark):
    rows = [{"hop": 0, "uid": "u", "label": 'a: "b" [SOURCE]', "location": "p.py:3-4", "is_source": True, "is_sink": False, "file": "p.py", "line": 3, "code": "  x: 1\n\ny", "sites": ["p.py:3"]}, {"hop": 1, "uid": "builtin.python.eval", "label": "eval [SINK]", "location": "<builtin>", "is_source": False, "is_sink": True, "file": "<builtin>", "line": 0, "code": None, "sites": None}]
    (root,) = yaml.safe_load(render.yaml_trace(rows, ["builtin.python.eval", "builtin.python.exec"]))
    assert root["function"] == 'a: "b" [SOURCE]' and root["location"] == "p.py:3-4" and root["code"].split("\n")[:3] == ["  x: 1", "", "y"] and [c["function"] for c in root["calls"]] == ["eval [SINK]", "exec [SINK]"]
    assert F is not None


def test_config_agent(tmp_path):
    from sinkweave.plans.agent import build_config

    (tmp_path / "app").mkdir()
    (tmp_path / "app/views.py").write_text("def run():\n    pass\n")
    script = [
        {"tool": "get_languages"}, {"tool": "list_dir", "args": {"path": "../.."}}, {"tool": "ls_depth"}, {"tool": "grep", "args": {"pattern": "def"}}, {"tool": "grep", "args": {"pattern": "VIEWS", "names": True}},
        {"tool": "read_lines", "args": {"path": "app/views.py", "first": 2, "last": 9}}, {"tool": "read_file", "args": {"path": "app/views.py"}}, {"tool": "no"}, {"tool": "submit", "args": {"function_patterns": ["("]}}, {"tool": "submit", "args": {"function_patterns": ["run"]}},
    ]
    seen = []

    def model(transcript):
        seen[:] = [t["answer"] for t in transcript]
        return script[len(transcript)]

    assert build_config(str(tmp_path), model) == {"function_patterns": ["run"]}
    assert seen[0] == "python: 1" and seen[1].startswith("error") and "views.py" in seen[2] and seen[3] == "app/views.py:1: def run():" and seen[4] == "app/views.py" and seen[5] == "    pass"
    assert seen[7] == "error: no tool no" and seen[8].startswith("refused")
    assert build_config(str(tmp_path), lambda t: {"tool": "submit", "args": {"function_names": 1}}) is None
    assert build_config(str(tmp_path), lambda t: {"tool": "list_dir"}, steps=2) is None


def test_zip_and_suffix_globs(tmp_path):
    import zipfile

    for name, ok in (("good", "top/a.py"), ("bad", "../evil.py")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as file:
            file.writestr(ok, "x")
    assert scan.unpack_zip(str(tmp_path / "good.zip"), str(tmp_path / "out")) == "top" and (tmp_path / "out/top/a.py").exists()
    with pytest.raises(PermissionError):
        scan.unpack_zip(str(tmp_path / "bad.zip"), str(tmp_path / "out"))
    assert h.suffix_glob_matches("xroutes.py", "**/routes.py") and h.suffix_glob_matches("a/b.py", "*.py") and not h.suffix_glob_matches("a/b.py", "c*")
