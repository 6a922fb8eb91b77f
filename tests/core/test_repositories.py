"""Several repositories in one table: each is a graph of its own."""

import pytest

from sinkweave.operators import link, traces
from sinkweave.operators.extract import extract_file
from sinkweave.plans.engine import Engine, Options
from sinkweave.sources import scan

ONE = [("views.py", "def view():\n    helper()\n    eval('1')\n"), ("only.py", "def own():\n    view()\n")]
TWO = [("views.py", "def view():\n    helper()\n# two\n"), ("lib.py", "def helper():\n    exec('2')\n")]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(repo, path, "python", text) for repo, own in (("r.one", ONE), ("r.two", TWO)) for path, text in own]
    return spark.createDataFrame(rows, "repo string, path string, lang string, text string")


def test_no_call_crosses_repositories(spark, files):
    engine = Engine(spark, files, Options(validate=False))
    edges = {(r["repo"], r["src_uid"], r["dst_uid"]) for r in engine.edges.collect()}
    assert ("r.one", "views.view", "ext.python.helper") in edges and ("r.two", "views.view", "lib.helper") in edges
    assert ("r.one", "only.own", "views.view") in edges and len(edges) == 5
    nodes = [(r["repo"], r["uid"]) for r in engine.nodes.collect()]
    assert sorted(n for n in nodes if n[1] == "views.view") == [("r.one", "views.view"), ("r.two", "views.view")] and len(set(nodes)) == len(nodes)
    assert {(r["repo"], r["code"]) for r in engine.code.collect() if r["uid"] == "views.view"} == {("r.one", "def view():\n    helper()\n    eval('1')"), ("r.two", "def view():\n    helper()")}
    found = {(r["repo"], r["head"], r["sink"]) for r in engine.paths.collect()}
    assert found == {("r.one", "views.view", "builtin.python.eval"), ("r.one", "only.own", "builtin.python.eval"), ("r.two", "lib.helper", "builtin.python.exec"), ("r.two", "views.view", "builtin.python.exec")}
    assert {(r["repo"], tuple(r["sinks"])) for r in engine.traces.collect()} == {("r.one", ("builtin.python.eval",)), ("r.two", ("builtin.python.exec",))}
    assert not [r for r in engine.rendered().collect() if link.MARK in r["text"]]


def test_each_mode_of_deduplication_keeps_repositories_apart(spark):
    same = [(repo, "a.py", "python", "def f():\n    eval('1')\n") for repo in ("x", "y")]
    files = spark.createDataFrame(same, "repo string, path string, lang string, text string")
    for mode in traces.MODES:
        kept = Engine(spark, files, Options(validate=False, dedup=mode)).traces.collect()
        assert sorted(r["repo"] for r in kept) == ["x", "y"], mode


def test_configurations_by_repository(spark, files):
    config = {"function_names": ["view"]}
    heads = lambda **o: {(r["repo"], r["uid"]) for r in Engine(spark, files, Options(**o)).heads.collect()}
    assert heads(configs={"r.one": config}) == {("r.one", "views.view")}
    assert heads(configs={"r.one": config}, config={"function_names": ["helper"]}) == {("r.one", "views.view"), ("r.two", "lib.helper")}
    assert heads(config={"source_indicators": ["EVAL("]}) == {("r.one", "views.view"), ("r.one", "views.<global>")}
    php = spark.createDataFrame([("p", "a.php", "php", "<?php\nfunction f() {\n  return $_GET['x'];\n}\nfunction g() {\n  return 1;\n}\n")], "repo string, path string, lang string, text string")
    assert {r["uid"] for r in Engine(spark, php, Options(config={"source_indicators": ["nothing"]})).heads.collect()} >= {"a.f"}


def test_names_in_upper_case_are_read(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one/B.PY").write_text("x()")
    (tmp_path / "one/c.Js").write_text("y()")
    assert {(r["path"], r["lang"]) for r in scan.read_repositories(spark, f"file:{tmp_path}").collect()} == {("B.PY", "python"), ("c.Js", "javascript")}


def test_large_generated_files_in_linear_time():
    import time

    text = "".join(f"function f{k}(x){{g{k}(x);h(x)}}" for k in range(4000))
    start = time.time()
    found = extract_file("r", "min.js", "javascript", text)
    assert len(found.nodes) == 4001 and len(found.edges) == 8000 and time.time() - start < 30


def test_strings_built_on_many_lines_are_nodes_once():
    text = "x = 1\n" + "".join(f"y{k} = f'{{x}}' + 'a'\n" for k in range(80)) * 1
    uids = [n["uid"] for n in extract_file("r", "a.py", "python", text).nodes]
    assert len(uids) == len(set(uids))
