"""Written trace documents and the client that asks again."""

import json

import yaml

from sinkweave.operators import documents as d
from sinkweave.operators import report


def doc(sink, code="x = 1", name="f", shown="# Lines 1-2\n"):
    return yaml.dump([{"function": name, "location": "a.py:1-2", "code": shown + code, "calls": [{"function": "g", "location": "b.py:1", "code": "y", "calls": [{"function": sink, "location": "<builtin>", "tags": ["SINK"], "code": "never"}]}]}], sort_keys=False)


def test_documents_of_one_code_merge_under_the_last_function(spark):
    rows = [(3, doc("eval [SINK]")), (1, doc("exec [SINK]", shown="# Lines 7-8\n")), (2, doc("exec [SINK]")), (4, doc("eval [SINK]", code="z")), (5, "{not: [yaml"), (6, None), (7, "- function: f\n"), (8, "plain")]
    merged = {r["trace_id"]: r for r in d.merge_documents(spark.createDataFrame(rows, "trace_id long, text string")).collect()}
    assert {k: r["n_merged"] for k, r in merged.items()} == {1: 3, 4: 1}
    (root,) = yaml.safe_load(merged[1]["text"])
    assert root["code"].startswith("# Lines 7-8") and [c["function"] for c in root["calls"][0]["calls"]] == ["exec [SINK]", "eval [SINK]"]
    parsed = {r["trace_id"]: r for r in d.parse_documents(spark.createDataFrame(rows, "trace_id long, text string")).collect()}
    assert sorted(parsed) == [1, 2, 3, 4, 7] and parsed[1]["path"] == ["f", "g"] and parsed[7]["code_hash"] is None
    assert json.loads(parsed[3]["sink"])["function"] == "eval [SINK]"
    assert d.merge_documents(spark.createDataFrame([], "trace_id long, text string")).count() == 0


def test_client_asks_for_json_again():
    seen = []

    def send(system, prompt):
        seen.append((system, prompt))
        return ["no json", "[1]", '{"vulnerability": true}'][len(seen) - 1]

    assert report.asked(report.json_client(send, "sys", "Look: TRACE"), "t")["vulnerability"] is True
    assert [s for s, _ in seen] == ["sys"] * 3 and seen[0][1] == "Look: t" and seen[2][1].count("JSON object") > seen[1][1].count("JSON object")
    failed = report.asked(report.json_client(lambda s, p: "x"), "t")
    assert failed["vulnerability"] is False and "parsed" in failed["reasoning"] and failed["error"] is None
