import hashlib
import math
import re

import pytest

from sinkweave.llm import mixing
from sinkweave.llm.mixing import LENGTHS, SHARES, SYMBOLS, mix, mixed_documents


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Sources' targets by pouring the excess again and again until none is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def cell(text):
    n, marks = size(text), sum(c in SYMBOLS for c in text or "")
    return min(SHARES - 1, math.ceil(4 * marks / max(1, n))) * LENGTHS + min(LENGTHS - 1, len(str(n)) if n else 0)


def plain(docs, labels=None):
    """(doc_id, size, source_size, target, taken) of each document."""
    sizes, model = {}, {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + size(text)
    for doc, text, _ in docs:
        for label, good in labels or ():
            if label == doc and good in (0, 1):
                model.setdefault(cell(text), []).append(good)
    goal, out = targets(sizes), []
    for source in sizes:
        own = []
        for k, (doc, text, s) in enumerate(docs):
            if s == source:
                found = model.get(cell(text), [])
                weight = (sum(found) + 1) / (len(found) + 2) if labels is not None else 1
                digest = hashlib.md5(f"0:{'' if doc is None else doc}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()[:13]
                own.append((-math.log((int(digest, 16) + 0.5) / 2**52) / weight, k, doc, text))
        epochs = min(3, math.floor(goal[source] / sizes[source])) if sizes[source] else 1
        budget, before = goal[source] - epochs * sizes[source], 0
        for _, _, doc, text in sorted(own, key=lambda x: x[:2]):
            n = size(text)
            extra = budget > 0 and before + n / 2 <= budget
            before += n
            out.append((doc, n, sizes[source], goal[source], (epochs + extra) * n))
    return out


ODD = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "one\x0btwo \x85 three", None), (5, "w " * 20_000, "y"), (6, "z" * 5000, "é"), (7, "#$% 12 ok", "y"), (8, "\n\t ", "only blank")]


def rows(frame):
    return sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in frame.collect())


@pytest.fixture(params=[False, True], ids=["few", "many"])
def sliced(request, monkeypatch):
    """Slices of a few documents and bins, and the plan's rows looked at in slices too, as if the table were large."""
    if request.param:
        for name, value in (("MOST_SORTED", 3), ("BINS", 4), ("MOST_SOURCES", 2), ("BROADCAST_SOURCES", 1)):
            monkeypatch.setattr(mixing, name, value)


def test_against_plain_mix(spark, sf, sliced):
    given = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    known = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    labels = spark.createDataFrame(known + [(1, None), (None, 1)], "doc_id long, quality int")
    for docs in (given, ODD):
        frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
        want = sorted((d, n, s, round(t, 6), k) for d, n, s, t, k in plain(docs))
        assert rows(mix(frame)) == want == rows(mix(frame.repartition(7)))
        assert rows(mix(frame, labels=labels)) == sorted((d, n, s, round(t, 6), k) for d, n, s, t, k in plain(docs, known))


def test_many_sources_and_equal_ratios(spark, sliced):
    docs = [(k, "w " * (1 + k % 7), f"s{k // 3:03}" if k % 50 else None) for k in range(300)] + [(k, "v " * 900, "huge") for k in range(300, 310)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert rows(mix(frame)) == sorted((d, n, s, round(t, 6), k) for d, n, s, t, k in plain(docs))


def test_hot_source_repeated_ids_and_rows(spark, sliced):
    """A third of all rows in one source without ids, many of them the same row: each is taken by itself, none is lost."""
    docs = [(None, f"one two three {k % 5}", "hot", None, "x") for k in range(40)] + [(None, "four five", "hot", "x", None)] * 20 + [(k, "six seven eight nine", f"s{k % 3}", None, None) for k in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, b string, c string").repartition(4)
    plan = mix(frame).collect()
    assert len(plan) == len(docs)
    for source in {r["source"] for r in plan}:
        own = [r for r in plan if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2
    out = mixed_documents(frame).collect()
    assert len(out) == sum(r["copies"] for r in plan) and {tuple(r) for r in out} <= set(docs)
    # where all sources are taken once at least, no row that differs in a null alone is lost
    assert {tuple(r) for r in out if r["source"] == "hot"} == {d for d in docs if d[2] == "hot"} or min(r["copies"] for r in plan if r["source"] == "hot") == 0


def test_map_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b", "x", {"a": 1}), (1, "a b", "x", None), (2, "c", "y", {})], "doc_id long, text string, source string, more map<string,int>")
    assert mixed_documents(docs).count() == sum(r["copies"] for r in mix(docs).collect())


def test_sources_come_near_their_targets(spark, sf):
    got = mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_repeated_rows_empty_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 9), (1, "a b", "x", 9), (2, "c", "y", 8)], "doc_id long, text string, source string, taken int")
    plan = {(r["doc_id"], r["copies"]) for r in mix(docs).collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id = 2").count() == sum(n for d, n in plan if d == 2)
    assert out.where("doc_id = 1").count() == sum(r["copies"] for r in mix(docs).where("doc_id = 1").collect())
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0
