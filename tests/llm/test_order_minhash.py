import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinkweave.llm import order_minhash as om
from sinkweave.llm.graph import connected_components


def distance(a, b):
    """Edit distance by a full table."""
    row = np.arange(len(b) + 1)
    b = np.array(b, object)
    for i, x in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(800):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        b = list(a) if rng.random() < 0.5 else [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.randrange(4) for _ in range(rng.randint(0, 2))]
        want = plain(a, b)
        assert distance(a, b) == want
        for limit in (0, 1, 3, 8, 20, 50):
            assert om.banded_distance(a, b, limit) == min(want, limit + 1)


def test_long_and_reordered_texts():
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(12_000)]
    changed = [w if rng.random() > 0.02 else "new" for w in words]
    assert om.banded_distance(words, changed, 2400) == sum(a != b for a, b in zip(words, changed))
    assert om.banded_distance(words, words[6000:] + words[:6000], 2400) == 2401
    assert om.alike(" ".join(words), " ".join(changed)) and not om.alike(" ".join(words), " ".join(words[6000:] + words[:6000]))


def near(one, two):
    a, b = one.lower().split(), two.lower().split()
    longer = max(len(a), len(b))
    if not a or not b or min(len(a), len(b)) < 0.8 * longer - 1e-9:
        return False
    bag = lambda w: {x: w.count(x) for x in set(w)}
    x, y = bag(a), bag(b)
    if sum(abs(x.get(w, 0) - y.get(w, 0)) for w in x.keys() | y.keys()) > 2 * int(0.2 * longer + 1e-9):
        return False  # an edit changes two counts at most
    return a == b or distance(a, b) <= 0.2 * longer + 1e-9


def classes(docs):
    """Brute force: all pairs of different texts, each linked one into one class."""
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for d, t in docs:
        key = " ".join((t or "").lower().split())
        if key and first.setdefault(key, d) != d:
            root[find(d)] = find(first[key])
    keys = sorted(first, key=lambda k: k.count(" "))
    for k, one in enumerate(keys):
        for two in keys[k + 1 :]:
            if (one.count(" ") + 1) < 0.8 * (two.count(" ") + 1) - 1e-9:
                break
            if near(one, two):
                a, b = sorted((find(first[one]), find(first[two])))
                root[b] = a
    least = {}
    for d, _ in docs:
        least[find(d)] = min(d, least.get(find(d), d))
    return {d: least[find(d)] for d, _ in docs}


def test_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    for k in range(60):  # a group of near copies
        words = list(base)
        for _ in range(rng.randint(0, 20)):
            words[rng.randrange(150)] = "changed"
        docs.append((5000 + k, " ".join(words)))
    shared = " ".join(f"s{k}" for k in range(60))  # a passage shared by different texts
    docs += [(6000 + k, shared + " " + " ".join(f"u{k}x{j}" for j in range(80))) for k in range(40)]
    docs += [(7000, "too short"), (7001, "too  SHORT"), (7002, "too long"), (7003, ""), (7004, " \n"), (7005, None), (7006, "word " * 30_000), (7007, "word " * 30_000)]
    rows = om.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = classes([d for d in docs if d[0] < 7006])
    assert len(rows) == len(docs)
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert {d: c for d, c in got.items() if d < 7006} == want
    assert got[7007] == got[7006] == 7006
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


def test_recall_where_a_fifth_of_the_words_is_edited():
    rng = random.Random(7)
    found = 0
    for _ in range(150):
        a = [f"w{rng.randrange(3000)}" for _ in range(200)]
        b = list(a)
        for at in rng.sample(range(200), 40):
            b[at] = rng.choice(["other", "", b[at] + " more"])
        one, two = om.describe([" ".join(a), " ".join(b)])["tuples"]
        found += bool((one == two).any())
    assert found >= 0.9 * 150


@pytest.mark.parametrize("block", [1000, 2])
def test_pairs_within_a_bucket(spark, block, monkeypatch):
    """All pairs of one bucket in different components that may be similar, whatever the blocks; lost by none."""
    monkeypatch.setattr(om, "BLOCK", block)
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    texts = [" ".join(base[:k] + ["new"] * (k % 7) + base[k + k % 9 :]) for k in range(10, 40)] + [" ".join(f"x{rng.randrange(900)}" for _ in range(n)) for n in (290, 300, 310)]
    made = om.describe(texts)
    sketched = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(made["counts"])], "no long, counts binary")
    rows = spark.createDataFrame([(1, k, k if k != 3 else 2, int(made["n_words"][k])) for k in range(len(texts))], "bucket long, no long, component long, n_words long")
    pairs = [(r["a"], r["b"]) for r in om.further_pairs(rows, sketched).collect()]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if near(texts[a], texts[b]) and (a, b) != (2, 3)}
    assert len(want) > 50 and want <= set(pairs) and len(set(pairs)) == len(pairs)
    assert not {p for p in pairs if max(p) >= 30 > min(p)}


def test_pairs_aligned_together():
    rng = random.Random(9)
    pairs = []
    for _ in range(1500):
        vocabulary = rng.choice([2, 30, 1000])
        a = [rng.randrange(vocabulary) for _ in range(rng.randint(1, rng.choice([2, 8, 40, 90])))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.randrange(vocabulary) for _ in range(rng.randint(0, 2))]
        pairs.append((np.array(a, np.int32), np.array((b[len(b) // 2 :] + b[: len(b) // 2] if rng.random() < 0.1 else b) or [0], np.int32)))
    pairs.append((np.arange(om.LONG + 1), np.arange(om.LONG + 1) + 1))
    want = [om.banded_distance(a.tolist(), b.tolist(), om.most_edits(max(len(a), len(b)))) <= om.most_edits(max(len(a), len(b))) for a, b in pairs]
    assert 300 < sum(want) < 1400 and om.close(pairs).tolist() == want


@pytest.mark.parametrize("words", [64_000, 500])
def test_group_of_near_copies_with_a_fringe(spark, words, monkeypatch):
    """The classes of brute force, without a table of the pairs that word counts leave."""
    monkeypatch.setattr(om, "FAMILY_WORDS", words)
    rng = random.Random(11)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    docs = []
    for k in range(150):
        own = list(base)
        for at in rng.sample(range(60), rng.choice([2, 4, 8, 10, 11, 12])):
            own[at] = f"x{rng.randrange(300)}"
        docs.append((k, " ".join(own)))
    given = []
    verified = om.verified
    monkeypatch.setattr(om, "verified", lambda pairs, texts: given.append(pairs.count()) or verified(pairs, texts))
    rows = om.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    tuples = om.describe([t for _, t in docs])["tuples"]
    root = list(range(150))
    for b in range(150):
        for a in range(b):
            if root[a] != root[b] and (tuples[a] == tuples[b]).any() and near(docs[a][1], docs[b][1]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert {r["doc_id"]: r["class_id"] for r in rows} == dict(enumerate(root))
    assert 1 < len(set(root)) and sum(given) < 8 * 150


def test_estimates_stay_small_in_components(spark):
    """Digits of the optimizer's sizes must not double with every join of a long chain's rounds."""
    order = random.Random(3).sample(range(1000), 1000)
    made = connected_components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long"))
    assert made._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
    assert made.count() == 1000 and made.select("component").distinct().count() == 1


def test_nulls_repeats_clashing_names_and_empty(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, "y"), (2, text, None), (3, None, "z")], "doc_id long, text string, class_id string")
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in om.near_duplicates(docs).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    left = om.without_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 3]
    assert om.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_differ_in_one_null_or_map(spark):
    text = "a b c d e f g h i j k l"
    rows = [(1, text, None, "x", {"a": 1}), (2, text, "x", None, None), (4, text + " m", None, None, {"b": None}), (5, "quite another text", "x", None, None), (5, "and one more of them", None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, b string, c string, d map<string,int>")
    assert sorted((r["doc_id"], r["text"]) for r in om.without_near_duplicates(docs).collect()) == [(1, text), (5, "and one more of them"), (5, "quite another text")]
    repeated = docs.unionAll(docs.withColumn("b", F.lit("other")))
    first, second = (sorted(map(str, om.without_near_duplicates(x).collect())) for x in (repeated, repeated.repartition(3)))
    assert first == second and len(first) == 3
