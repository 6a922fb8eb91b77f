import itertools
import random
import re

import numpy as np
import pytest

from sinkweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PATTERNS = (EMAIL, re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), pii.CARD, pii.PHONE)


def brute(text):
    return sorted((k, *m.span()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if pii.fitting(pii.KINDS[k], m[0]))


def test_base_against_plain_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b.", "@", "-", "1", "23", ".", " ", "4111111111111111", "255", "300", "+", "(", ")", "é", "_", "x@y.z", "1.2.3.4"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text


def test_hostile_texts_end():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "@" * 100_000, "+1" + "(" * 200_000, "a@b" * 50_000):
        pii.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in pii.start_weights(3).items()}
    chars = rng.integers(1, 20, (3, 7)).astype(np.int32)
    chars[1, 5:] = 0
    tags = np.where(chars > 0, rng.integers(0, pii.N_TAGS, (3, 7)), 0).astype(np.int32)

    def loss():
        score = pii.emissions(w, chars)
        mask = (chars > 0).T.astype(float)
        whole = pii.chain(score, w["moves"], mask)[2]
        gold = sum(score[t, n, tags[n, t]] + (w["moves"][tags[n, t - 1], tags[n, t]] if t else 0) for n in range(3) for t in range(7) if chars[n, t])
        return (whole.sum() - gold) / 3

    slopes = pii.gradients(w, chars, tags)
    for name, x in w.items():
        places = [tuple(rng.integers(0, s) for s in x.shape) for _ in range(3)]
        if name == "embed":
            places = [(int(chars[0, 0]), 2), (int(chars[2, 3]), 0)]
        for at in places:
            old, step = x[at], 1e-3
            x[at] = old + step
            up = loss()
            x[at] = old - step
            down = loss()
            x[at] = old
            assert abs((up - down) / (2 * step) - slopes[name][at]) < 2e-3, (name, at)


def test_reconciled_against_all_choices():
    rng = random.Random(6)
    for _ in range(200):
        spans = [(rng.randrange(2), a := rng.randint(0, 12), a + rng.randint(1, 6), rng.choice([0.9, 0.95, 1.0])) for _ in range(rng.randint(0, 7))]
        weight = {}
        for k, a, b, s in spans:
            weight[k, a, b] = weight.get((k, a, b), 0) + s * (b - a)

        def fits(chosen):
            return all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(chosen, 2))

        best = max((sum(weight[x] for x in c) for n in range(len(weight) + 1) for c in itertools.combinations(weight, n) if fits(c)), default=0)
        got = pii.reconciled(spans)
        assert fits(got) and abs(sum(weight[x] for x in got) - best) < 1e-9


@pytest.fixture(scope="module")
def weights():
    return pii.model()


def test_held_out_spans(weights):
    right = found = wanted = 0
    for text, spans in pii.labelled_spans(500, seed=77):
        got = {(k, a, b) for k, a, b, _ in pii.decode(weights, pii.codes(text)[None, :])[0]}
        right, found, wanted = right + len(got & set(spans)), found + len(got), wanted + len(spans)
    assert right / found > 0.93 and right / wanted > 0.93, (right, found, wanted)


def test_adds_spans_wherever_they_stand(weights):
    filler = "lorem dolor amet "
    for size in (0, 50, 100, 118, 127, 128, 500, 5000):
        text = (filler * 400)[:size].rstrip() + " call (415) 555-0134 today, " + filler * 20
        spans = pii.find([text], weights)[0]
        at = text.index("(415)")
        assert (3, at, at + 14, False) in spans, (size, spans)
    assert pii.find([filler * 1000, None, ""], weights) == [[], [], []]


def test_frames(spark, sf, weights):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    for r in pii.find_pii(docs, weights=weights).collect():
        assert sorted((pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["pii"] if s["fixed"]) == brute(r["text"])
    rows = pii.find_pii(spark.createDataFrame([(1, None, 2), (2, "x@y.com", 3), (2, "x@y.com", 3)], "doc_id long, text string, pii int"), weights=weights).collect()
    assert [len(r["pii"]) for r in rows] == [0, 1, 1]
    assert pii.find_pii(spark.createDataFrame([], "text string"), weights=weights).count() == 0


def test_spans_longer_than_windows_are_put_together():
    from sinkweave.llm.pii import WINDOW, stitched

    whole = (3, 10, 20, 0.99, False, False)
    assert stitched([whole]) == [whole[:4]]
    parts = [(0, 30, 128, 0.95, False, True), (0, 64, 192, 0.97, True, True), (0, 128, 200, 0.93, True, False)]
    assert WINDOW == 128 and stitched(parts) == [(0, 30, 200, 0.93)]
    assert stitched([(0, 30, 128, 0.95, False, True), (1, 64, 100, 0.97, True, False)]) == []  # another kind goes on
    assert stitched([(0, 128, 150, 0.95, True, False)]) == [] == stitched([(0, 30, 128, 0.95, False, True)])


def test_decoding_is_the_best_of_all_paths():
    import itertools

    import numpy as np

    from sinkweave.llm import pii

    rng = np.random.default_rng(2)
    w = pii.start_weights(3) | {"moves": rng.normal(size=(pii.N_TAGS, pii.N_TAGS)).astype(np.float32)}
    w["out"] *= 8
    for _ in range(8):
        chars = rng.integers(1, pii.N_CHARS, (1, 4)).astype(np.int32)
        score = pii.emissions(w, chars)[:, 0]
        total = lambda path: sum(score[t, c] for t, c in enumerate(path)) + sum(w["moves"][a, b] for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(pii.N_TAGS), repeat=4), key=total)
        want, t = [], 0
        while t < 4:
            end = t + 1
            if best[t] % 2:
                while end < 4 and best[end] == best[t] + 1:
                    end += 1
                want.append(((best[t] - 1) // 2, t, end))
            t = end
        assert [s[:3] for s in pii.decode(w, chars)[0]] == want
