import random
import re
from collections import Counter

import numpy as np

from sinkweave.llm.quality_rules import MAX_COVERED, MAX_REPEAT, MIN_REPEAT, judge, maximal_repeats, quality_rules, suffix_array

ODD = [None, "", " \n\t", "one", "a b " * 30, "x", "\x85\xa0 a\x1cb", "w " * 5000, "é#*$ ü|<>\n\n é#*$ ü|<>\n", "x"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)

    def inside(width):
        count = Counter(tuple(words[k : k + width]) for k in range(len(words) - width + 1))
        hit = set()
        for k in range(len(words) - width + 1):
            if count[tuple(words[k : k + width])] > 1:
                hit.update(range(k, k + width))
        return len(hit)

    n, repeats = len(words), inside(8)
    longest = 0
    while inside(max(2, longest + 1)):
        longest = max(2, longest + 1)
    failed = n < 20 or 100 * repeats > 30 * n
    spread = inside(MIN_REPEAT)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": repeats,
        "covered_words": spread, "longest_repeat": longest, "base_failed": failed, "kept": not failed and spread <= MAX_COVERED * n and longest <= MAX_REPEAT,
    }


def made(seed):
    rng = random.Random(seed)
    words = [rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 3)):
        if words:
            k, m = rng.randrange(len(words)), rng.randint(5, 40)
            at = rng.randrange(len(words))
            words[at:at] = words[k : k + m]
    return "".join(w + rng.choice([" ", "\n", "  "]) for w in words)


def test_against_brute_force(spark):
    texts = [t for t in ODD if len(t or "") < 3000] + [made(k) for k in range(60)]
    rows = quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = brute(texts[row["doc_id"]])
        assert {k: row[k] for k in want} == want, texts[row["doc_id"]]


def test_suffix_array_and_maximal_repeats():
    rng = random.Random(4)
    for _ in range(200):
        texts = [[rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 4))]
        tokens = np.array([w + 10 * k for k, t in enumerate(texts) for w in t], np.int64)
        bounds = np.cumsum([0, *map(len, texts)])
        ends = np.repeat(bounds[1:], np.diff(bounds))
        order, common = suffix_array(tokens, ends)
        suffixes = [tokens[k : ends[k]].tolist() for k in range(len(tokens))]
        assert order.tolist() == sorted(range(len(tokens)), key=suffixes.__getitem__)
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common.tolist() == [shared(suffixes[order[k]], suffixes[order[k - 1]]) if k else 0 for k in range(len(order))]
        want = {k: max((shared(s, t) for j, t in enumerate(suffixes) if j != k), default=0) for k, s in enumerate(suffixes)}
        starts, lengths = maximal_repeats(tokens, ends, 2)
        assert dict(zip(starts.tolist(), lengths.tolist())) == {k: v for k, v in want.items() if v >= 2}


def test_method_rejects_what_the_base_rules_keep():
    cycle = " ".join(f"{a} {b} {c} {d}" for a, b, c, d in [("buy", "now", "and", "save")] * 2 for _ in range(1))
    text = " ".join(f"w{k} one two three" for k in range(30)) + " " + cycle
    out = judge([text, " ".join(f"w{k}" for k in range(200))])
    assert list(out["base_failed"]) == [False, False] and list(out["kept"]) == [False, True]


def test_very_long_and_periodic():
    out = judge(["w " * 200_000, "a b c d e f g h i " * 3, None])
    assert out["longest_repeat"][0] == 199_999 and out["n_repeat_words"][0] == 200_000
    assert list(out["kept"]) == [False, False, False]


def test_empty_table_and_clashing_names(spark):
    assert quality_rules(spark.createDataFrame([], "text string, kept int, n_words string")).count() == 0
    row = quality_rules(spark.createDataFrame([("a b", 5, "x")], "text string, kept int, other string")).first()
    assert row["kept"] is False and row["other"] == "x" and row["n_words"] == 2
