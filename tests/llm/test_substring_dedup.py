import random
import re

from pyspark.sql import functions as F

from sinkweave.llm.common import row_key
from sinkweave.llm.substring_dedup import UNIT_WORDS, pieces, substring_dedup

PASSAGE = "the quick brown fox jumps over lazy dogs today. It was seen by nine people at noon, and ten more came. All of them\nwent home"


def brute(docs):
    """docs: (id, text) -> {id: mask of the characters that go}, one pass over documents in order of their id."""
    seen, masks = set(), {}
    for key, text in sorted(set(docs), key=lambda d: d[0]):
        spans = [m.span() for m in re.finditer(r"[^\n]*?(?:[.!?]+[ \t\r\x0b\x0c]+\n?|\n|\Z)", text or "") if m[0]]
        words = [re.findall(r"[^\x20\x09-\x0D]+", text[a:b].lower()) for a, b in spans]
        gone = set()
        for k in range(len(spans)):
            end, own = k, []
            while len(own) < UNIT_WORDS and end < len(spans):
                own += words[end]
                end += 1
            if words[k] and len(own) >= UNIT_WORDS:
                if " ".join(own) in seen:
                    gone |= set(range(spans[k][0], spans[end - 1][1]))
                seen.add(" ".join(own))
        masks[key] = gone
    return masks


def test_pieces_tile_the_text():
    for text in ("", "\n", "a\n\nb. c\n", "One. Two!\nThree", "é. \nü", "no end", " . \n. ", "x.\t\n\ny"):
        assert "".join(text[a:b] for a, b in pieces(text)) == text


def test_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, f"Start here. {PASSAGE}.\nEnd."), (9004, f"x y z. {PASSAGE}.\nOther end."), (9005, PASSAGE.upper() + "."), (9006, "word " * 60_000), (9007, "\n" * 500), (9008, f"{PASSAGE}.\n42 kg\n{PASSAGE}.\n")]
    rng = random.Random(3)
    sentences = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) + rng.choice([". ", "!\n", "\n"]) for _ in range(12)]
    docs += [(9100 + k, "".join(rng.choice(sentences) for _ in range(rng.randint(1, 40)))) for k in range(40)]
    rows = substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    want, originals = brute(docs), dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        text = originals[r["doc_id"]]
        assert {p for s in r["removed"] for p in range(s["start"], s["end"])} == want[r["doc_id"]], r["doc_id"]
        assert r["text"] == (None if text is None else "".join(c for p, c in enumerate(text) if p not in want[r["doc_id"]]))
        assert r["original"] == len(text or "")
    assert "42 kg" in next(r["text"] for r in rows if r["doc_id"] == 9008)


def test_repeated_rows_nulls_and_clashing_names(spark):
    line = "a line of more than twenty words which everybody repeats in all of the documents that they write or read or hear of"
    docs = [(1, line, "x"), (1, line, "x"), (None, line, "y"), (2, line, None)]
    rows = substring_dedup(spark.createDataFrame(docs, "doc_id long, text string, removed string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in rows) == [(False, 1, line), (False, 1, line), (False, 2, ""), (True, 0, "")]
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    maps = spark.createDataFrame([(1, line, {"a": 1}), (2, line, {"a": 2}), (2, line, None)], "doc_id long, text string, more map<string,int>")
    assert sorted(r["text"] for r in substring_dedup(maps).collect()) == ["", "", line]


def test_row_key_tells_rows_apart(spark):
    """Rows that differ only in which column is null, or in a map, an array, a binary or microseconds have keys of their own."""
    schema = "a long, b string, c string, d map<string,int>, e array<struct<x:double>>, f binary, g timestamp"
    rows = [
        (1, None, "x", None, None, None, None), (1, "x", None, None, None, None, None), (1, "x", "", None, None, None, None), (1, "", "x", None, None, None, None), (None, None, None, None, None, None, None),
        (1, "x", None, {"a": 1}, None, None, None), (1, "x", None, {"a": None}, None, None, None), (1, "x", None, {}, None, None, None), (1, "x", None, None, [(0.5,)], None, None), (1, "x", None, None, [(None,)], None, None),
        (1, "x", None, None, [None], None, None), (1, "x", None, None, None, b"\x00", None), (1, "x", None, None, None, b"", None),
    ]
    frame = spark.createDataFrame(rows + rows, schema)
    assert frame.select(F.xxhash64("a", "b", "c")).distinct().count() < len(rows) - 7  # a plain hash skips nulls
    keys = [bytes(r[0]) for r in frame.select(row_key(frame)).collect()]
    assert len(set(keys)) == len(rows) and keys[: len(rows)] == keys[len(rows) :]
    times = spark.sql("SELECT array(timestamp'2020-01-01 00:00:00.000001') AS t UNION ALL SELECT array(timestamp'2020-01-01 00:00:00.000002')")
    assert times.select(row_key(times)).distinct().count() == 2
