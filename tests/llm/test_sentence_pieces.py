import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from sinkweave.llm.queries import TOKENIZER
from sinkweave.llm.sentence_pieces import Pieces, decode_ids, encode_texts

TEXTS = ["", " ", "a", "The cat sat on the mat.", "  two  spaces   three", "Éàü ñ ß 东京 日本語 🎉 \x00\x07", "line\nbreak\ttab\r\n", "trailing ", "x" * 5000, "The" * 3000 + " end", "ab " * 4000, "\n", "東" * 300]


@pytest.fixture(scope="module")
def raw():
    with open(TOKENIZER, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def pieces(raw):
    return Pieces(raw)


def whole(pieces, text):
    """Plain Viterbi over a whole text."""
    text = pieces.prefix + text.replace(" ", "▁")
    best = [(0.0, -1)] + [None] * len(text)
    for at in range(len(text)):
        ends = [(end, pieces.scores[text[at:end]]) for end in range(at + 1, min(len(text), at + pieces.longest) + 1) if text[at:end] in pieces.scores]
        if not any(end == at + 1 for end, _ in ends):
            ends.append((at + 1, pieces.unknown_score))
        for end, score in ends:
            if best[end] is None or best[at][0] + score > best[end][0]:
                best[end] = (best[at][0] + score, at)
    out, end = [], len(text)
    while end:
        out[:0] = pieces.named(text[best[end][1] : end])
        end = best[end][1]
    return out


def sample(spark, sf, n=40):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(n).collect()]


def test_same_as_whole_search_and_round_trip(pieces, spark, sf):
    for text in TEXTS + [t[:3000] for t in sample(spark, sf)]:
        ids = pieces.encode(text).tolist()
        assert ids == (whole(pieces, text) if text else [])
        assert pieces.decode(ids) == text


def test_same_as_the_library(raw, spark, sf):
    """The library's own search over the same pieces and scores.

    It adds scores in single precision, so the model's placeholder of -1e9 is replaced on both sides.
    """
    model = pb.ModelProto()
    model.ParseFromString(raw)
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p in model.pieces:
        p.score = max(p.score, -50000.0)
    pieces = Pieces(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in sample(spark, sf):
        text = text.replace("\n", " ")
        assert pieces.encode(text).tolist() == library.encode(text)
        assert library.decode(pieces.encode(text).tolist()) == text


def test_commits_early_and_in_any_rhythm(pieces):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdetion ") for _ in range(4000)).replace(" ", "▁")
    want = [i for _, ids in pieces.stream(text, 10**9) for i in ids]
    for every in (None, 1, 3, 64):
        parts = list(pieces.stream(text, every))
        assert [i for _, ids in parts for i in ids] == want
        assert len(parts) > 20 and parts[-1][0] == len(text)


def test_window_is_bounded_where_pieces_reach_across_every_place(raw):
    """Pieces a, aa, aaa ... never leave a place that no piece crosses; paths still meet, and ids come out all along."""
    model = pb.ModelProto()
    model.ParseFromString(raw)
    own = {"a": -1.0, "aa": -1.9, "aaa": -2.7, "ab": -1.2, "ba": -1.1, "aab": -2.0, "▁a": -1.0}
    for k, p in enumerate(q for q in model.pieces if q.type == q.NORMAL):
        p.piece, p.score = list(own.items())[k] if k < len(own) else (f"zz{k}", -50.0)
    pieces = Pieces(model.SerializeToString())
    rng = random.Random(3)
    for text in ("a" * 500, "".join(rng.choice("aaab") for _ in range(3000))):
        parts = list(pieces.stream(text))
        assert [i for _, ids in parts for i in ids] == [i for _, ids in pieces.stream(text, 10**9) for i in ids]
        ends = [0] + [end for end, _ in parts]
        # all of one letter is the exception: three paths of pieces "aaa" run side by side to the end
        assert set(text) == {"a"} or max(b - a for a, b in zip(ends, ends[1:])) <= 8 * pieces.longest
        assert pieces.encode(text).tolist() == whole(pieces, text)


def test_frames(spark):
    docs = spark.createDataFrame([(1, "Hello there", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, n_ids string")
    made = encode_texts(docs, TOKENIZER)
    rows = {(r["doc_id"], r["text"]): r for r in made.collect()}
    assert made.count() == 4 and rows[2, None]["ids"] is None and rows[3, ""]["ids"] == [] and all(r["round_trip"] for r in rows.values())
    back = decode_ids(made.select("doc_id", "ids"), TOKENIZER)
    assert sorted((r["doc_id"], r["text"] or "") for r in back.collect()) == [(1, "Hello there"), (2, ""), (3, ""), (3, "")]
    assert encode_texts(spark.createDataFrame([], "text string"), TOKENIZER).count() == 0
