"""The pipeline's stages, each against brute force on the small tables."""

from collections import Counter

import pytest

from sinkweave.llm.queries import TOKENIZER
from sinkweave.llm.sentence_pieces import Pieces

from .test_mixing import plain as plain_mix
from .test_order_minhash import classes
from .test_quality_rules import brute
from .test_secret_scan import plain as plain_secrets

cp = pytest.importorskip("corpus_pipeline")


def plain(rows):
    return Counter(tuple(r) for r in rows)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    assert [n for n, _ in cp.STAGES] == ["quality rules", "minhash near-dedup", "secret scans", "mixing", "sentencepiece"]
    stage = dict(cp.STAGES)

    docs = stage["quality rules"](spark, docs, sf)
    kept = [r for r in rows if brute(r["text"])["kept"]]
    assert docs.columns == columns and plain(docs.collect()) == plain(kept)

    docs = stage["minhash near-dedup"](spark, docs, sf)
    own = classes([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if own[r["doc_id"]] == r["doc_id"]]
    assert docs.columns == columns and plain(docs.collect()) == plain(kept)

    docs = stage["secret scans"](spark, docs, sf)
    masked = docs.collect()
    assert docs.columns == columns and sorted(r["doc_id"] for r in masked) == sorted(r["doc_id"] for r in kept)
    before = {r["doc_id"]: r["text"] for r in kept}
    for r in masked:
        text, at, out = before[r["doc_id"]], 0, []
        for _, _, end, _, value in plain_secrets(text):
            if end - len(value) >= at:
                out += [text[at : end - len(value)], "[secret]"]
                at = end
        assert r["text"] == "".join(out) + text[at:] and r["n_chars"] == len(r["text"])

    docs = stage["mixing"](spark, docs, sf)
    mixed = docs.collect()
    assert docs.columns == columns and set(plain(mixed)) <= set(plain(masked)) and max(plain(mixed).values()) <= 3
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    plan = {d: (n, taken) for d, n, _, _, taken in plain_mix([(r["doc_id"], r["text"], r["source"]) for r in masked], labels)}
    copies = Counter(r["doc_id"] for r in mixed)
    assert all(copies[d] * n == taken for d, (n, taken) in plan.items()) and set(copies) <= set(plan)

    made = stage["sentencepiece"](spark, docs, sf).collect()
    with open(TOKENIZER, "rb") as file:
        pieces = Pieces(file.read())
    assert Counter((r["doc_id"], pieces.decode(r["ids"])) for r in made) == Counter((r["doc_id"], r["text"]) for r in mixed)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in made) == Counter((r["doc_id"], tuple(r["ids"])) for r in cp.run(spark, sf).collect())
