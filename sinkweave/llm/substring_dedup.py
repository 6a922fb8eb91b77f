"""Substring deduplication by hashing paragraphs of consecutive lines and sentences.

A text is cut into pieces at line ends and after sentence ends. From each piece on, the fewest consecutive pieces that
hold ``UNIT_WORDS`` words are a unit, so units overlap, and a passage is found wherever it stands. Units are normalised
(case, white space) and digested; digests are grouped globally; the occurrence that ranks first, by document and place,
stays, and later ones are removed with their original offsets on record.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, fresh, rekeyed, row_key, slices

#: Words of a unit. Lines and sentences of fewer words repeat by chance and are no passages by themselves.
UNIT_WORDS = 20
#: Where a piece ends.
END = re.compile(r"[.!?]+[ \t\r\x0b\x0c]+\n?|\n")


def pieces(text: str) -> list[tuple[int, int]]:
    """Spans that tile the text, each up to a line's end or the white space after a sentence's end."""
    ends = [m.end() for m in END.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def units(text: str, spans: list[tuple[int, int]], size: int) -> tuple[list[tuple[int, int]], list[bytes], list[int]]:
    """(first piece, piece after the last) of each unit; the text's words; the word at which each piece begins."""
    words: list[bytes] = []
    begin = [0]
    for a, b in spans:
        words += text[a:b].lower().encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII spaces
        begin.append(len(words))
    out, end = [], 0
    for k in range(len(spans)):
        while end < len(spans) and begin[end] - begin[k] < size:
            end += 1
        if begin[end] - begin[k] < size:
            break
        if begin[k + 1] > begin[k]:
            out.append((k, end))
    return out, words, begin


def digests(texts: list, size: int) -> tuple[list, list, bytes]:
    """(index of the text, first piece, 16-byte digest) of every unit, the digests joined."""
    from xxhash import xxh3_128_digest

    owners, places, found = [], [], []
    for n, text in enumerate(texts):
        made, words, begin = units(text or "", pieces(text or ""), size)
        owners += [n] * len(made)
        for k, end in made:
            places.append(k)
            found.append(xxh3_128_digest(b" ".join(words[begin[k] : begin[end]])))
    return owners, places, b"".join(found)


def hashed_units(thin: DataFrame, size: int) -> DataFrame:
    """(doc, row, i, x, y), one row a unit that begins at piece i, of (doc, row, text)."""
    schema = StructType([*thin.drop("text").schema.fields, *StructType.fromDDL("i int, x long, y long").fields])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 2):
                owners, places, found = digests(batch.column(2).to_pylist(), size)
                halves = np.frombuffer(found, np.int64).reshape(-1, 2)
                at = pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc", "row", "i", "x", "y"])

    return thin.mapInArrow(run, schema)


def cut_out(texts: list, repeated: list, size: int) -> tuple[list, list, list]:
    """(texts without repeats, removed spans, numbers of units)."""
    left, removed, sizes = [], [], []
    for text, again in zip(texts, repeated):
        spans = pieces(text or "")
        made, _, _ = units(text or "", spans, size)
        sizes.append(len(made))
        again = set(again or ())
        joined: list = []
        for k, end in made:
            if k in again:
                a, b = spans[k][0], spans[end - 1][1]
                if joined and joined[-1]["end"] >= a:
                    joined[-1]["end"] = b
                else:
                    joined.append({"start": a, "end": b})
        kept, at = [], 0
        for s in joined:
            kept.append(text[at : s["start"]])
            at = s["end"]
        left.append(text if not joined else "".join(kept) + text[at:])
        removed.append(joined)
    return left, removed, sizes


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = UNIT_WORDS) -> DataFrame:
    """The input's rows with repeats removed from ``text``, and three more columns.

    Every later occurrence of a unit goes whole, and nothing goes that is not part of one. What ranks first stays, so
    one copy of everything is left somewhere.

    ``removed`` has the (start, end) of what was taken out, in code points of the original text; ``original`` is
    that text's length; ``n_units`` its number of units. The first occurrence ranks by doc_id (nulls last), row
    and place. Rows that repeat exactly count as one document; null texts stay null, empty ones empty; texts of fewer
    words than a unit stay whole; columns of the input that bear a new name are replaced.

    A digest that very many documents share is pre-aggregated for its first occurrence; that table is shuffled and
    joined back, in partitions that Spark can split (see ``rekeyed``).
    """
    new = ("removed", "original", "n_units")
    docs = docs.drop(*new)
    row, again = fresh(docs, "_row"), fresh(docs, "_again")
    keyed = docs.withColumn(row, row_key(docs))
    thin = keyed.select(F.col(f"`{doc_id}`").alias("doc"), F.col(row).alias("row"), F.col(f"`{text}`").alias("text"))
    each = hashed_units(thin, size)
    # numbers only, so all units pass one hash aggregation; what follows sees repeated digests alone
    often = rekeyed(each.groupBy("x", "y").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "x")
    shared = cut(each.join(often, ["x", "y"]))
    first = rekeyed(shared.where("doc <=> least").groupBy("x", "y").agg(F.min(F.struct("row", "i")).alias("first")), "x")
    later = shared.join(first, ["x", "y"]).where("NOT (doc <=> least AND row = first.row AND i = first.i)").select(F.col("row").alias(row), "i")
    later = later.groupBy(row).agg(F.collect_set("i").alias(again))
    joined = keyed.join(later, row, "left").drop(row)
    columns, at, told = list(docs.columns), docs.columns.index(text), len(docs.columns)
    fields = StructType.fromDDL("removed array<struct<start:int,end:int>>, original long, n_units long").fields
    schema = StructType(list(docs.schema.fields) + list(fields))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts = batch.column(at).to_pylist()
            left, removed, sizes = cut_out(texts, batch.column(told).to_pylist(), size)
            out = [batch.column(k) for k in range(told)]
            out[at] = pa.array(left, type=types.field(at).type)
            more = (removed, [len(t or "") for t in texts], sizes)
            out += [pa.array(v, type=types.field(c).type) for c, v in zip(new, more)]
            yield pa.RecordBatch.from_arrays(out, names=columns + list(new))

    return joined.mapInArrow(run, schema)
