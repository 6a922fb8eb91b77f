"""SentencePiece encoding and decoding with a streaming Viterbi search.

The best segmentation of a text under the scores stored in a SentencePiece model is found from left to right. Scores
are held for a window as long as the longest piece. Ids are committed whenever all surviving backpointer paths meet in
one boundary: at once where no piece reaches across a place, else as soon as the paths are followed back, which is done
after each window's length.

Where no piece of the model can cross a boundary (before a space mark that follows something else, in usual models), all
paths meet; what the search finds between two such boundaries is remembered and looked up when it comes again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

SPACE = "▁"
#: Stretches that are remembered at a time, and their length; longer ones are searched whenever they come.
MOST_KEPT, KEPT_CHARS = 200_000, 64
#: Places after which what lies before the last boundary is let go.
TRIM = 1024


class Pieces:
    """A model's pieces, read from the bytes of a SentencePiece model file."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(raw)
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that normalise texts can't be decoded to the same text")
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        self.unknown = 0
        has_bytes = False
        for k, p in enumerate(model.pieces):
            raw_piece = p.piece.replace(SPACE, " ").encode()
            if p.type in (p.NORMAL, p.USER_DEFINED):
                self.ids[p.piece], self.scores[p.piece] = k, p.score
            elif p.type == p.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = k
                raw_piece, has_bytes = bytes([int(p.piece[3:5], 16)]), True
            else:
                raw_piece = b""
                if p.type == p.UNKNOWN:
                    self.unknown, raw_piece = k, "⁇".encode()
            self.raw.append(raw_piece)
        self.bytes = self.bytes if has_bytes else None
        self.unknown_score = min(self.scores.values()) - 10
        self.longest = max(map(len, self.ids))
        #: (score of the piece that ends here or None, next character -> node, the piece's id)
        self.root: list = [None, {}, -1]
        for piece, score in self.scores.items():
            node = self.root
            for c in piece:
                node = node[1].setdefault(c, [None, {}, -1])
            node[0], node[2] = score, self.ids[piece]
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: stretches that no piece leaves; the whole text where pieces may hold a space mark inside
        self.stretch = re.compile(".+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.kept: dict[str, bytes] = {}

    def stream(self, text: str, every: int | None = None) -> Iterator[tuple[int, list[int]]]:
        """(boundary, ids up to it since the last one), committed as soon as the search finds all paths to meet.

        Paths are followed back after ``every`` places, by default as many as the longest piece has characters. What
        is held is that window and what stands before it since the last boundary; only a run so periodic that paths
        go on side by side ("aaaa" under pieces of three letters) delays a boundary to the run's end.
        """
        root, unknown, none = self.root[1], self.unknown_score, -float("inf")
        every = every or self.longest
        n, room = len(text), self.longest + 1
        # by place, from ``off`` on: best score, where its last piece begins, that piece's id
        size = min(n, TRIM) + room
        score, back, made = [none] * size, [0] * size, [-1] * size
        score[0] = 0.0
        off = done = reach = checked = 0
        for at in range(n):
            if reach == at:
                if at > done:  # no piece goes on beyond this place
                    yield at, self._ids(text, off, done, at, back, made)
                    done = checked = at
            elif at - checked >= every:
                checked = at
                paths = {p for p in range(at, reach + 1) if score[p - off] > none}
                while len(paths) > 1:
                    last = max(paths)
                    paths.remove(last)
                    paths.add(back[last - off])
                meet = paths.pop()
                if meet > done:
                    yield meet, self._ids(text, off, done, meet, back, made)
                    done = meet
            k = at - off
            if k >= TRIM:  # what lies before the last boundary is let go
                gone = done - off
                score, back, made = score[gone:] + [none] * (gone + room), back[gone:] + [0] * (gone + room), made[gone:] + [-1] * (gone + room)
                off, k = done, at - done
                if k + room > len(score):
                    score, back, made = score + [none] * TRIM, back + [0] * TRIM, made + [-1] * TRIM
            base, end, here = score[k], at + 1, k + 1
            node = root.get(text[at])
            if (node is None or node[0] is None) and base + unknown > score[here]:
                score[here], back[here], made[here] = base + unknown, at, -1
            if end > reach:
                reach = end
            while node is not None:
                found = node[0]
                if found is not None:
                    if base + found > score[here]:
                        score[here], back[here], made[here] = base + found, at, node[2]
                    if end > reach:
                        reach = end
                if end == n:
                    break
                node = node[1].get(text[end])
                end += 1
                here += 1
        if n > done:
            yield n, self._ids(text, off, done, n, back, made)

    def _ids(self, text: str, off: int, done: int, end: int, back: list, made: list) -> list[int]:
        """The ids of the best path from the boundary ``done`` to ``end``."""
        out: list[int] = []
        while end > done:
            piece, start = made[end - off], back[end - off]
            if piece >= 0:
                out.append(piece)
            else:
                out += reversed(self.named(text[start:end]))
            end = start
        out.reverse()
        return out

    def named(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encoded(self, stretch: str) -> bytes:
        known = self.kept.get(stretch)
        if known is None:
            known = array("i", [i for _, ids in self.stream(stretch) for i in ids]).tobytes()
            if len(stretch) <= KEPT_CHARS:
                if len(self.kept) >= MOST_KEPT:
                    self.kept.clear()
                self.kept[stretch] = known
        return known

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = self.prefix + text.replace(" ", SPACE)
        known = self.kept.get
        return np.frombuffer(b"".join([known(s) or self.encoded(s) for s in self.stretch.findall(marked)]), np.int32)

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_loaded: dict[int, Pieces] = {}


def _pieces(raw: bytes) -> Pieces:
    key = hash(raw)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(raw)
    return _loaded[key]


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ids (array of int), n_ids and round_trip to every row.

    ``round_trip`` tells whether decoding the ids gives the text back: always, but for texts that hold the space
    mark U+2581 itself, which decodes to a space. Null texts have null ids, empty ones no ids; both round-trip.
    Whole texts of any length; no shuffle. Columns of the same names are replaced. ``path`` names a SentencePiece
    model file on the driver; it is of bounded size and broadcast.
    """
    with open(path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(texts: list) -> dict[str, list]:
        import pyarrow as pa

        pieces = _pieces(model.value)
        done: dict = {}  # texts that repeat in a slice, as a mix's copies do, are searched once
        for t in texts:
            if t not in done:
                done[t] = pieces.encode(t)
        made = [done[t] for t in texts]
        sizes = np.array([len(x) for x in made], np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)))
        return {"ids": ids, "n_ids": sizes, "round_trip": [pieces.decode(x.tolist()) == (t or "") for x, t in zip(made, texts)]}

    return map_texts(docs, text, work, "ids array<int>, n_ids long, round_trip boolean")


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text of each row's ids; null ids give null. Ids that the model doesn't have raise an error."""
    from pyspark.sql.types import StringType, StructField, StructType

    with open(path, "rb") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())
    kept = encoded.drop(to) if to != ids else encoded
    at = kept.columns.index(ids)
    schema = StructType([*kept.schema.fields, StructField(to, StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pieces = _pieces(model.value)
            texts = [None if x is None else pieces.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return kept.mapInArrow(run, schema)
