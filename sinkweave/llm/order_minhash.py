"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's five-word k-mers are labelled with their occurrence. Each of ``TUPLES`` hash functions picks the two
smallest labelled k-mers; kept in the order in which they stand in the text they form a tuple, so a match needs
the same k-mers in the same order. Documents that share a tuple are candidates. A candidate pair is a link if a banded
alignment of the whole texts, word by word, finds an edit similarity of ``SIMILARITY`` or more.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt, map_groups
from .common import cut, digest, fresh, map_texts, numbered, rekeyed, row_key, small
from .graph import connected_components

K = 5
SIMILARITY = 0.8
#: Texts of edit similarity 0.8 whose edits fall at random places share a tuple with a probability of about 0.04.
TUPLES = 64
#: Cells of a text's word counts, by which pairs that can't be similar are told without reading the texts.
CELLS = 128
#: Rows of one bucket that one task compares with as many others.
BLOCK = 4000
#: Words of a family's texts that one task aligns with as many others; more in families of over ``SPLITS`` such parts.
FAMILY_WORDS = 64_000
SPLITS = 32
#: Words that one task holds of either part, but for texts that are longer.
MOST_WORDS = 2_000_000
#: Texts of more words are aligned one pair at a time.
LONG = 5000
#: Cells of the bands that are worked on together; they stay in a processor's cache.
BAND_CELLS = 65_536
#: Bytes of the texts that are broadcast to be aligned.
BROADCAST_BYTES = 16_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of all runs of K words of each text; a shorter text is one run. ``words`` are 64-bit hashes."""
    sizes = np.diff(bounds)
    counts = np.maximum(1, sizes - K + 1)
    own = np.concatenate([[0], np.cumsum(counts)])
    start = np.arange(own[-1]) - np.repeat(own[:-1] - bounds[:-1], counts)
    width = np.minimum(K, np.repeat(sizes, counts))
    out = width.astype(np.uint64)
    for k in range(K):
        next_ = mixed(out * PRIME + words[np.minimum(start + k, len(words) - 1)])
        out = np.where(k < width, next_, out) if (width <= k).any() else next_
    return out, own


def labelled(shingles: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Shingles mixed with the number of their occurrence in the same text."""
    both = mixed(shingles + owner.astype(np.uint64) * PRIME)
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = both[order[1:]] == both[order[:-1]]
    if not same.any():
        return shingles
    at = np.arange(len(order))
    occurrence = np.zeros(len(order), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    return np.where(occurrence > 0, mixed(shingles + occurrence * PRIME), shingles)


def sketches(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, TUPLES) tuple hashes; every text has a shingle at least.

    A hash's low bits are replaced by the shingle's place, so a minimum tells where it stands; ties keep the first.
    """
    sizes = np.diff(bounds)
    first = bounds[:-1]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shingles = labelled(shingles, owner)
    place = (np.arange(len(shingles)) - np.repeat(first, sizes)).astype(np.uint64)
    bits = np.uint64(max(1, int(sizes.max()).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    alone = sizes == 1
    out = np.empty((len(sizes), TUPLES), np.uint64)
    for j in range(TUPLES):
        factor = int(mixed(np.array([j + 1], np.uint64))[0]) | 1
        x = shingles * np.uint64(factor)
        x &= ~low
        x |= place
        a = (np.minimum.reduceat(x, first) & low).astype(np.int64) + first
        x[a] = np.uint64(2**64 - 1)
        b = (np.minimum.reduceat(x, first) & low).astype(np.int64) + first
        b = np.where(alone, a, b)
        out[:, j] = mixed(mixed(shingles[np.minimum(a, b)]) * PRIME + shingles[np.maximum(a, b)] + np.uint64(j))
    return out


def words_of(text: str | None) -> list[bytes]:
    """A text's words in lower case; bytes split at exactly the six ASCII spaces."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


SPACES = re.compile(rb"[\x20\x09-\x0d]")
CHUNK = 1 << 20


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are in words, a number for each byte, and powers of an odd number with their inverses modulo 2^64."""
    inside = np.ones(256, bool)
    inside[list(b" \t\n\x0b\x0c\r")] = False
    return inside, mixed(np.arange(1, 257, dtype=np.uint64)), *_powers(CHUNK + 4096)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(PRIME), pow(int(PRIME), -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, starts) of a text's words, by sums over its bytes; equal words have equal hashes."""
    inside, values, powers, inverse = _tables()
    hashes, begin, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        if end < len(raw):  # chunks end between words
            m = SPACES.search(raw, end)
            end = m.start() if m else len(raw)
        c = np.frombuffer(raw, np.uint8, end - at, at)
        up, down = (powers, inverse) if len(c) <= len(powers) else _powers(len(c))
        edges = np.diff(np.concatenate([[0], inside[c].view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(values[c] * up[: len(c)], out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        begin.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(begin)


#: Characters of the texts that are described together; their numbers stay in a processor's cache.
TOGETHER = 200_000


def describe(texts: list) -> dict[str, list]:
    """Identity of each text's words, their number, its tuples and word counts; nulls for texts without words."""
    out: dict[str, list] = {"words": [], "n_words": [], "tuples": [], "counts": []}
    low = size = 0
    for k, text in enumerate([*texts, None]):
        if k == len(texts) or (k > low and size + len(text or "") > TOGETHER):
            for name, values in _described(texts[low:k]).items():
                out[name] += values
            low, size = k, 0
        size += len(text or "")
    return out


def _described(texts: list) -> dict[str, list]:
    from hashlib import blake2b

    lowered = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    ids = [blake2b(b" ".join(x.split()), digest_size=16).digest() for x in lowered]
    words, starts = word_hashes(b"\n".join(lowered))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in lowered)]))
    lengths = np.diff(bounds)
    some = np.flatnonzero(lengths)
    tuples: list = [None] * len(texts)
    counts: list = [None] * len(texts)
    if len(some):
        own = np.append(bounds[some], len(words))
        found = sketches(*kmers(words, own)).view(np.int64)
        owner = np.repeat(np.arange(len(some)), np.diff(own))
        cells = np.bincount(owner * CELLS + (words % np.uint64(CELLS)).astype(np.int64), minlength=len(some) * CELLS).reshape(-1, CELLS)
        cells = np.minimum(cells, 32767).astype(np.int16)
        for n, k in enumerate(some.tolist()):
            tuples[k], counts[k] = found[n], cells[n].tobytes()
    return {"words": [x if n else None for x, n in zip(ids, lengths)], "n_words": lengths.tolist(), "tuples": tuples, "counts": counts}


def most_edits(longer: int, similarity: float = SIMILARITY) -> int:
    """Edits that two texts may be apart, the longer of so many words."""
    return int((1 - similarity) * longer + 1e-9)


def banded_distance(a: list, b: list, limit: int) -> int:
    """Edit distance of two sequences if it is at most ``limit``, else ``limit`` + 1.

    A band of 2 * limit + 2 diagonals is kept as the bits of integers: differences between cells that stand one above
    the other. It moves down one row with every column, so memory is linear in the band and time in the band's words.
    """
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    if not b:
        return len(a)
    # the band widens until the distance fits into it
    tried = min(limit, max(len(a) - len(b), 16))
    while True:
        found = _within(a, b, tried)
        if found <= tried or tried == limit:
            return min(found, limit + 1)
        tried = min(limit, 4 * tried)


class Places(dict):
    """For each symbol the places where it stands in a sequence; windows of them as bits."""

    def __init__(self, sequence: list):
        for k, symbol in enumerate(sequence):
            self.setdefault(symbol, []).append(k)

    def window(self, symbol, start: int, width: int) -> int:
        """Bit i is set if the symbol stands at ``start`` + i, for i below ``width``."""
        own = self.get(symbol)
        if own is None:
            return 0
        low, high = bisect_left(own, start), bisect_left(own, start + width)
        if high - low > 16:
            marks = np.zeros(width, bool)
            marks[np.array(own[low:high]) - start] = True
            return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
        bits = 0
        for at in own[low:high]:
            bits |= 1 << (at - start)
        return bits


def _within(a: list, b: list, k: int) -> int:
    """Edit distance if it is at most ``k``, else more than ``k``; ``a`` is the longer one, by at most ``k``."""
    k = min(k, len(a) - 1)
    width = 2 * k + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    places = Places(a)
    # rows above the first (start is negative there) have no differences; below it each is one more than the one above
    plus, minus = full ^ ((1 << (width - k - 1)) - 1), 0
    start = k + 1 - width
    at = k  # the cell in the band's last row
    follow = len(a) - k  # columns until that row is the last of ``a``
    row = top >> 1
    most = k + len(b) - follow  # in the columns after that the cell falls by one at most
    for j, symbol in enumerate(b):
        match = places.window(symbol, start, width) if start >= 0 else (places.window(symbol, 0, width + start) << -start)
        through = ((((match & plus) + plus) ^ plus) | match | minus) & full
        across = minus | (full ^ (through | plus))
        back = through & plus
        if j < follow:
            at += not through & top
            if at > most:
                return k + 1
        else:
            at += bool(across & row) - bool(back & row)
            row >>= 1
        down = through >> 1
        plus = back | (full ^ (down | across))
        minus = down & across
        start += 1
    return at


def nearby(a: list, b: list, allowed: int, ahead: int = 6) -> int:
    """Edits of an alignment that goes on, after each mismatch, where two words in a row agree again within ``ahead``.

    It is never less than the edit distance; more than ``allowed`` as soon as that is sure.
    """
    ids: dict = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in words] + [-1 - k] * (ahead + 2)) for k, words in enumerate((a, b)))
    n, m, i, j, edits = len(a), len(b), 0, 0, 0
    while i < n and j < m:
        size = min(n - i, m - j, 512)
        differ = x[i : i + size] != y[j : j + size]
        at = int(differ.argmax())
        if not differ[at]:
            i, j = i + size, j + size
            continue
        i, j = i + at, j + at
        own, other = x[i : i + ahead + 2].tolist(), y[j : j + ahead + 2].tolist()
        step = (1, 1)
        for far in range(1, ahead + 1):
            found = next(((p, q) for p, q in ((far, far), *((far, q) for q in range(far)), *((p, far) for p in range(far))) if own[p] == other[q] and own[p + 1] == other[q + 1]), None)
            if found:
                step = found
                break
        i, j, edits = i + step[0], j + step[1], edits + max(step)
        if edits > allowed:
            return edits
    return edits + max(n - i, m - j, 0)


def alike(one: str, two: str, similarity: float = SIMILARITY) -> bool:
    """Whether the words of two texts are near-duplicates.

    Alignments that are found in one go may show it; where they don't, the band decides.
    """
    a, b = words_of(one), words_of(two)
    allowed = most_edits(max(len(a), len(b)), similarity)
    return bool(a and b) and (nearby(a, b, allowed) <= allowed or banded_distance(a, b, allowed) <= allowed)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the (a, b) pairs of text numbers that are near-duplicates.

    Where many pairs are made of few texts, those are broadcast instead of travelling with each pair, if their bytes
    are counted to be few.
    """
    if (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES:
        texts = F.broadcast(texts)
    joined = pairs.join(texts.select(F.col("no").alias("a"), F.col("text").alias("one")), "a")
    joined = joined.join(texts.select(F.col("no").alias("b"), F.col("text").alias("two")), "b").select("a", "b", "one", "two")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = [alike(left[k].as_py(), right[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _cells(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int16).reshape(-1, CELLS)


def _possible(apart: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether word counts that differ by so much leave room for similarity: an edit changes two counts at most."""
    return apart <= 2 * np.floor((1 - SIMILARITY) * longer + 1e-9)


def possible(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The (a, b) pairs without those whose lengths or word counts differ too much for any alignment to be similar."""
    wide = pairs.join(sketched.select(F.col("no").alias("a"), F.col("n_words").alias("m"), F.col("counts").alias("one")), "a")
    wide = wide.join(sketched.select(F.col("no").alias("b"), F.col("n_words").alias("n"), F.col("counts").alias("two")), "b")
    wide = wide.where(F.least("m", "n") >= SIMILARITY * F.greatest("m", "n") - 1e-9).select("a", "b", F.greatest("m", "n").alias("longer"), "one", "two")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                apart = np.abs(_cells(batch.column(3).to_pylist()) - _cells(batch.column(4).to_pylist())).sum(1, dtype=np.int64)
                good = pa.array(_possible(apart, batch.column(2).to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], names=["a", "b"])

    return wide.mapInArrow(run, "a long, b long")


def block_pairs(group: dict, forest: bool = False) -> dict:
    """Pairs of one block, or pair of blocks, of a bucket that are in different components and may be similar.

    With ``forest`` only as many of them as it takes to join all texts that the pairs join, in rows: fewer than texts.
    """
    order = np.argsort(group["n_words"], kind="stable")
    no, component, own, step, length = (group[c][order] for c in ("no", "component", "own", "step", "n_words"))
    here, cross = group["at"][0], group["i"][0] != group["j"][0]
    left, right = [], []
    if (component != component[0]).any() and (not cross or (own != own[0]).any()):
        cells = _cells(group["counts"][order])
        ends = np.searchsorted(length, np.floor(length / SIMILARITY + 1e-9), "right")
        tree = np.arange(len(no))
        for k in range(len(no) - 1):
            near = slice(k + 1, ends[k])
            open_ = component[near] != component[k]
            if here != WHOLE:  # texts of steps s and s - 1 meet at s; a pair counts at the larger of its steps
                open_ &= np.maximum(step[near], step[k]) == here
            if cross:
                open_ &= own[near] != own[k]
            if forest:
                open_ &= tree[near] != tree[k]
            others = np.flatnonzero(open_) + k + 1
            others = others[_possible(np.abs(cells[others] - cells[k]).sum(1, dtype=np.int32), length[others])]
            if forest and len(others):
                trees, at = np.unique(tree[others], return_index=True)
                others = others[at]
                tree[np.isin(tree, trees)] = tree[k]
            left.append(np.minimum(no[others], no[k]))
            right.append(np.maximum(no[others], no[k]))
    return {"a": np.concatenate(left or [no[:0]]), "b": np.concatenate(right or [no[:0]])}


#: Stands for all steps of length where a bucket isn't cut into them.
WHOLE = -1


def further_pairs(rows: DataFrame, sketched: DataFrame, forest: bool = False) -> DataFrame:
    """(a, b) pairs of texts that share a bucket, are in different components and may be similar.

    Rows are (bucket, no, component, n_words). Texts of a bucket of more than ``BLOCK`` are compared in steps of
    length, as similar ones are of about one length, and in blocks, so a task holds two blocks of a bucket's step at a
    time. Only lengths and word counts of a fixed size travel to the blocks, not texts. With ``forest`` a block gives
    fewer pairs than it has texts, which join the same texts as all of them do.
    """
    step = F.floor(F.log(F.col("n_words").cast("double")) / F.lit(float(np.log(1 / SIMILARITY)))).cast("int")
    large = rekeyed(rows.groupBy("bucket").agg(F.count("*").alias("_rows")).where("_rows > 1"), "bucket")
    rows = rows.withColumn("step", step).join(large, "bucket")
    rows = rows.withColumn("at", F.explode(F.when(F.col("_rows") > BLOCK, F.array("step", F.col("step") + 1)).otherwise(F.array(F.lit(WHOLE))))).drop("_rows")
    met = dealt(rows, ["bucket", "at"], "no", BLOCK).join(sketched.select("no", "counts"), "no")
    return map_groups(met, ["bucket", "at"], lambda group: block_pairs(group, forest), "a long, b long").distinct()


def close(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether sequences of word numbers, in pairs, are near-duplicates; pairs of like lengths are aligned together."""
    out = np.zeros(len(pairs), bool)
    order = sorted(range(len(pairs)), key=lambda k: max(map(len, pairs[k])))
    low = 0
    while low < len(order):
        longest, high = max(map(len, pairs[order[low]])), low + 1
        if longest > LONG:
            one, two = (x.tolist() for x in pairs[order[low]])
            out[order[low]] = banded_distance(one, two, most_edits(longest, similarity)) <= most_edits(longest, similarity)
        else:
            while high < len(order) and (n := max(map(len, pairs[order[high]]))) <= min(LONG, 1.2 * longest + 8) and (high - low) * (most_edits(n, similarity) // 2 + 2) < BAND_CELLS:
                high += 1
            out[order[low:high]] = _aligned([pairs[k] for k in order[low:high]], similarity)
        low = high
    return out


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """``close`` for pairs of up to ``LONG`` words: the band of edit distances, all pairs at once by antidiagonals.

    Cell (i, j) is on diagonal i - j and antidiagonal i + j. A path to the last cell, on the diagonal that is the
    difference of lengths, leaves neither end's diagonal by more than half of the edits that the difference spares.
    """
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in pairs]
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    limit = np.array([most_edits(int(k), similarity) for k in n])
    spare = np.maximum(limit - (n - m), 0) // 2
    first, last = -int(spare.max()), int((n - m + spare).max())
    width, edge = (last - first) // 2 + 1, last - first + 4
    one = np.full((int(n.max()) + 2 * edge, len(pairs)), -1, np.int32)
    two = np.full((int(m.max()) + 2 * edge, len(pairs)), -2, np.int32)  # from its end to its start
    for k, (x, y) in enumerate(pairs):
        one[edge : edge + len(x), k] = x
        two[edge + int(m.max()) - len(y) : edge + int(m.max()), k] = y[::-1]
    far = 16_000  # and 2 * LONG more are a 16-bit number still
    before = np.full((width + 2, len(pairs)), far, np.int16)  # a row of cells that can't be reached at either end
    now, new = before.copy(), before.copy()
    out = np.full(len(pairs), far, np.int64)
    ending: dict = {}
    for k, t in enumerate((n + m).tolist()):
        ending.setdefault(t, []).append(k)
    for t in range(int((n + m).max()) + 1):
        odd = (t - first) % 2
        if t:
            i, j = (t + first + odd) // 2, (t - first - odd) // 2  # of the band's first cell; i grows and j falls
            differ = one[edge + i - 1 : edge + i - 1 + width] != two[edge + int(m.max()) - j : edge + int(m.max()) - j + width]
            cells = new[1:-1]
            np.minimum(now[odd : odd + width], now[odd + 1 : odd + 1 + width], out=cells)
            cells += 1
            np.minimum(cells, before[1:-1] + differ, out=cells)
            before, now, new = now, new, before
        else:
            now[1 + (-first - odd) // 2] = 0
        for k in ending.get(t, ()):
            out[k] = now[1 + (int(n[k] - m[k]) - first - odd) // 2, k]
        if t % 128 == 127 and (np.minimum(now.min(0), before.min(0)) > limit)[n + m > t].all():
            break
    return (out <= limit) & (m > 0) & (n - m <= limit)


def family_links(group: dict) -> dict:
    """Links between texts of one part, or pair of parts, of a family: fewer than texts, in place of all that there are.

    A pair is aligned if it shares a tuple and is in different components, those joined before by links of the same
    task taken as one, and if its lengths and its words, each with its number of occurrences, leave room for similarity.
    """
    order = np.argsort(group["n_words"], kind="stable")
    no, component, own, length = (group[c][order] for c in ("no", "component", "own", "n_words"))
    cross = group["i"][0] != group["j"][0]
    found: list[tuple[int, int]] = []
    if (component != component[0]).any() and (not cross or (own != own[0]).any()):
        tuples = np.stack(group["tuples"][order])
        ids: dict = {}
        words = [np.array([ids.setdefault(w, len(ids)) for w in words_of(text)], np.int32) for text in group["text"][order]]
        bags = _bags(words)
        here = np.zeros(max(int(x.max()) for x in bags) + 1, bool)
        ends = np.searchsorted(length, np.floor(length / SIMILARITY + 1e-9), "right")
        component = np.unique(component, return_inverse=True)[1]
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0
        for k in range(len(no)):
            near = slice(k + 1, ends[k])
            good = component[near] != component[k]
            if cross:
                good &= own[near] != own[k]
            others = np.flatnonzero(good) + k + 1
            others = others[(tuples[others] == tuples[k]).any(1)]
            if len(others):
                here[bags[k]] = True
                common = np.array([np.count_nonzero(here[bags[x]]) for x in others])
                here[bags[k]] = False
                allowed = np.floor((1 - SIMILARITY) * length[others] + 1e-9)
                edits = length[others] - common  # the longer text's words that the other one lacks
                fits = edits <= allowed
                waiting.append((np.full(int(fits.sum()), k), others[fits], (edits / np.maximum(allowed, 1))[fits]))
                size += int(fits.sum())
            if waiting and (size > 50_000 or k == len(no) - 1):
                found += _joined(waiting, component, words)
                waiting, size = [], 0
    a, b = (np.array([no[p[k]] for p in found], np.int64) for k in (0, 1))
    return {"a": np.minimum(a, b), "b": np.maximum(a, b)}


def _bags(words: list[np.ndarray]) -> list[np.ndarray]:
    """For each text numbers of its words with their occurrences: two texts share as many as their words have in common."""
    sizes = [len(x) for x in words]
    whole, owner = np.concatenate(words).astype(np.int64), np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((whole, owner))
    at = np.arange(len(order))
    same = np.zeros(len(order), bool)
    same[1:] = (whole[order[1:]] == whole[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    occurrence = at - np.maximum.accumulate(np.where(same, 0, at))
    numbers = np.unique(whole[order] * (int(max(sizes)) + 1) + occurrence, return_inverse=True)[1]
    return np.split(numbers, np.cumsum(sizes)[:-1])


def _joined(waiting: list[tuple[np.ndarray, ...]], component: np.ndarray, words: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links among pairs of places that wait, nearest words first; joins their components, and leaves out what is joined."""
    a, b, bound = (np.concatenate([w[c] for w in waiting]) for c in range(3))
    order = np.argsort(bound, kind="stable")
    a, b = a[order], b[order]
    found = []
    together = 64
    while len(a):
        one, two = a[:together], b[:together]
        for x, y in zip(*(p[close([(words[x], words[y]) for x, y in zip(one, two)])].tolist() for p in (one, two))):
            if component[x] != component[y]:
                found.append((x, y))
                component[component == component[y]] = component[x]
        a, b = a[together:], b[together:]
        apart = component[a] != component[b]
        a, b = a[apart], b[apart]
        together = min(2 * together, 1024)
    return found


def links_within(families: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) links that join all texts of each family that near-duplicate pairs join.

    Rows of families are (family, no, component, n_words, tuples), of texts (no, text). A text travels to the parts of its own family only: ``SPLITS`` times at most, until parts hold ``MOST_WORDS``.
    """
    words = F.sum("n_words")
    parts = F.greatest(words / MOST_WORDS, F.count("*") / BLOCK, F.least(words / FAMILY_WORDS, F.lit(float(SPLITS))))
    met = dealt(families.drop("tuples"), ["family"], "no", BLOCK, F.ceil(parts)).join(texts.join(families.select("no", "tuples"), "no"), "no")
    return map_groups(met, ["family"], family_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, raw, component, class_id, kept), one row for each row of the input.

    ``class_id`` is the smallest doc_id of the class: documents linked, directly or through others, by verified
    near-duplicate pairs. ``kept`` marks the documents with that id. Words compare in lower case; texts of equal
    words are one text (by a 128-bit digest) and are compared once, however many copies there are. Texts under five
    words are one k-mer. A null doc_id, or a text without words (null, empty, blank), is in no class with others:
    component is null, class_id is its own doc_id, and it is kept. Ties and repeated rows take the same decision.
    ``raw`` is a digest of the text as it stands, ``component`` a number that classes of one class_id don't share.

    Buckets are never expanded into pairs. First every text is held against its bucket's smallest; the links found
    form components. Texts of one bucket that are still in different components are then compared by lengths and word
    counts within the tasks that hold the bucket's blocks. Those that may be similar, directly or through others, are
    families. Pairs of a family that share a bucket are aligned within the tasks that hold two parts of its texts, and
    only links that join components come out, so no table of pairs arises, however large a group of near copies is.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    described = map_texts(rows.withColumn("raw", digest(F.coalesce("text", F.lit("")))), "text", describe, "words binary, n_words long, tuples array<long>, counts binary")
    described = cut(described.drop("text"))
    known = described.where("words IS NOT NULL AND doc_id IS NOT NULL")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  (equal for equal words)
    distinct = known.groupBy("words").agg(F.min("doc_id").alias("least"), F.min("raw").alias("raw"), first("n_words"), first("tuples"), first("counts"))
    distinct = numbered(distinct, "no")
    each = distinct.select("no", "n_words", F.explode("tuples").alias("bucket"))
    least = rekeyed(each.groupBy("bucket").agg(F.min("no").alias("least"), F.max("no").alias("most")).where("least < most").select("bucket", "least"), "bucket")
    met = cut(each.join(least, "bucket"))  # most buckets hold one text; the rest of the work is on the others
    pairs = met.where("no > least").select(F.col("least").alias("a"), F.col("no").alias("b")).distinct()
    tried = cut(possible(pairs, distinct))
    components = cut(connected_components(verified(tried, _texts(rows, distinct, tried))).toDF("no", "component"))
    # a bucket's smallest text is done with there
    placed = met.where("no > least").select("bucket", "no", "n_words").join(rekeyed(components, "no"), "no", "left").withColumn("component", F.coalesce("component", "no"))
    split = rekeyed(placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket"), "bucket")
    left = cut(placed.join(split, "bucket").select("bucket", "no", "component", "n_words"))
    families = cut(connected_components(further_pairs(left, distinct, forest=True)).toDF("no", "family"))
    if not families.isEmpty():
        own = distinct.select("no", "n_words", "tuples").join(small(families), "no").join(components, "no", "left")
        own = cut(own.withColumn("component", F.coalesce("component", "no")))
        found = links_within(own, _texts(rows, distinct, families.select(F.col("no").alias("a"), F.col("no").alias("b"))))
        # a component's members and its smallest text are links enough
        components = connected_components(components.unionAll(found)).toDF("no", "component")
    # the smallest id goes from rows to texts to components, and back the same way
    members = distinct.select("no", "words", "least").join(components, "no", "left").withColumn("component", F.coalesce("component", "no"))
    least = rekeyed(members.groupBy("component").agg(F.min("least").alias("class_id")), "component")
    classes = rekeyed(members.join(least, "component").select("words", "component", "class_id"), "words")
    out = described.select("doc_id", "raw", F.when(F.col("doc_id").isNotNull(), F.col("words")).alias("words")).join(classes, "words", "left")
    own = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", "raw", "component", own.alias("class_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _texts(rows: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """(no, text) of the texts in the pairs, each once."""
    needed = pairs.select("a").unionAll(pairs.select("b")).distinct().withColumnRenamed("a", "no")
    chosen = small(cut(distinct.select("no", "raw").join(needed, "no")))
    keyed = rows.where("text IS NOT NULL AND doc_id IS NOT NULL").select(digest(F.col("text")).alias("raw"), "text")
    return cut(keyed.join(chosen, "raw").select("no", "text").dropDuplicates(["no"]))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows and columns, one document of each class.

    Where several rows bear a class's smallest id, one with the least text digest and row key stays. Rows in no class
    (without words or id) all stay.
    """
    own, raw, key, whole = (fresh(docs, c) for c in ("_id", "_raw", "_key", "_whole"))
    firsts = near_duplicates(docs, doc_id, text).where("kept AND component IS NOT NULL").groupBy(F.col("doc_id").alias(own), "component").agg(F.min("raw").alias(raw)).drop("component")
    names = [F.col(f"`{c}`") for c in docs.columns]
    worded = F.coalesce(docs[doc_id].isNotNull() & docs[text].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).select(docs[doc_id].alias(own), digest(docs[text]).alias(raw), row_key(docs).alias(key), F.struct(*names).alias(whole))
    chosen = keyed.join(firsts, [own, raw], "left_semi").groupBy(own, raw).agg(F.min_by(whole, key).alias(whole))
    return chosen.select(f"{whole}.*").unionAll(docs.where(~worded).select(*names))
