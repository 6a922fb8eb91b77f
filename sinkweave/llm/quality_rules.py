"""Quality rules with suffix-array repetition.

A text's words are sorted by their suffixes; intervals of the longest-common-prefix array are its maximal repeated
substrings. The union of their spans must not cover too much of the text, and the longest must not be too long.
"""

from __future__ import annotations

from itertools import count as counter

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 0.30
#: The method's limits: repeats of at least MIN_REPEAT words may cover MAX_COVERED of the words, and none may be
#: longer than MAX_REPEAT words. Chosen on labelled documents, see the README.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 3, 0.30, 100

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"
SPACES, SYMBOLS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"), (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


def union_length(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint (start, end) of the union of spans sorted by start."""
    ends = np.maximum.accumulate(starts + lengths)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def covered(starts: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words covered by the spans in each text; no span crosses a text's bounds."""
    total = np.zeros(len(bounds) - 1, np.int64)
    if len(starts):
        a, b = union_length(starts, lengths)
        # a union may join spans of neighbouring texts where they touch; it is cut at the bounds
        edges = np.zeros(bounds[-1] + 1, np.int64)
        edges[a] += 1
        edges[b] -= 1
        inside = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]))])
        total = inside[bounds[1:]] - inside[bounds[:-1]]
    return total


def repeated_windows(tokens: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows of ``width`` (a power of two) tokens that occur again; ``tokens`` differ between texts.

    Prefix doubling over the positions that still repeat: what is unique at one length is unique at the next.
    """
    rank = tokens
    n = len(tokens)
    at = np.arange(n)
    counts = np.bincount(rank, minlength=n + 1)
    at = at[counts[rank] > 1]
    full = np.where(counts[rank] > 1, rank, -1)
    length = 1
    while length < width and len(at):
        at = at[at + length < ends[at]]
        at = at[full[at + length] >= 0]
        key = full[at] * np.int64(n + 1) + full[at + length]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        full = np.full(n, -1, np.int64)
        at = at[again]
        full[at] = inverse[again]
        length *= 2
    return at[at + width <= ends[at]] if len(at) else at


def suffix_array(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the one before it (0 for the first).

    Prefix doubling over the suffixes whose ranks still tie: what is told apart at one length is never looked at again.
    A suffix ends at its text's end; ``tokens`` of different texts must differ.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    new = np.ones(n, bool)
    new[1:] = tokens[order[1:]] != tokens[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    common = np.zeros(n, np.int64)
    tied = ~new
    tied[:-1] |= ~new[1:]
    places, length = np.flatnonzero(tied), 1
    while len(places):
        own = order[places]
        further = np.full(len(own), -1, np.int64)  # a suffix that ends here comes first
        inside = own + length < ends[own]
        further[inside] = rank[own[inside] + length]
        group = rank[own]
        sort = np.lexsort((further, group))
        own, further, group = own[sort], further[sort], group[sort]
        order[places] = own
        head = np.ones(len(own), bool)
        head[1:] = group[1:] != group[:-1]
        split = head.copy()
        split[1:] |= further[1:] != further[:-1]
        rank[own] = np.maximum.accumulate(np.where(split, places, 0))
        tied = ~split
        tied[:-1] |= ~split[1:]
        places, length = places[tied], 2 * length
    at, after = order[1:], order[:-1]
    # Kasai: in text order, a suffix's common prefix is at most one shorter than that of the suffix before it
    before = np.full(n, -1, np.int64)
    before[at] = after
    common = np.zeros(n, np.int64)
    words, stops, previous, k = tokens.tolist(), ends.tolist(), before.tolist(), 0
    found = [0] * n
    for i in range(n):
        j = previous[i]
        if j < 0 or words[i] != words[j]:
            k = 0
            continue
        k = k or 1
        low, high = stops[i], stops[j]
        while i + k < low and j + k < high and words[i + k] == words[j + k]:
            k += 1
        found[i] = k
        k -= 1
    common[:] = np.array(found, np.int64)[order] if n else 0
    return order, common


def maximal_repeats(tokens: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the occurrences of maximal repeated substrings of ``least`` tokens or more.

    They are the intervals of the longest-common-prefix array; of the intervals that hold a suffix the deepest is its
    longest, and covers what the wider ones cover. That interval's depth is the larger of the common prefixes with the
    suffix before and the one after.
    """
    order, common = suffix_array(tokens, ends)
    deepest = common.copy()
    deepest[:-1] = np.maximum(deepest[:-1], common[1:])
    far = deepest >= least
    starts, lengths = order[far], deepest[far]
    sort = np.argsort(starts)
    return starts[sort], lengths[sort]


def judge(texts: list, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> dict[str, list]:
    ids, out = None, {c.split()[0]: [] for c in FIELDS.split(", ")}
    tokens, bounds = [], [0]
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()  # bytes split at exactly the six ASCII spaces
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text or "") - sum(raw.count(c) for c in SPACES))
        out["n_symbols"].append(sum(raw.count(c) for c in SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        if ids is None:
            from collections import defaultdict

            ids = defaultdict(counter().__next__)
        tokens.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        bounds.append(bounds[-1] + len(words))
    bounds = np.array(bounds)
    sizes = np.diff(bounds)
    ends = np.repeat(bounds[1:], sizes)
    keys = np.concatenate(tokens) + np.repeat(np.arange(len(texts)), sizes) * np.int64(len(ids) + 1)
    keys = np.unique(keys, return_inverse=True)[1].astype(np.int64) if len(keys) else keys
    starts = repeated_windows(keys, ends, WINDOW)
    repeats = covered(starts, np.full(len(starts), WINDOW), bounds)
    begins, lengths = maximal_repeats(keys, ends, 2)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.searchsorted(bounds, begins, "right") - 1, lengths)
    far = lengths >= min_repeat
    spread = covered(begins[far], lengths[far], bounds)
    n = np.array(out["n_words"])
    failed = (n < MIN_WORDS) | (100 * repeats > round(100 * MOST_REPEATED) * n)
    kept = ~failed & (spread <= max_covered * n) & (longest <= max_repeat)
    return out | {"n_repeat_words": repeats, "covered_words": spread, "longest_repeat": longest, "base_failed": failed, "kept": kept}


def quality_rules(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds the counts of ``FIELDS`` and the verdict ``kept`` to every row, whole texts, no shuffle.

    Null and empty texts have no words and fail the base rule; ties and repeated rows are judged alike; an empty
    table stays empty; input columns that bear one of the new names are replaced. ``longest_repeat`` is the
    length of the longest repeated run of two words or more, else 0. ``min_repeat`` is at least 2.
    """
    return map_texts(docs, text, lambda texts: judge(texts, min_repeat, max_covered, max_repeat), FIELDS)
