"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), nearest first. Inverted lists, one for each label and
set of ``prefix`` pivots, hold the vectors that have these pivots among their ``posted`` nearest. Vectors that meet in
a list and share enough of their ``DESCRIBED`` nearest pivots are candidates; a candidate is a link if the cosine of the
whole vectors, in double precision, reaches the threshold.

Pivots come from a bounded sample. How many pivots a vector is posted under, how many make a list's key and how many
must be shared is worked out from the sample: from vectors turned by just the threshold's angle, and from the number
of vectors. Keys of more pivots keep the lists short however many vectors there are. Copies are indexed once.
"""

from __future__ import annotations

import math
from itertools import combinations
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt, map_groups
from .common import _marked, cut, digest, numbered, rekeyed
from .graph import connected_components

THRESHOLD = 0.98
#: Bound of the sample from which pivots are taken; it goes to the driver.
SAMPLE = 8192
#: Bound of the pivots, which go to every task: 2048 of 768 numbers are 12 MB.
MOST_PIVOTS = 2048
DESCRIBED = 8
#: Share of the pairs at the threshold that are to meet in a list, and to share enough pivots, in the sample.
RECALL = 0.998
#: Pivots are no nearer to one another than this cosine, so a crowd of near copies is one pivot.
APART = 0.9
#: Vectors of a list that one task compares with as many others.
BLOCK = 2048


class Index(NamedTuple):
    """Unit pivots of one dimension and how they are used."""

    pivots: np.ndarray
    posted: int
    prefix: int
    shared: int


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; squares of very large or small components stay finite."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The ``DESCRIBED`` nearest pivots of each unit vector, nearest first."""
    near = vectors @ pivots.T
    some = np.argpartition(-near, DESCRIBED - 1, axis=1)[:, :DESCRIBED]
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int32)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pivots in each row of ``a`` are in the same row of ``b``."""
    return (a[:, :, None] == b[:, None, :]).any(2)


def build(sample: np.ndarray, n: int, threshold: float = THRESHOLD) -> Index | None:
    """The index of ``n`` vectors like the sample's (of one dimension); None where there are too few pivots.

    Of the keys' lengths that find the pairs at the threshold, the one that costs least: a posting costs as much as
    comparing some hundred candidates.
    """
    rng = np.random.default_rng(5)
    vectors = unit(sample)
    chosen: list = []
    wanted = min(MOST_PIVOTS, max(32, math.ceil(4 * math.sqrt(n))))
    pool = np.empty((wanted, vectors.shape[1]))
    for x in vectors:
        if len(chosen) < wanted and not (len(chosen) and (pool[: len(chosen)] @ x).max() > APART):
            pool[len(chosen)] = x
            chosen.append(x)
    if len(chosen) <= DESCRIBED:
        return None
    pivots = pool[: len(chosen)].copy()
    some = vectors[rng.permutation(len(vectors))[:2048]]
    aside = rng.normal(size=some.shape)
    aside -= (aside * some).sum(1, keepdims=True) * some
    turned = threshold * some + math.sqrt(1 - threshold**2) * unit(aside)
    one, two = nearest(some, pivots), nearest(turned, pivots)
    shares = np.bincount(common(one, two).sum(1), minlength=DESCRIBED + 1)[::-1].cumsum()[::-1] / len(some)
    shared = max(k for k in range(DESCRIBED + 1) if k == 0 or shares[k] >= RECALL)
    best = None
    for prefix in range(1, 5):
        for posted in range(prefix, DESCRIBED + 1):
            a, b = one[:, :posted], two[:, :posted]
            if (common(a, b).sum(1) >= prefix).mean() >= RECALL or posted == DESCRIBED:
                break
        if (common(a, b).sum(1) >= prefix).mean() < RECALL and prefix > 1:
            continue  # even keys from all described pivots would miss too many
        met = [(common(a, np.roll(a, k, axis=0)).sum(1) >= prefix).mean() for k in range(1, min(33, len(a)))]
        candidates = n * float(np.mean(met or [1.0]))
        cost = math.comb(posted, prefix) + candidates / 300
        if best is None or cost < best[0]:
            best = cost, Index(pivots, posted, prefix, shared)
    return best[1]


def keys_of(near: np.ndarray, index: Index | None) -> np.ndarray:
    """The keys of the lists in which each vector is posted: sets of ``prefix`` pivots as numbers, 12 bits each."""
    if index is None:
        return np.zeros((len(near), 1), np.int64)
    sets = np.sort(near[:, : index.posted], axis=1).astype(np.int64)
    return np.stack([sum(sets[:, k] << (12 * i) for i, k in enumerate(some)) for some in combinations(range(index.posted), index.prefix)], 1)


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of ``a`` shares with each row of ``b``."""
    values, places = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    places = places.ravel()
    hot = np.zeros((len(a) + len(b), len(values)), np.float32)
    hot[np.repeat(np.arange(len(a) + len(b)), a.shape[1]), places] = 1
    return hot[: len(a)] @ hot[len(a) :].T


def compare(group: dict, threshold: float, index: Index | None) -> dict:
    """Links of one pair of blocks of a list: for each vector the copies it links with, and a spanning forest."""
    nodes, copies, own = (group[c] for c in ("node", "copies", "own"))
    key = group["pivots"][0]
    vectors = np.frombuffer(b"".join(group["vector"]), np.float64).reshape(len(nodes), -1)
    near = np.frombuffer(b"".join(group["near"]), np.int32).reshape(len(nodes), -1)
    left = own == own[0]
    right = ~left if (~left).any() else left
    links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    if (~left).any() or group["i"][0] == group["j"][0]:
        every, b = np.flatnonzero(left), np.flatnonzero(right)
        for low in range(0, len(every), 256):
            a = every[low : low + 256]
            good = vectors[a] @ vectors[b].T >= threshold
            if index is not None and good.any():
                good &= shared_counts(near[a], near[b]) >= index.shared
            x, y = np.nonzero(good)
            x, y = a[x], b[y]
            keep = x < y if right is left else x != y
            x, y = x[keep], y[keep]
            if index is not None and len(x):
                # a pair counts in one list only: that of the smallest pivots which both post
                posted = near[:, : index.posted].astype(np.int64)
                both = np.sort(np.where(common(posted[x], posted[y]), posted[x], 1 << 30), axis=1)[:, : index.prefix]
                here = sum(both[:, k] << (12 * k) for k in range(index.prefix)) == key
                x, y = x[here], y[here]
            links += np.bincount(x, copies[y], len(nodes)).astype(np.int64) + np.bincount(y, copies[x], len(nodes)).astype(np.int64)
            before = None
            while before is None or (root != before).any():
                before = root.copy()
                least = np.minimum(before[x], before[y])
                np.minimum.at(root, x, least)
                np.minimum.at(root, y, least)
                np.minimum.at(root, before[x], least)
                np.minimum.at(root, before[y], least)
                root = root[root]
    some = np.flatnonzero(links > 0)
    return {"node": nodes[some], "links": links[some], "other": nodes[root[some]]}


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of the input.

    Rows link if their labels are equal and not null and their cosine is at least ``threshold``. A vector that is
    null, empty, zero, or holds null or non-finite components links with nothing, nor do rows without a vec_id or
    vectors of different dimensions. ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest vec_id reachable, the row's own if it has no links; ``kept`` marks rows whose
    vec_id it is. Rows that repeat exactly are copies of one another and link. An empty table gives no rows.

    Of the pairs at the threshold a share of about ``RECALL`` meets, nearer ones more surely (see the tests and the
    README). ``exact`` compares all vectors of a label instead, in blocks. Lists of any size are compared whole.
    """
    x = F.col("vector")
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[label].alias("label"), vectors[vector].cast("array<double>").alias("vector"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    same = rows.select("label", "vector")
    rows = rows.withColumn("same", F.when(usable, digest(_marked(same, 0), F.to_json(F.struct("vector")))))
    thin = cut(rows.select("vec_id", "same"))
    nodes = rows.where("same IS NOT NULL").groupBy("same").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = numbered(nodes, "node")
    sizes = {r["size"]: r["n"] for r in nodes.groupBy("label", F.size("vector").alias("size")).count().groupBy("size").agg(F.max("count").alias("n")).orderBy(F.desc("n"), "size").limit(64).collect()}
    sample: dict[int, list] = {}
    if not exact:
        for r in nodes.orderBy("same").select("vector").limit(SAMPLE).collect():
            sample.setdefault(len(r[0]), []).append(r[0])
    made = {d: build(np.array(v, np.float64), sizes.get(d, len(v)), threshold) for d, v in sample.items()}
    indexes = nodes.sparkSession.sparkContext.broadcast({d: i for d, i in made.items() if i is not None})

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("vector")
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(lengths)])
            whole: list = [None] * len(lengths)
            near: list = [None] * len(lengths)
            keys: list = [None] * len(lengths)
            for d in np.unique(lengths):
                own, how = np.flatnonzero(lengths == d), indexes.value.get(int(d))
                m = unit(np.stack([flat[at[k] : at[k + 1]] for k in own]))
                described = nearest(m, how.pivots) if how else np.zeros((len(m), 1), np.int32)
                for k, v, p, key in zip(own, m, described, keys_of(described, how)):
                    whole[k], near[k], keys[k] = v.tobytes(), p.tobytes(), key
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), batch.column("copies"), pa.array(lengths, pa.int32()), pa.array(whole, pa.binary()), pa.array(near, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["node", "label", "copies", "size", "vector", "near", "keys"],
            )

    kind = nodes.schema["label"].dataType.simpleString()
    indexed = cut(nodes.select("node", "label", "copies", "vector").mapInArrow(index, f"node long, label {kind}, copies long, size int, vector binary, near binary, keys array<long>"))
    name = F.hex("label") if kind == "binary" else F.col("label").cast("string")
    lists = indexed.select(name.alias("label"), "size", "node", F.explode("keys").alias("pivots"))
    met = dealt(lists, ["label", "size", "pivots"], "node", BLOCK).join(indexed.select("node", "copies", "vector", "near"), "node")

    def work(group):
        return compare(group, threshold, indexes.value.get(int(group["size"][0])))

    found = cut(map_groups(met, ["label", "size", "pivots"], work, "node long, links long, other long"))
    components = connected_components(found.select("node", "other"))
    least = nodes.select("node", "least")
    smallest = rekeyed(components.join(least, "node").groupBy("component").agg(F.min("least").alias("component_id")), "component")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = nodes.select("node", "same", "copies", "least").join(linked, "node", "left").join(components.join(smallest, "component").select("node", "component_id"), "node", "left")
    by_node = rekeyed(by_node.select("same", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "same")
    out = thin.join(by_node, "same", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
