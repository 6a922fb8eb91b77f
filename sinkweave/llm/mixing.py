"""Mixing sources to target weights by Efraimidis-Spirakis sampling [native].

Every document gets an exponential key divided by its quality weight; in key order within its source it is taken
until the source's token budget is met. Whole epochs over a source come before the fractional selection.
DataFrame functions only.

No source is sorted in one task: the range of keys in which the budget ends is cut into ``BINS`` slices, the slices'
sizes are summed, and the one in which it ends is cut again, until it holds no more than ``MOST_SORTED`` documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, n_words, numbered

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BINS = 2048
#: Documents of one source that are put in order by one task.
MOST_SORTED = 2_000
#: Sources, or slices of them, that the driver looks at together.
MOST_SOURCES = 10_000
#: The plan has one row a source; beyond this many it is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000
SYMBOLS = "#*$%&|<>"
#: Cells of the quality model: so many shares of symbols, and so many lengths.
SHARES, LENGTHS = 6, 6


def cell(text: Column, words: Column) -> Column:
    """What the quality model knows of a text: its symbols a word, in quarters, and its length, in powers of ten."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    share = F.least(F.lit(SHARES - 1), F.ceil(F.coalesce(symbols, F.lit(0)) * 4 / F.greatest(words, F.lit(1))))
    length = F.least(F.lit(LENGTHS - 1), F.length(words.cast("string")) - F.when(words == 0, F.lit(1)).otherwise(F.lit(0)))
    return (share * LENGTHS + length).cast("int")


def quality(known: DataFrame, labels: DataFrame, label_id: str = "doc_id", label: str = "quality") -> dict[int, float]:
    """Chance that a document of a cell is labelled good, over all labelled documents; one good and one bad are added.

    ``known`` has doc_id and cell. The model has no more entries than there are cells.
    """
    good = labels.select(labels[label_id].alias("doc_id"), labels[label].cast("long").alias("good")).where("good IN (0, 1)")
    counts = known.select("doc_id", "cell").join(good, "doc_id").groupBy("cell").agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    return {r["cell"]: (r["good"] + 1) / (r["n"] + 2) for r in counts.collect()}


def weight_of(at: Column, model: dict[int, float]) -> Column:
    """A cell's weight; a half where no labelled document was in it."""
    out = F.lit(0.5)
    for key, value in sorted(model.items()):
        out = F.when(at == key, F.lit(value)).otherwise(out)
    return out


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """Reproducible number in (0, 1): 52 bits of an md5 digest of the seed, the id and the text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds rank, from 0, of the sources in code point order, null last: by ranges, then by ranges' counts."""
    order = F.col("source").asc_nulls_last()
    parts = cut(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumns({"part": F.spark_partition_id(), "no": F.monotonically_increasing_id()}))
    counts = {r["part"]: (r["n"], r["first"]) for r in parts.groupBy("part").agg(F.count("*").alias("n"), F.min("no").alias("first")).collect()}
    before, offset = 0, F.lit(0)
    for part, (n, first) in sorted(counts.items()):
        offset = F.when(F.col("part") == part, F.lit(before - first)).otherwise(offset)
        before += n
    return parts.withColumn("rank", F.col("no") + offset).drop("part", "no")


def water_level(sources: DataFrame) -> float | None:
    """The level at which min(cap, weight * level), summed over the sources, is the sum of their sizes.

    Sources in order of cap / weight are drowned one after the other; the level is that of the first which is not.
    The range in which it lies is cut into slices until it holds few enough different values to look at.
    """
    total, weights, high = sources.agg(F.sum("source_size"), F.sum("weight"), F.max("ratio")).first()
    low, below_cap, below_weight = 0.0, 0, 0
    if not total:
        return None
    while True:
        here = sources.where(F.col("ratio").between(low, high)).groupBy("ratio").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"))
        rows = here.limit(MOST_SOURCES + 1).collect()
        if len(rows) <= MOST_SOURCES:
            break
        bins = here.groupBy(F.least(F.lit(BINS - 1), F.floor((F.col("ratio") - low) / (high - low) * BINS)).alias("bin"))
        found = bins.agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.min("ratio").alias("low"), F.max("ratio").alias("high")).collect()
        for r in sorted(found, key=lambda r: r["low"]):
            # the last slice whose first source is drowned or at the level
            if (total - below_cap) / (weights - below_weight) <= r["low"]:
                return (total - below_cap) / (weights - below_weight)
            rest = weights - below_weight - r["weight"]
            if rest <= 0 or (total - below_cap - r["cap"]) / rest <= r["high"]:
                low, high = r["low"], r["high"]
                break
            below_cap, below_weight = below_cap + r["cap"], below_weight + r["weight"]
        else:
            return None
    for r in sorted(rows, key=lambda r: r["ratio"]):
        level = (total - below_cap) / (weights - below_weight)
        if level <= r["ratio"]:
            return level
        below_cap, below_weight = below_cap + r["cap"], below_weight + r["weight"]
        if below_weight >= weights:
            return None
    return (total - below_cap) / (weights - below_weight)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets of (source, source_size), one row a source; further columns pass through.

    Sources in code point order, null last, weigh 5, 2, 1, repeating, and share the sum of all sizes; no target
    exceeds ``most`` times its source's size, the excess goes to the others by weight. That is one water level:
    target = min(most * size, weight * level).
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    t = cut(ranked(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight")))
    level = water_level(t)
    full = F.col("cap").cast("double")
    target = full if level is None else F.when(F.col("ratio") < level, full).otherwise(F.col("weight") * F.lit(level))
    return t.withColumn("target", target).drop("rank", "weight", "cap", "ratio")


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's row of the plan; null is a source."""
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    plan = plan.withColumnRenamed("source", "_source")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def budget_ends(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, end_key, end_no): the last document in order of (key, no) that is still taken.

    Rows are (source, size, key, no), budgets (source, budget, n, key_low, key_high, no_low, no_high) of all rows.
    A document is taken if that brings the source nearer to its budget.
    """
    inside = F.col("key").between(F.col("key_low"), F.col("key_high")) & F.col("no").between(F.col("no_low"), F.col("no_high"))
    state = cut(budgets.withColumn("before", F.lit(0).cast("long")))
    while (state.agg(F.max("n")).first()[0] or 0) > MOST_SORTED:
        share = F.when(F.col("key_high") > F.col("key_low"), (F.col("key") - F.col("key_low")) / (F.col("key_high") - F.col("key_low")))
        share = share.otherwise((F.col("no") - F.col("no_low")) / F.greatest(F.lit(1), F.col("no_high") - F.col("no_low")))
        placed = _joined(rows, state).where(inside).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int"))
        ends = [f(c).alias(f"{c}_{n}") for c in ("key", "no") for n, f in (("low", F.min), ("high", F.max))]
        bins = placed.groupBy("source", "bin").agg(F.first("budget").alias("budget"), F.first("before").alias("start"), F.sum("size").alias("bin_size"), F.count("*").alias("n"), *ends)
        before = F.col("start") + F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size")
        kept = ("bin", "budget", "n", "key_low", "key_high", "no_low", "no_high", "before")
        last = bins.withColumn("before", before).where("before < budget").groupBy("source").agg(F.max(F.struct(*kept)).alias("end"))
        state = cut(last.select("source", *[f"end.{c}" for c in kept[1:]]))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("key", "no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ending = _joined(rows, state).where(inside).withColumn("taken", F.col("before") + running - F.col("size") + F.col("size") / 2 <= F.col("budget"))
    nothing = F.struct(F.col("key_low").alias("key"), (F.col("no_low") - 1).alias("no"))
    ends = ending.groupBy("source").agg(F.max(F.when(F.col("taken"), F.struct("key", "no"))).alias("end"), F.min(nothing).alias("none"))
    return ends.select("source", F.coalesce("end", "none").alias("end")).select("source", F.col("end.key").alias("end_key"), F.col("end.no").alias("end_no"))


def _mix(docs: DataFrame, kept: list[str], doc_id: str, text: str, source: str, weight: Column | None, labels: DataFrame | None, weights, most: int, seed: int) -> DataFrame:
    """The mix over a table of struct ``given`` (the columns that are kept), doc_id, source, size and the plan's columns."""
    words = n_words(docs[text])
    given = F.struct(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(kept)], F.lit(0).alias("c"))
    base = docs.select(given.alias("given"), docs[doc_id].alias("doc_id"), docs[source].alias("source"), words.alias("size"), cell(docs[text], words).alias("cell"), uniform(seed, docs[doc_id], docs[text]).alias("u"), (weight if weight is not None else F.lit(None)).cast("double").alias("own"))
    base = numbered(base, "no")
    value = F.col("own") if weight is not None else weight_of(F.col("cell"), quality(base, labels)) if labels is not None else F.lit(1.0)
    base = base.withColumn("key", -F.log("u") / value)
    ends = [f(c).alias(f"{c}_{n}") for c in ("key", "no") for n, f in (("low", F.min), ("high", F.max))]
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), *ends), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(1)).cast("long")
    targets = cut(targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    last = budget_ends(base.select("source", "size", "key", "no"), targets.where("budget > 0").drop("source_size", "target", "epochs"))
    plan = targets.select("source", "source_size", "target", "epochs").alias("t").join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select("t.*", "end_key", "end_no")
    joined = _joined(base, cut(plan))
    extra = F.coalesce((F.col("key") < F.col("end_key")) | ((F.col("key") == F.col("end_key")) & (F.col("no") <= F.col("end_no"))), F.lit(False))
    return joined.withColumn("copies", F.col("epochs") + extra.cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, labels: DataFrame | None = None, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """One row for each document: (doc_id, source, size, source_size, target, taken, copies).

    ``copies`` is how often the mix takes the document whole and ``taken`` = copies * size. The document in which the
    budget ends is taken if that brings the source nearer to its target, so a source misses it by half a document at
    most. The quality weight is ``weight``, or fitted from ``labels`` (doc_id, quality 0 or 1), or else the same for
    all. Rows that repeat with their id and text tie, and go by the order in which they stand; each is taken or not by
    itself. Documents without words take no part (taken 0) but keep their whole epochs as copies. Null sources are a
    source of their own; an empty table gives no rows.
    """
    mixed = _mix(docs, [], doc_id, text, source, weight, labels, weights, most, seed)
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, labels: DataFrame | None = None, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """The mix itself: the input's rows and columns, each document as often as ``mix`` takes it."""
    mixed = _mix(docs, docs.columns, doc_id, text, source, weight, labels, weights, most, seed).where("copies > 0")
    again = fresh(docs, "_again")
    names = [F.col(f"given.c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return mixed.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(again)).drop(again)
