"""Comparing the members of groups of any size, in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rekeyed


def dealt(rows: DataFrame, keys: list[str], member: str, block: int, blocks: Column | None = None) -> DataFrame:
    """Rows of each group cut into blocks of about ``block``, each repeated for every pair of blocks it is in.

    Adds own, i and j: the pair is (i, j) with i <= j and ``own`` is the row's block. Groups of one row are left
    out. The group sizes are pre-aggregated; a group's rows are joined to its size in partitions that can be split.
    ``blocks``, an aggregate of a group's rows, sets the number of blocks where it should follow another size.
    Deal narrow rows, and join what is wide afterwards.
    """
    blocks = F.ceil(F.count("*") / block) if blocks is None else blocks
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), blocks.cast("int").alias("_blocks")).where("_n > 1").select(*keys, "_blocks")
    out = rows.join(rekeyed(sizes, keys[0]), keys).withColumn("own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return out.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_other", "_blocks")


def map_groups(rows: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """``work(columns of one group as arrays) -> columns as arrays`` for the groups of (keys, i, j).

    Groups follow one another in a task, so many small ones cost little; one group at a time is held whole.
    """
    keys = [*keys, "i", "j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        made: list[dict] = []
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[c] for m in made])) for c in made[0]], names=list(made[0]))

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if held is not None:
                columns = {c: np.concatenate([held[c], v]) for c, v in columns.items()}
            new = np.zeros(len(columns[keys[0]]), bool)
            for key in keys:
                new[1:] |= columns[key][1:] != columns[key][:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
                made.append(work({c: v[low:high] for c, v in columns.items()}))
                size += len(next(iter(made[-1].values())))
                if size > 10_000 or len(made) > 10_000:
                    yield out()
                    made, size = [], 0
            held = {c: v[starts[-1] :] for c, v in columns.items()}
        if held is not None:
            made.append(work(held))
        if made:
            yield out()

    return rows.mapInArrow(run, schema)
