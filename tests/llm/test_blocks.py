import itertools

from pyspark.sql import functions as F

from sinkweave.llm.blocks import dealt, map_groups
from sinkweave.llm.common import rekeyed, small


def test_every_pair_of_a_group_meets_in_one_task(spark):
    rows = [(1, k) for k in range(50)] + [(2, 100), (3, 200), (3, 201)]
    frame = spark.createDataFrame(rows, "g long, m long")

    def pairs(group):
        import numpy as np

        own, m = group["own"].tolist(), group["m"].tolist()
        cross = group["i"][0] != group["j"][0]
        out = [(x, y) for a, x in enumerate(m) for b, y in enumerate(m) if x < y and (not cross or own[a] != own[b])]
        both = np.array(out, np.int64).reshape(-1, 2)
        return {"a": both[:, 0], "b": both[:, 1]}

    for block in (1000, 7):
        got = sorted((r["a"], r["b"]) for r in map_groups(dealt(frame, ["g"], "m", block), ["g"], pairs, "a long, b long").collect())
        assert got == [*itertools.combinations(range(50), 2), (200, 201)]


def test_rekeyed_keeps_values(spark):
    for kind in ("long", "string"):
        frame = spark.range(-3, 4).select(F.col("id").cast(kind).alias("k"))
        assert sorted(map(str, (r["k"] for r in rekeyed(frame, "k").collect()))) == sorted(str(k) for k in range(-3, 4))
    plan = rekeyed(spark.range(9).groupBy("id").count(), "id").join(spark.range(9), "id").hint("merge")
    assert plan.count() == 9 and small(spark.range(3), 2).count() == 3
