import random

from pyspark.sql import functions as F

from corpuslake.operators import ranking


def skewed(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(400) / 4) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, ord long, x double")


def test_position_and_running_sum_of_a_hot_key(spark):
    rows, df = skewed(spark)
    got = {(r.key, r.ord): (r.pos, r.total) for r in ranking.running_sum(
        ranking.position(df, ["key"], "ord", "pos", span=64), ["key"], "ord", F.col("x"), "total", span=64).collect()}
    seen = {}
    for key, order, x in rows:
        place, total = seen.get(key, (0, 0.0))
        assert got[(key, order)] == (place, total + x)
        seen[key] = (place + 1, total + x)


def test_percentiles_with_a_fine_and_a_coarse_sketch(spark):
    import math

    rows, df = skewed(spark)
    for accuracy in (20, 10_000):
        got = {(r.key, r.p): r.x for r in ranking.nearest_rank_percentiles(
            df, ["key"], "x", [0.5, 0.95], accuracy=accuracy).collect()}
        for key in {r[0] for r in rows}:
            values = sorted(r[2] for r in rows if r[0] == key)
            for p in (0.5, 0.95):
                assert got[(key, p)] == values[max(0, math.ceil(p * len(values)) - 1)]
