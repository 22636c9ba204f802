import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpuslake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    whole = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    asked = {}
    for i, label, v in whole:
        if i % every == 0:
            asked[i] = min(asked.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in asked.items():
        scores = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in whole]
        same = sorted((s, i) for s, i, other in scores if other == label and i != a)
        for ps, p in same[:5]:
            fit = sorted((s, i) for s, i, other in scores if other != label and 30 * -ps <= 100 * -s <= 90 * -ps)
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n) in enumerate(fit[:10])]
    return sorted(out)


def answer(spark, rows, every=100, partitions=3, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(partitions)
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % every == 0).collect()))


def case(seed, n, dims=12, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, 0.6) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


def test_strassen_equals_the_plain_product():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (40, 64, 90), (33, 65, 129), (17, 100, 17), (100, 33, 64), (5, 0, 3)):
        a, b = rng.integers(-1 << 20, 1 << 20, (m, k)), rng.integers(-1 << 20, 1 << 20, (k, n))
        assert (hn.strassen(a, b) == a @ b).all()


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "TILE", 37)  # only the driver packs by it here; sizes never change results
    monkeypatch.setattr(hn, "ANCHORS", 9)
    rows = case(1, 400)
    got = answer(spark, rows, every=10)
    assert got == brute(rows, every=10) and len(got) > 500


def test_odd_rows(spark):
    rows = case(2, 60, dims=4)
    nan, inf = float("nan"), float("inf")
    rows += [(100, [nan, 1.0], 1), (200, [1.0, inf], 1), (300, None, 1), (400, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0] * 4, 1),
             (500, [], 1), (600, [1.0, None], 1), (700, [1.0], 2), (800, [0.5, 0.5, 0.5, 0.5, 2.0], 1), (900, [-1.0] * 4, 0)]
    assert answer(spark, rows) == brute(rows)


def test_ties_and_repeated_rows(spark):
    rows = [(i, [1.0, 0.5], 1) for i in range(95, 130)] + [(i, [0.6, 0.2], 2) for i in range(130, 160)]
    rows += [(100, [1.0, 0.5], 1)] * 3 + [(101, [1.0, 0.5], 1)] + [(140, [0.6, 0.2], 2)]
    assert answer(spark, rows) == brute(rows)


def test_empty_tables_and_clashing_columns(spark):
    assert answer(spark, []) == []
    rows = case(4, 250)
    wide = [(*r, 1, b"x", 7) for r in rows]
    assert answer(spark, wide, schema=SCHEMA + ", block int, part binary, score long") == brute(rows)
