import math

import numpy as np
from pyspark.sql import functions as F

from corpuslake.operators import context, evaluate, fusion, graph_query, vector
from corpuslake.config import NO_CONTEXT_TEXT

LIST = ("query_id long, list_pos int, channel string, weight double, rank int, chunk_id string, "
        "graph_facts array<string>, graph_score double")


def test_rrf_merges_lists_and_metadata(spark):
    rows = [(1, 0, "vector", 0.5, 0, "a", [], None), (1, 0, "vector", 0.5, 1, "b", [], None),
            (1, 1, "graph", 0.25, 0, "b", ["f1", "f2"], 0.9), (1, 1, "graph", 0.25, 1, "c", ["f1"], 0.1)]
    got = fusion.rrf(spark.createDataFrame(rows, LIST)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"]
    assert got[0].retrieval_channels == ["vector", "graph"]
    assert got[0].graph_facts == ["f1", "f2"] and got[0].graph_score == 0.9
    assert abs(got[0].fusion_score - (0.5 / 62 + 0.25 / 61)) < 1e-9
    assert fusion.rrf(spark.createDataFrame([], LIST)).count() == 0


def test_exact_search_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    base, asked = rng.normal(size=(200, 8)).round(1), rng.normal(size=(9, 8)).round(1)
    table = lambda m, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{key} long, embedding array<double>")
    scores = np.round(asked @ base.T, 6)
    want = {q: sorted(range(200), key=lambda i: (-scores[q, i], i))[:8] for q in range(9)}
    for block, group in ((64 << 20, 10**6), (4 * 8 * 8, 30)):
        hits = vector.search(table(asked, "query_id"), table(base, "chunk_id"), 8, block_bytes=block, group_rows=group)
        got = {}
        for r in hits.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want


def test_lsh_recall(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    best = vector.search_lsh(queries, vectors, 1).collect()
    assert sum(r.query_id == r.chunk_id for r in best) == 20


def test_cells_find_nine_of_ten_neighbours_in_a_tenth_of_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    base = centres[rng.integers(60, size=6000)] + rng.normal(size=(6000, 16)) * 0.35
    base[:2000] = base[0]  # a hot cell
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    index = vector.inverted_file(vectors, part_rows=300)
    assert index.parts.agg({"parts": "max"}).first()[0] > 3
    compared = []
    best_of = vector._score_groups
    monkeypatch.setattr(vector, "_score_groups", lambda left, right, keys, *a: (compared.append(
        left.groupBy(*keys).count().withColumnRenamed("count", "a").join(right.groupBy(*keys).count(), keys)
        .selectExpr("sum(a * count)").first()[0]), best_of(left, right, keys, *a))[1])
    found = {(r.query_id, r.chunk_id) for r in vector.search_cells(queries, index, query_rows=10).collect()}
    scores = np.round(base[::50] @ base.T, 6)
    want = {(50 * q, i) for q in range(120) for i in sorted(range(6000), key=lambda i: (-scores[q, i], i))[:8]}
    assert len(found & want) >= 0.9 * len(want) and len(found) == len(want)
    assert compared[0] < 0.1 * 120 * 6000 + 40 * 2000  # the copies ask each other


def test_name_pairs_equal_brute_force(spark):
    queries = [(1, "who uses alpha beta"), (2, "alp"), (3, "zeta"), (4, "")]
    names = ["alpha", "alpha beta", "alp", "beta", "gamma", "zeta function", "a"]
    got = {(r.query_id, r.name_norm) for r in graph_query.name_pairs(
        spark.createDataFrame(queries, "query_id long, query_norm string"),
        spark.createDataFrame([(n,) for n in names], "name_norm string")).collect()}
    assert got == {(q, n) for q, text in queries for n in names if text and (n in text or text in n)}


CANDIDATE = "query_id long, rank int, chunk_id string, content_hash string, content string, source string, document_id string"


def test_context_rules(spark):
    rows = [(1, 0, "c1", "h1", "one", "data/docs/a.txt", "d"), (1, 1, "c2", "h1", "one", "data/docs/a.txt", "d"),
            (1, 2, "c3", "h3", "three", "docs/a.txt", "d"), (1, 3, "c4", "h4", "four", "a.txt", "d"),
            (1, 4, "c5", "h5", "five", "b.txt", "d")]
    queries = spark.createDataFrame([(1, "q"), (2, "nothing")], "query_id long, query string")
    built = {r.query_id: r for r in context.build_context(spark.createDataFrame(rows, CANDIDATE), queries).collect()}
    assert [s.chunk_id for s in built[1].sources] == ["c1", "c3", "c5"]
    assert built[1].context.startswith("[来源1]\n文件：a.txt\n内容：one\n\n[来源2]")
    assert built[2].context == NO_CONTEXT_TEXT and built[2].sources == []


def test_budget_stops(spark):
    long = "x" * 5000
    rows = [(1, i, f"c{i}", f"h{i}", long + str(i), f"s{i}", "d") for i in range(3)]
    fitted = context.fit_budget(spark.createDataFrame(rows, CANDIDATE)).orderBy("rank").collect()
    assert [len(r.cited_text) for r in fitted] == [5001, 100]


def test_metrics(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    ranked = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "x")], "query_id long, rank int, source string")
    truth = spark.createDataFrame([(1, "docs/a")], "query_id long, source string")
    got = {r.query_id: r for r in evaluate.retrieval_metrics(queries, ranked, truth).collect()}
    assert got[1].recall_at_5 == 1.0 and got[1].mrr_at_10 == 0.5
    assert abs(got[1].ndcg_at_10 - 1 / math.log2(3)) < 1e-5 and got[1].source_hit == 1.0
    assert got[2].recall_at_5 == got[2].ndcg_at_10 == got[2].source_hit == 0.0
