import math
import random
import re
from collections import Counter

import pytest

from corpuslake.config import DEFAULTS
from corpuslake.operators import bm25
from corpuslake.session import shared_dir

CHUNKS = "chunk_id string, document_id string, chunk_index int, content string"


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(queries, chunks, k):
    counts = {c[0]: Counter(tokens(c[3])) for c in chunks}
    length = {c[0]: sum(counts[c[0]].values()) for c in chunks}
    n, average = len(chunks), sum(length.values()) / len(chunks)
    df = Counter(t for c in counts.values() for t in c)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = round(sum(raw.values()) / len(raw), 9)
    idf = {t: x if x >= 0 else 0.25 * mean for t, x in raw.items()}
    out = []
    for q, text in queries:
        rows = []
        for c in chunks:
            s = sum(m * idf[t] * counts[c[0]][t] * 2.5 / (counts[c[0]][t] + 1.5 * (0.25 + 0.75 * length[c[0]] / average))
                    for t, m in Counter(tokens(text)).items() if counts[c[0]][t])
            if round(s, 6) > 0:
                rows.append((-round(s, 6), c[1], c[2], c[0]))
        out += [(q, r[3], rank) for rank, r in enumerate(sorted(rows)[:k])]
    return sorted(out)


def case(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    chunks = [(f"c{i}", f"d{rng.randrange(40):02}", i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(n)]
    chunks += [(f"x{i}", "e", 1000 + i, "w0 w1 w2 w9") for i in range(20)]
    queries = [(f"q{i}", " ".join(rng.choices(words, weights, k=rng.choice([1, 2, 12, 40])))) for i in range(25)]
    return queries + [("none", "unknown words"), ("empty", ""), ("null", None), ("twice", "w9 w9 w0")], chunks


@pytest.mark.parametrize("block", [4, 64])
def test_same_rows_as_scoring_everything(spark, monkeypatch, block):
    monkeypatch.setattr(bm25, "BLOCK", block)
    queries, chunks = case(1, 500)
    got = bm25.search(spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(chunks, CHUNKS))
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect()) == brute(queries, chunks, DEFAULTS.bm25_k)


def test_small_corpora_with_negative_idf(spark):
    chunks = [("a", "d", 0, "x y"), ("b", "d", 1, "x"), ("c", "d", 2, "x z z"), ("n", "d", 3, None)]
    queries = [("1", "x"), ("2", "x y z"), ("3", "z")]
    got = bm25.search(spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(chunks, CHUNKS))
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect()) == brute(queries, chunks, 8)


def test_index_is_found_again_by_its_signature_only(spark):
    _, chunks = case(2, 30)
    df, path = spark.createDataFrame(chunks, CHUNKS), shared_dir(spark, "keywords")
    assert bm25.open_index(spark, path, "one") is None
    built = bm25.stored_index(df, path, "one")
    assert built.postings().count() == bm25.postings(df).count()
    calls = []
    bm25.stored_index(df, path, "one", tokenizer=lambda c: calls.append(1))
    assert not calls and bm25.open_index(spark, path, "two") is None
    assert bm25.stored_index(df.limit(5), path, "two").stats.first()["n_chunks"] == 5


def test_pruning_opens_few_postings(spark):
    queries, chunks = case(3, 3000)
    index = bm25.write_index(spark.createDataFrame(chunks, CHUNKS), shared_dir(spark, "keywords"))
    seen = []
    original = bm25.scored
    bm25.scored = lambda pairs, weighted, index: (seen.append(pairs), original(pairs, weighted, index))[1]
    try:
        bm25.search(spark.createDataFrame([q for q in queries if q[0].startswith("q")], "query_id string, query string"),
                    spark.createDataFrame(chunks, CHUNKS), index=index).count()
    finally:
        bm25.scored = original
    assert seen[-1].count() < 0.5 * 25 * len(chunks)


@pytest.mark.parametrize("cells", [7, 1 << 18])
def test_shared_tokens_are_counted_without_a_shuffle_of_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(bm25, "CELLS", cells)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "dd", "ee", "ff"]) for _ in range(n))
    chunks = [(f"c{i}", "d", i, text(rng.randrange(6))) for i in range(30)]
    queries = [(None, "a b"), *[(i, text(4)) for i in range(5)], (9, ""), (10, "zz")]
    asked = spark.createDataFrame(queries, "query_id long, query string")

    def both(rows):
        index = bm25.write_index(spark.createDataFrame(rows, CHUNKS), shared_dir(spark, "keywords"))
        want = index.postings().join(bm25.query_tokens(asked), "token").groupBy("query_id", "chunk_id").count()
        got = bm25.shared_tokens(asked, index)
        assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in want.collect())
        return got

    plan = both(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    both(chunks + [("c1", "d", 1, "a zz"), (None, "d", 40, "a"), (None, "d", 41, "a b")])
    monkeypatch.setattr(bm25, "ASKED", 3)
    both(chunks)


def test_blocks_are_made_where_chunks_lie(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD", 300)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    queries, chunks = case(5, 400)
    df = spark.createDataFrame(chunks, CHUNKS)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "20")
    try:
        index = bm25.write_index(df, shared_dir(spark, "keywords"))
    finally:
        spark.conf.set(rows, before)
    assert "Exchange" not in bm25.block_rows(index.forward, 3.0, DEFAULTS)._jdf.queryExecution().executedPlan().toString()
    assert index.blocks.select("shard").distinct().count() > spark.sparkContext.defaultParallelism
    wanted = Counter((t, c[0]) for c in chunks for t in set(tokens(c[3])))
    assert Counter((r.token, r.chunk_id) for r in index.postings().collect()) == wanted
    assert {r.token: r.df for r in index.tokens.collect()} == Counter(t for t, _ in wanted)
    assert all(r.n == len(r.members) <= 4 and r.top == max(m.impact for m in r.members) for r in index.blocks.collect())
    got = bm25.search(spark.createDataFrame(queries, "query_id string, query string"), df, index=index)
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect()) == brute(queries, chunks, DEFAULTS.bm25_k)


def test_texts_are_read_once_for_the_sources_of_questions(spark, tmp_path):
    from corpuslake.plans.inputs import Corpus

    docs = [(1, "some words of a question here", "en", "src1"), (2, None, "en", "src1"), (3, "others", "de", "src2"), (3, "others", "de", "src2")]
    for name, rows, schema in (
            ("documents", docs, "doc_id long, text string, lang string, source string"),
            ("labels", [(1, 1, 0)], "doc_id long, quality int, toxic int"),
            ("benchmark", [(7, "words of a question"), (8, "found in nothing at all"), (9, None)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    k = Corpus(spark, str(tmp_path))
    assert [tuple(r) for r in k.relevant().collect()] == [(7, "data/docs/src1/1.txt")] == [tuple(r) for r in k.holders().collect()]
    assert k.relevant() is k.relevant() and k.fingerprint() == Corpus(spark, k.dir).fingerprint()
    assert {r.query_id: r.unanswerable for r in k.questions().collect()} == {7: False, 8: True, 9: True}
    assert "documents.parquet" not in k.questions()._jdf.queryExecution().executedPlan().toString()
