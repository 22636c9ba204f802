"""Queries on search channels, fusion, context and evaluation."""

import pandas as pd
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS
from corpuslake.functions import text as tx
from corpuslake.operators import bm25, context, evaluate, fusion, vector
from corpuslake.plans.registry import query
from corpuslake.plans.retrieval import (
    Index, answer_contexts, candidates, channel_lists, reranked, retrieve, retrieve_multi, rewritten, two_channel_weights,
)
from corpuslake.plans.views import fused, summary_rows
from corpuslake.session import cut_lineage, shared_dir
from corpuslake.sources import questions, tables


def text_index(k):
    return Index(k.active_chunks(), k.chunk_vectors(), keywords=k.keyword_index())


def full_index(k):
    return Index(k.active_chunks(), k.chunk_vectors(), k.document_graph(), k.keyword_index(), nfkc=False)


def shown(fused_rows):
    return fused_rows.select(
        "query_id", "chunk_id", F.round("fusion_score", 6).alias("fusion_score"),
        F.array_join("retrieval_channels", ",").alias("channels"),
        F.array_join("graph_facts", "; ").alias("graph_facts"), "rank",
    )


SHOWN = """
SELECT query_id, chunk_id, round(fusion_score, 6) AS fusion_score, channels,
       array_to_string(graph_facts, '; ') AS graph_facts, rank FROM """


@query("k1_inverted_index", "SELECT token, chunk_id, tf, length FROM kposts")
def k1(k):
    return k.keyword_index().postings().select("token", "chunk_id", "tf", "length")


@query("k2_bm25_topk", "SELECT query_id, chunk_id, score, rank FROM kbm25")
def k2(k):
    return bm25.search(k.queries(), k.active_chunks(), index=k.keyword_index()).select(
        "query_id", "chunk_id", "score", "rank"
    )


@query("g1_bm25_documents", """
SELECT query_id, document_id, chunk_index, rank FROM kbm25 WHERE rank < 3""")
def g1(k):
    from dataclasses import replace

    return bm25.search(k.queries(), k.active_chunks(), replace(DEFAULTS, bm25_k=3), index=k.keyword_index()).select(
        "query_id", "document_id", "chunk_index", "rank"
    )


CENTROIDS = """
WITH mean AS (SELECT label, d, round(avg(x), 9) AS x FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS d FROM embeddings)
  GROUP BY ALL),
cq AS (SELECT label, list(x ORDER BY d) AS m, sqrt(sum(x * x)) AS norm FROM mean GROUP BY label)
"""


@query("k3_vector_topk", CENTROIDS + """
SELECT * FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank
  FROM (SELECT q.label::BIGINT AS query_id, e.vec_id,
               round(list_dot_product(q.m, e.embedding::DOUBLE[]) / q.norm, 6) AS score
        FROM cq q, embeddings e)) WHERE rank < 8""")
def k3(k):
    vectors = k.table("embeddings")
    return vector.search(vector.centroids(vectors), vectors, id_column="vec_id").select(
        "query_id", "vec_id", "score", "rank"
    )


@query("k3_text_vector_topk", "SELECT query_id, chunk_id, score, rank FROM kvec")
def k3b(k):
    return vector.search(k.query_vectors().select("query_id", "embedding"), k.chunk_vectors()).select(
        "query_id", "chunk_id", "score", "rank"
    )


@query("k3_vector_lsh")
def k3c(k):
    vectors = k.table("embeddings")
    return vector.search_lsh(vector.centroids(vectors), vectors, id_column="vec_id")


@query("k3_vector_cells")
def k3d(k):
    """Every hundredth vector against all, through the inverted file."""
    vectors = k.table("embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return vector.search_cells(queries, vector.inverted_file(vectors, "vec_id"))


@query("k7_rrf_fusion", SHOWN + "f2")
def k7(k):
    return shown(retrieve(k.queries(), text_index(k)))


MULTI = fused("""
SELECT query_id, 0 AS list_pos, 'vector' AS channel, 0.7::DOUBLE AS weight, rank, chunk_id,
       NULL::VARCHAR[] AS facts, NULL::DOUBLE AS gs FROM kvec
UNION ALL SELECT query_id, 1, 'bm25', 1.0::DOUBLE - 0.7::DOUBLE, rank, chunk_id, NULL, NULL FROM kbm25
UNION ALL SELECT query_id, 3, NULL, 0.7::DOUBLE, rank, chunk_id, NULL, NULL FROM kvec
  JOIN kqueries USING (query_id) WHERE replace(lower(query), ' ', '') <> replace(query, ' ', '')
UNION ALL SELECT query_id, 4, NULL, 1.0::DOUBLE - 0.7::DOUBLE, rank, chunk_id, NULL, NULL FROM kbm25
  JOIN kqueries USING (query_id) WHERE replace(lower(query), ' ', '') <> replace(query, ' ', '')""")


def multi_query(k):
    lowered = k.queries().select("query_id", F.lower("query").alias("rewritten"))
    return retrieve_multi(rewritten(k.queries(), lowered), text_index(k))


@query("k8_two_channel_multi_query", SHOWN + "(" + MULTI + ")")
def k8(k):
    return shown(multi_query(k))


@query("e4_matched_queries", f"""
SELECT f.query_id, f.chunk_id, CASE WHEN replace(lower(q.query), ' ', '') <> replace(q.query, ' ', '')
  THEN q.query || ' | ' || lower(q.query) ELSE q.query END AS matched
FROM ({MULTI}) f JOIN kqueries q USING (query_id)""")
def e4b(k):
    """Which texts of a question found a candidate."""
    return multi_query(k).select("query_id", "chunk_id", F.array_join("matched_queries", " | ").alias("matched"))


@query("k9_three_channel", SHOWN + "f3")
def k9(k):
    return shown(retrieve(k.queries(), full_index(k)))


@query("k9_graph_off", SHOWN + "(" + fused("""
SELECT query_id, 0 AS list_pos, 'vector' AS channel, 0.5::DOUBLE / 0.75::DOUBLE AS weight, rank, chunk_id,
       NULL::VARCHAR[] AS facts, NULL::DOUBLE AS gs FROM kvec
UNION ALL SELECT query_id, 1, 'bm25', 0.25::DOUBLE / 0.75::DOUBLE, rank, chunk_id, NULL, NULL FROM kbm25""") + ")")
def k9b(k):
    return shown(retrieve(k.queries(), text_index(k), weights=two_channel_weights()))


@query("k10_channel_down", SHOWN + "(" + fused("""
SELECT query_id, 1 AS list_pos, 'bm25' AS channel, 1.0::DOUBLE - 0.7::DOUBLE AS weight, rank, chunk_id,
       NULL::VARCHAR[] AS facts, NULL::DOUBLE AS gs FROM kbm25""") + ")")
def k10(k):
    """An embedding service that cannot be reached: the other channel answers alone."""
    def unreachable(batch):
        raise ConnectionError("no embedding service")

    def embedder(queries):
        schema = "query_id bigint, embedding array<double>"
        return queries.select("query_id").mapInPandas(lambda frames: map(unreachable, frames), schema)

    failures = []
    found = retrieve(k.queries(), text_index(k), embedder=embedder, failures=failures)
    if [name for name, _ in failures] != ["vector"]:
        raise AssertionError(f"the vector channel should have failed alone: {failures}")
    return shown(found)


@query("k11_first_seen", """
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS rank FROM (
  SELECT query_id, chunk_id, min(p) AS first FROM (
    SELECT query_id, chunk_id, rank AS p FROM kvec UNION ALL SELECT query_id, chunk_id, 100 + rank FROM kbm25)
  GROUP BY ALL)""")
def k11(k):
    lists = fusion.union_lists(channel_lists(k.queries(), text_index(k)))
    return fusion.first_seen(lists).select("query_id", "chunk_id", "rank")


@query("o3_pluggable_retriever", "SELECT query_id, chunk_id, rank FROM kbm25")
def o3(k):
    chunks, index = k.active_chunks(), k.keyword_index()
    retriever = lambda queries: bm25.search(queries, chunks, index=index)
    hits = retriever(k.queries())
    return fusion.first_seen(fusion.ranked_list(hits, "custom", 0, 1.0)).select("query_id", "chunk_id", "rank")


@query("o5_sql_tokenizer", """
SELECT chunk_id, len(t) AS n_tokens FROM ktok""")
def o5(k):
    from corpuslake.functions.register import register_sql

    register_sql(k.spark)
    return k.active_chunks().select("chunk_id", F.expr("size(corpus_tokens(content))").alias("n_tokens"))


@query("o6_splitter_udtf")
def o6(k):
    from corpuslake.functions.register import register_sql

    register_sql(k.spark)
    k.documents().select("document_id", "text").createOrReplaceTempView("corpus_documents")
    return k.spark.sql(
        "SELECT d.document_id, s.piece_index, s.content FROM corpus_documents d, LATERAL split_chunks(d.text) s"
    )


# --- metadata merge and rerank ---------------------------------------------

@query("e4_metadata_merge", """
SELECT query_id, chunk_id, channels, round(graph_score, 6) AS graph_score FROM f3""")
def e4(k):
    return retrieve(k.queries(), full_index(k)).select(
        "query_id", "chunk_id", F.array_join("retrieval_channels", ",").alias("channels"),
        F.round("graph_score", 6).alias("graph_score"),
    )


@query("g2_fusion_topk", "SELECT query_id, chunk_id, rank FROM f2")
def g2(k):
    return retrieve(k.queries(), text_index(k)).select("query_id", "chunk_id", "rank")


@query("g3_rerank_passthrough", "SELECT query_id, chunk_id, rank, false AS degraded FROM f2 WHERE rank < 5")
def g3(k):
    return fusion.rerank_passthrough(retrieve(k.queries(), text_index(k))).select(
        "query_id", "chunk_id", "rank", F.col("reranker_degraded").alias("degraded")
    )


@query("g3_rerank_degraded", "SELECT query_id, chunk_id, rank, true AS degraded FROM f2")
def g3b(k):
    return fusion.rerank_degraded(retrieve(k.queries(), text_index(k))).select(
        "query_id", "chunk_id", "rank", F.col("reranker_degraded").alias("degraded")
    )


@query("o2_rerank_scorer", """
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY length(content) DESC, f2.rank) - 1 AS rank
FROM f2 JOIN kactive USING (chunk_id) QUALIFY rank < 5""".replace("QUALIFY rank < 5", """
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(content) DESC, f2.rank) <= 5"""))
def o2(k):
    """A scorer that prefers long texts, in place of a model."""
    def by_length(question: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.len().astype("float64")

    return fusion.rerank(candidates(k.queries(), text_index(k)), k.queries(), by_length).select(
        "query_id", "chunk_id", "rank"
    )


@query("o2_rerank_failure", """
SELECT query_id, chunk_id, rank, true AS degraded FROM f2""")
def o2b(k):
    """A scorer that fails: all candidates stay, by fusion score."""
    def broken(question: pd.Series, text: pd.Series) -> pd.Series:
        raise TimeoutError("no answer")

    return fusion.rerank(candidates(k.queries(), text_index(k)), k.queries(), broken).select(
        "query_id", "chunk_id", "rank", F.col("reranker_degraded").alias("degraded"))


# --- context ---------------------------------------------------------------

def ranked_candidates(k):
    """What goes into contexts: the reranked candidates."""
    return reranked(k.queries(), full_index(k))


@query("l1_context_dedup", "SELECT query_id, chunk_id, rank FROM deduped")
def l1(k):
    return context.dedup(ranked_candidates(k)).select("query_id", "chunk_id", "rank")


@query("l2_source_quota", "SELECT query_id, chunk_id, place AS rank FROM quota")
def l2(k):
    return context.source_quota(context.dedup(ranked_candidates(k))).select("query_id", "chunk_id", "rank")


@query("g7_context_cap", "SELECT query_id, count(*) AS n FROM quota GROUP BY 1")
def g7(k):
    return context.source_quota(context.dedup(ranked_candidates(k))).groupBy("query_id").agg(
        F.count("*").alias("n")
    )


@query("l3_token_budget", "SELECT query_id, place AS rank, txt AS cited_text FROM budget")
def l3(k):
    return context.fit_budget(context.source_quota(context.dedup(ranked_candidates(k)))).select(
        "query_id", "rank", "cited_text"
    )


@query("l4_context_text", "SELECT query_id, context FROM contexts")
def l4(k):
    return answer_contexts(k.queries(), full_index(k)).select("query_id", "context")


@query("l5_source_entries", """
SELECT query_id, citation_id, document_id, chunk_id, source, NULL::BIGINT AS page, NULL::VARCHAR AS section,
       substr(content, 1, 200) AS preview, channels AS retrieval_channels,
       array_to_string(graph_facts, '; ') AS graph_facts, round(fusion_score, 6) AS fusion_score FROM blocks""")
def l5(k):
    built = answer_contexts(k.queries(), full_index(k))
    return built.select("query_id", F.inline("sources")).withColumns({
        "retrieval_channels": F.array_join("retrieval_channels", ","),
        "graph_facts": F.array_join("graph_facts", "; "),
        "fusion_score": F.round("fusion_score", 6),
    })


@query("i15_source_list", """
SELECT query_id, string_agg(source, ',' ORDER BY p) AS sources FROM (
  SELECT query_id, source, min(place) AS p FROM blocks GROUP BY ALL) GROUP BY 1""")
def i15(k):
    built = answer_contexts(k.queries(), full_index(k))
    return built.where(F.size("sources") > 0).select(
        "query_id",
        F.array_join(
            F.array_distinct(F.transform("sources", lambda s: tx.eval_source(s["source"]))), ","
        ).alias("sources"),
    )


@query("a9_context_snapshot", """
SELECT c.query_id, 1 AS schema_version, c.query AS original_query, c.query AS retrieval_query, c.context,
       length(c.context) AS context_character_count, c.n_sources, coalesce(b.n, 0) AS n_with_facts
FROM contexts c LEFT JOIN (SELECT query_id, count(*) AS n FROM blocks WHERE len(graph_facts) > 0 GROUP BY 1) b USING (query_id)""")
def a9(k):
    root = shared_dir(k.spark, "snapshots")
    tables.write_snapshots(answer_contexts(k.queries(), full_index(k)), root)
    kept = (
        "query_id bigint, schema_version int, original_query string, retrieval_query string, "
        "llm_input struct<context:string>, context_character_count int, "
        "sources array<struct<citation_id:string>>, graph_facts array<struct<citation_id:string>>"
    )
    return k.spark.read.schema(kept).json(root).select(
        "query_id", "schema_version", "original_query", "retrieval_query",
        F.col("llm_input.context").alias("context"), "context_character_count",
        F.size("sources").alias("n_sources"), F.size("graph_facts").alias("n_with_facts"),
    )


# --- evaluation ------------------------------------------------------------

def top_two(k):
    """Best five of two-channel retrieval, kept on the shared folder."""
    return cut_lineage(
        fusion.rerank_passthrough(candidates(k.queries(), text_index(k))).select("query_id", "rank", "source"),
        "ranked",
    )


def top_three(k):
    return cut_lineage(
        ranked_candidates(k).select("query_id", "rank", "source"), "ranked"
    )


def metrics_two(k, ranked=None):
    return evaluate.retrieval_metrics(
        k.queries().select("query_id"), ranked if ranked is not None else top_two(k), k.relevant()
    )


def metrics_three(k, ranked=None):
    return evaluate.retrieval_metrics(
        k.queries().select("query_id"), ranked if ranked is not None else top_three(k), k.relevant()
    )


def summarised(k, ranked, extra=None):
    metrics = evaluate.retrieval_metrics(k.queries().select("query_id"), ranked, k.relevant())
    names = list(evaluate.METRICS)
    if extra is not None:
        metrics, names = metrics.join(extra, "query_id"), names + ["answer_keyword_recall"]
    counted = ranked.groupBy("query_id").agg(F.count("*").alias("n_retrieved"))
    results = (
        metrics.join(k.questions().select("query_id", "unanswerable"), "query_id")
        .join(counted, "query_id", "left").na.fill(0, ["n_retrieved"])
        .withColumn("status", F.lit("ok"))
    )
    return evaluate.summary(results, names)


def summary_two(k):
    return summarised(k, top_two(k))


@query("p1_recall_at_k", "SELECT query_id, recall_at_5, recall_at_10 FROM m2")
def p1(k):
    return metrics_two(k).select("query_id", "recall_at_5", "recall_at_10")


@query("p2_mrr_at_10", "SELECT query_id, mrr_at_10 FROM m2")
def p2(k):
    return metrics_two(k).select("query_id", "mrr_at_10")


@query("p3_ndcg_at_10", "SELECT query_id, ndcg_at_10 FROM m2")
def p3(k):
    return metrics_two(k).select("query_id", "ndcg_at_10")


@query("p4_source_hit", "SELECT query_id, source_hit FROM m2")
def p4(k):
    return metrics_two(k).select("query_id", "source_hit")


KEYWORDS = """
SELECT c.query_id, CASE WHEN len(u.answer_keywords) = 0 THEN 0.0::DOUBLE ELSE
  round(len(list_filter(u.answer_keywords, lambda w: contains(lower(c.context), w)))::DOUBLE / len(u.answer_keywords), 6)
  END AS answer_keyword_recall FROM contexts c JOIN kquestions u USING (query_id)"""


def answers(k):
    """The cited context itself as the answer, kept on the shared folder."""
    return cut_lineage(answer_contexts(k.queries(), full_index(k)), "contexts")


def keyword_scores(k, contexts):
    return contexts.join(k.questions().select("query_id", "answer_keywords"), "query_id").select(
        "query_id",
        F.round(tx.keyword_recall(F.col("context"), F.col("answer_keywords")), 6).alias("answer_keyword_recall"),
    )


@query("p5_keyword_recall", KEYWORDS)
def p5(k):
    return keyword_scores(k, answers(k))


@query("p6_retrieval_evaluation", """
SELECT m.*, u.unanswerable, 'ok' AS status FROM m3 m JOIN kquestions u USING (query_id)""")
def p6(k):
    no_errors = k.queries().where(F.col("query").isNull()).select("query_id", F.lit("no text").alias("error"))
    return evaluate.with_failures(metrics_three(k), no_errors).drop("error").join(
        k.questions().select("query_id", "unanswerable"), "query_id"
    )


@query("p6_failed_questions", """
SELECT m.query_id, CASE WHEN unanswerable THEN 0.0::DOUBLE ELSE recall_at_5 END AS recall_at_5,
       CASE WHEN unanswerable THEN 0.0::DOUBLE ELSE source_hit END AS source_hit,
       CASE WHEN unanswerable THEN 'error' ELSE 'ok' END AS status, CASE WHEN unanswerable THEN 'no source' END AS error
FROM m3 m JOIN kquestions u USING (query_id)""")
def p6b(k):
    """Questions without a source fail: they stay, as errors with metrics of zero."""
    failed = k.questions().where("unanswerable").select("query_id", F.lit("no source").alias("error"))
    return evaluate.with_failures(metrics_three(k), failed).select(
        "query_id", "recall_at_5", "source_hit", "status", "error")


def context_sources(contexts):
    return contexts.select("query_id", F.posexplode("sources").alias("rank", "s")).select(
        "query_id", "rank", F.col("s.source").alias("source")
    )


@query("p7_full_evaluation", f"""
SELECT m.*, a.answer_keyword_recall FROM mfull m JOIN ({KEYWORDS}) a USING (query_id)""")
def p7(k):
    contexts = answers(k)
    metrics = evaluate.retrieval_metrics(
        k.queries().select("query_id"), context_sources(contexts), k.relevant()
    )
    return metrics.join(keyword_scores(k, contexts), "query_id")


@query("p8_summary", "SELECT metric, value FROM s3")
def p8(k):
    return summarised(k, top_three(k))


@query("p8_full_summary", "SELECT metric, value FROM (" + summary_rows(
    f"SELECT m.*, a.answer_keyword_recall FROM mfull m JOIN ({KEYWORDS}) a USING (query_id)",
    "SELECT query_id FROM blocks", ("answer_keyword_recall",)) + ")")
def p8b(k):
    contexts = answers(k)
    return summarised(k, context_sources(contexts), keyword_scores(k, contexts))


@query("p9_run_comparison", """
SELECT metric, a.value AS base, b.value AS final, round(b.value - a.value, 6) AS diff,
       CASE WHEN a.value = 0 THEN 'N/A' ELSE format('{:+.1f}%', round((b.value - a.value) / a.value * 100, 1)) END AS percent
FROM s2 a JOIN s3 b USING (metric)""")
def p9(k):
    return evaluate.compare(summary_two(k), summarised(k, top_three(k)))


@query("a10_result_rows", """
SELECT query_id, recall_at_5, mrr_at_10, 'two_channel' AS label, 'all' AS split, fingerprint AS corpus_fingerprint FROM m2, kfp""")
def a10b(k):
    """The result files, read again."""
    return a10(k).drop("question_set_hash")


@query("a10_result_sink")
def a10(k):
    root = shared_dir(k.spark, "results")
    asked = k.questions().withColumnRenamed("query_id", "id")
    questions.save_results(metrics_two(k), asked, k.documents(), root, "two_channel", "all")
    schema = (
        "query_id bigint, recall_at_5 double, mrr_at_10 double, label string, "
        "meta struct<question_set_hash:string,corpus_fingerprint:string,split:string>"
    )
    return k.spark.read.schema(schema).json(root).select("query_id", "recall_at_5", "mrr_at_10", "label", "meta.*")
