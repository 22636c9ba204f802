"""Channels to one candidate list: weighted reciprocal ranks and reranking.

A ranked list is a long table with query_id, list_pos (order of the lists),
channel, weight, rank (0-based) and the chunk with its metadata. Every list is
short (top-k of a channel), so all groups here are small and bounded.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS, Settings
from corpuslake.functions import text as tx
from corpuslake.operators import ranking

LIST_COLUMNS = ["query_id", "list_pos", "channel", "weight", "rank", "chunk_id"]


def ranked_list(
    hits: DataFrame, channel: str, list_pos, weight: float, extra: list[str] | None = None
) -> DataFrame:
    """Give the hits of one channel the common shape of a ranked list."""
    position = F.lit(list_pos) if isinstance(list_pos, int) else list_pos
    facts = (
        F.col("graph_facts") if "graph_facts" in hits.columns
        else F.array().cast("array<string>")
    )
    score = (
        F.col("graph_score") if "graph_score" in hits.columns
        else F.lit(None).cast("double")
    )
    return hits.select(
        "query_id",
        position.cast("int").alias("list_pos"),
        F.lit(channel).alias("channel"),
        F.lit(weight).cast("double").alias("weight"),
        F.col("rank").cast("int").alias("rank"),
        "chunk_id",
        facts.alias("graph_facts"),
        score.alias("graph_score"),
        *(extra or []),
    )


def union_lists(lists: list[DataFrame]) -> DataFrame:
    """Long table of all lists; a channel that failed is simply left out."""
    if not lists:
        raise ValueError("at least one ranked list is needed")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)


def _ordered(column: str):
    """Values of a column in arrival order (list, then rank)."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct("list_pos", "rank", F.col(column).alias("v")))),
        lambda item: item["v"],
    )


def rrf(lists: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Weighted reciprocal rank fusion per query.

    A chunk that is in several lists, or twice in one, adds up; a row without chunk
    id is a result of its own. Metadata merge in arrival order (channels, facts and
    ``matched_queries`` without repeats); equal scores keep the order of first sight.
    """
    share = F.col("weight") / (F.lit(settings.rrf_k) + F.col("rank") + 1)
    arrival = F.struct("list_pos", "rank")
    own = {*LIST_COLUMNS, "graph_facts", "graph_score", "matched_queries"}
    rest = [name for name in lists.columns if name not in own]
    alone = F.when(F.col("chunk_id").isNull(), arrival).alias("_alone")
    matched = [
        F.array_distinct(F.flatten(F.filter(
            _ordered("matched_queries"), lambda names: names.isNotNull()
        ))).alias("matched_queries")
    ] if "matched_queries" in lists.columns else []
    merged = lists.groupBy("query_id", "chunk_id", alone).agg(
        *matched,
        F.round(F.sum(share), 9).alias("fusion_score"),
        F.array_distinct(_ordered("channel")).alias("retrieval_channels"),
        F.array_distinct(F.flatten(_ordered("graph_facts"))).alias("graph_facts"),
        F.max("graph_score").alias("graph_score"),
        F.min(arrival).alias("_first"),
        *[
            F.min_by(
                name, F.when(F.col(name).isNotNull() & (F.col(name) != ""), arrival)
            ).alias(name)
            if dict(lists.dtypes)[name] == "string"
            else F.min_by(name, F.when(F.col(name).isNotNull(), arrival)).alias(name)
            for name in rest
        ],
    )
    return ranking.top_k(
        merged, ["query_id"], [F.desc("fusion_score"), F.asc("_first")],
        settings.candidate_k,
    ).drop("_first", "_alone")


def multi_query_position(query_index, list_index: int, lists_per_query: int):
    """Place of a list when several queries are fused: query first, then channel."""
    return query_index * lists_per_query + list_index


def first_seen(hits: DataFrame) -> DataFrame:
    """Without fusion: first occurrence of each chunk over the ordered lists."""
    first = ranking.first_per_key(
        hits, ["query_id", "chunk_id"], F.struct("list_pos", "rank")
    )
    return ranking.top_k(
        first.withColumnRenamed("rank", "_rank"),
        ["query_id"], [F.asc("list_pos"), F.asc("_rank")], None,
    ).drop("_rank")


# --- rerank ----------------------------------------------------------------

def rerank_passthrough(
    candidates: DataFrame, k: int = DEFAULTS.rerank_top_k
) -> DataFrame:
    return candidates.where(F.col("rank") < k).withColumn("reranker_degraded", F.lit(False))


def rerank_degraded(candidates: DataFrame) -> DataFrame:
    """When the scorer fails: all candidates by fusion score, with a flag."""
    return ranking.top_k(
        candidates.withColumnRenamed("rank", "_rank"),
        ["query_id"], [F.desc("fusion_score"), F.asc("_rank")], None,
    ).drop("_rank").withColumn("reranker_degraded", F.lit(True))


def rerank(
    candidates: DataFrame,
    queries: DataFrame,
    scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None,
    k: int = DEFAULTS.rerank_top_k,
) -> DataFrame:
    """Best ``k`` by a pluggable scorer on (original query, chunk text).

    Where the scorer fails, the questions of that batch keep all their candidates, by
    fusion score and marked as degraded.
    """
    if scorer is None:
        return rerank_passthrough(candidates, k)

    @F.pandas_udf("score double, failed boolean")
    def run(asked: pd.Series, text: pd.Series) -> pd.DataFrame:
        try:
            scores = pd.Series(scorer(asked, text), dtype="float64").reset_index(drop=True)
            if len(scores) != len(text):
                raise ValueError(f"{len(scores)} scores for {len(text)} texts")
        except Exception:  # degraded, and marked so in the rows
            return pd.DataFrame({"score": [None] * len(text), "failed": True})
        return pd.DataFrame({"score": scores, "failed": False})

    own = Window.partitionBy("query_id")  # a question's few candidates
    scored = candidates.join(queries.select("query_id", "query"), "query_id").withColumn(
        "_s", run(F.col("query"), F.col("content"))
    ).withColumn("reranker_degraded", F.max("_s.failed").over(own))
    by = F.when(F.col("reranker_degraded"), F.col("fusion_score")).otherwise(F.col("_s.score"))
    ranked = ranking.top_k(
        scored.withColumn("rerank_score", by).withColumnRenamed("rank", "_rank"),
        ["query_id"], [F.desc("rerank_score"), F.asc("_rank")], None,
    )
    return ranked.where(F.col("reranker_degraded") | (F.col("rank") < k)).withColumn(
        "rerank_score", F.col("_s.score")).drop("_rank", "query", "_s")


def attach_chunks(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text and source of the candidate chunks; the candidates are the small side."""
    payload = chunks.select(
        "chunk_id", "document_id", "content", "content_hash",
        F.coalesce(F.col("source_path"), F.lit("unknown")).alias("source"),
        *[c for c in ("page", "section") if c in chunks.columns],
    )
    return candidates.join(payload, "chunk_id")


def source_label(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("source", tx.context_source(F.col("source")))
