"""Question tables through the channels, fusion, rerank and context."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS, Settings
from corpuslake.functions import text as tx
from corpuslake.operators import bm25, context, fusion, graph_query, vector
from corpuslake.operators.graph_build import Graph
from corpuslake.session import cut_lineage


@dataclass
class Index:
    """What a question is matched against."""

    chunks: DataFrame
    vectors: DataFrame
    graph: Graph | None = None
    keywords: bm25.KeywordIndex | None = None
    nfkc: bool = True


def embed_queries(queries: DataFrame) -> DataFrame:
    return vector.hashed_embedding(queries.select("query_id", "query"), "query")


def channel_lists(
    queries: DataFrame,
    index: Index,
    settings: Settings = DEFAULTS,
    weights: tuple[float, float, float] | None = None,
    embedder: Callable[[DataFrame], DataFrame] = embed_queries,
    skip: tuple[str, ...] = (),
    failures: list[tuple[str, str]] | None = None,
) -> list[DataFrame]:
    """Ranked lists of vector, keyword and graph search, in this order.

    Without a graph there are two channels. A channel named in ``skip`` is left
    out, as an empty list would be. With ``failures``, a channel that fails is left out too and
    put down there with its error; without, its error is raised.
    """
    if weights is None:
        weights = (
            (settings.vector_weight, settings.bm25_weight, settings.graph_weight)
            if index.graph is not None
            else (settings.hybrid_vector_weight, 1.0 - settings.hybrid_vector_weight, 0.0)
        )
    channels = {
        "vector": lambda: vector.search(
            embedder(queries).select("query_id", "embedding"), index.vectors, settings.vector_k),
        "bm25": lambda: bm25.search(queries, index.chunks, settings, index=index.keywords),
    }
    if index.graph is not None:
        channels["graph"] = lambda: graph_query.search(queries, index.graph, index.chunks, settings, index.nfkc)
    lists = []
    for place, (name, run) in enumerate(channels.items()):
        if name in skip:
            continue
        try:
            # With a list of failures, a channel is run to its end here, so that it fails alone.
            hits = run() if failures is None else cut_lineage(run(), name)
        except Exception as error:
            if failures is None:
                raise
            failures.append((name, str(error)[:500]))
            continue
        lists.append(fusion.ranked_list(hits, name, place, weights[place]))
    return lists


def two_channel_weights(settings: Settings = DEFAULTS) -> tuple[float, float, float]:
    """Vector and keyword weights of the three-channel setup, scaled to sum 1."""
    total = settings.vector_weight + settings.bm25_weight
    if total <= 0:
        return settings.hybrid_vector_weight, 1.0 - settings.hybrid_vector_weight, 0.0
    return settings.vector_weight / total, settings.bm25_weight / total, 0.0


def retrieve(
    queries: DataFrame, index: Index, settings: Settings = DEFAULTS, **options
) -> DataFrame:
    """Fused candidates of every question; ``matched_queries`` are the texts that found them."""
    lists = fusion.union_lists(channel_lists(queries, index, settings, **options))
    asked = queries.select("query_id", F.array("query").alias("matched_queries"))
    return fusion.rrf(lists.join(asked, "query_id"), settings)


def retrieve_multi(
    queries: DataFrame, index: Index, settings: Settings = DEFAULTS, **options
) -> DataFrame:
    """Fused candidates where a question has several query texts.

    ``queries`` has query_id and retrieval_queries (array). Every text runs
    through all channels; the lists of a question are fused together.
    """
    texts = queries.select(
        "query_id", F.posexplode("retrieval_queries").alias("query_index", "query")
    ).withColumn("sub_id", F.concat_ws("/", F.col("query_id").cast("string"), "query_index"))
    flat = texts.select(F.col("sub_id").alias("query_id"), "query")
    lists = channel_lists(flat, index, settings, **options)
    joined = (
        fusion.union_lists(lists).withColumnRenamed("query_id", "sub_id")
        .join(texts.select("sub_id", "query_id", "query_index", F.array("query").alias("matched_queries")), "sub_id")
        .withColumn(
            "list_pos",
            fusion.multi_query_position(F.col("query_index"), F.col("list_pos"), 3),
        )
        .drop("sub_id", "query_index")
    )
    return fusion.rrf(joined, settings)


def rewritten(queries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Questions with their query texts; ``rewrites`` is query_id, rewritten."""
    return queries.join(rewrites, "query_id", "left").withColumn(
        "retrieval_queries", tx.retrieval_queries(F.col("query"), F.col("rewritten"))
    )


def candidates(
    queries: DataFrame, index: Index, settings: Settings = DEFAULTS, **options
) -> DataFrame:
    """Fused candidates with their texts and sources."""
    fused = retrieve(queries, index, settings, **options)
    return fusion.source_label(fusion.attach_chunks(fused, index.chunks))


def reranked(
    queries: DataFrame, index: Index, settings: Settings = DEFAULTS,
    scorer: Callable | None = None, **options,
) -> DataFrame:
    """The candidates that go into a context: those of the original question that rank best."""
    return fusion.rerank(
        candidates(queries, index, settings, **options), queries, scorer, settings.rerank_top_k)


def answer_contexts(
    queries: DataFrame, index: Index, settings: Settings = DEFAULTS, **options
) -> DataFrame:
    """Cited context of every question, ready for a prompt."""
    return context.build_context(
        reranked(queries, index, settings, **options), queries, settings
    )
