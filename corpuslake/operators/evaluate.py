"""Retrieval and answer metrics over a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text as tx
from corpuslake.operators import ranking

METRICS = ["recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_10", "source_hit"]


def by_split(questions: DataFrame, split: str, limit: int | None = None) -> DataFrame:
    """Questions of one split; ``limit`` is the smoke-run option of the reader."""
    chosen = questions if split == "all" else questions.where(F.col("split") == split)
    return chosen.orderBy("id").limit(limit) if limit else chosen


def distinct_sources(ranked: DataFrame) -> DataFrame:
    """Ranked sources per query without repeats, numbered again from 0.

    ``ranked`` has query_id, rank and source; lists are short.
    """
    keyed = ranked.select(
        "query_id", "rank",
        tx.eval_source(F.coalesce(F.col("source"), F.lit("unknown"))).alias("source_key"),
    )
    first = keyed.groupBy("query_id", "source_key").agg(F.min("rank").alias("_first"))
    return ranking.top_k(first, ["query_id"], [F.asc("_first")], None).drop("_first")


def retrieval_metrics(
    queries: DataFrame, ranked: DataFrame, relevant: DataFrame
) -> DataFrame:
    """Recall@5, recall@10, MRR@10, nDCG@10 and source hit of every query.

    ``relevant`` has query_id and source. Queries without relevant sources or
    without results score 0. A source may be relevant to many queries and a query
    may have many relevant sources; both are joined on the pair, and counted.
    """
    truth = relevant.select(
        "query_id", tx.eval_source(F.col("source")).alias("source_key")
    ).distinct()
    hits = distinct_sources(ranked).join(truth, ["query_id", "source_key"], "left_semi")
    gain = F.lit(1.0) / F.log2(F.col("rank") + F.lit(2.0))
    found = hits.groupBy("query_id").agg(
        F.count_if(F.col("rank") < 5).alias("_hit5"),
        F.count_if(F.col("rank") < 10).alias("_hit10"),
        F.min(F.when(F.col("rank") < 10, F.col("rank"))).alias("_best"),
        F.sum(F.when(F.col("rank") < 10, gain)).alias("_dcg"),
    )
    size = truth.groupBy("query_id").agg(F.count("*").alias("_n"))
    ideal = F.aggregate(
        F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(10)).cast("int") - 1),
        F.lit(0.0),
        lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(2.0)),
    )
    zero = lambda value: F.round(F.coalesce(value, F.lit(0.0)), 6)
    return (
        queries.join(size, "query_id", "left").join(found, "query_id", "left")
        .select(
            *queries.columns,
            zero(F.col("_hit5") / F.col("_n")).alias("recall_at_5"),
            zero(F.col("_hit10") / F.col("_n")).alias("recall_at_10"),
            zero(F.lit(1.0) / (F.col("_best") + 1)).alias("mrr_at_10"),
            zero(F.when(F.col("_n") > 0, F.col("_dcg") / ideal)).alias("ndcg_at_10"),
            F.when(F.col("_hit5").isNotNull(), 1.0).otherwise(0.0).alias("source_hit"),
        )
    )


def with_failures(metrics: DataFrame, failed: DataFrame) -> DataFrame:
    """Questions that could not be run count as errors with zero metrics."""
    errors = failed.select("query_id", F.substring("error", 1, 500).alias("error"))
    joined = metrics.join(errors, "query_id", "left")
    bad = F.col("error").isNotNull()
    return joined.withColumns({
        **{
            name: F.when(bad, 0.0).otherwise(F.col(name))
            for name in METRICS + ["answer_keyword_recall"] if name in metrics.columns
        },
        "status": F.when(bad, "error").otherwise("ok"),
    })


def summary(results: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Long table metric, value over the questions.

    Means cover answerable questions that ran; ``results`` has unanswerable,
    status and the metric columns.
    """
    ran = F.col("status") != "error"
    pool = ~F.col("unanswerable") & ran
    row = results.agg(
        F.count("*").cast("double").alias("total_questions"),
        F.count_if(~ran).cast("double").alias("failed_count"),
        F.count_if("unanswerable").cast("double").alias("unanswerable_count"),
        F.coalesce(
            F.count_if(F.col("unanswerable") & ran & (F.col("source_hit") > 0))
            / F.nullif(F.count_if("unanswerable"), F.lit(0)),
            F.lit(0.0),
        ).alias("unanswerable_wrong_hit_rate"),
        F.coalesce(
            F.count_if(F.col("unanswerable") & ran & (F.col("n_retrieved") > 0))
            / F.nullif(F.count_if("unanswerable"), F.lit(0)),
            F.lit(0.0),
        ).alias("unanswerable_nonempty_rate"),
        *[
            F.coalesce(F.avg(F.when(pool, F.col(name))), F.lit(0.0)).alias(name)
            for name in metrics
        ],
    )
    return row.select(
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("metric"), F.round(name, 6).alias("value"))
            for name in row.columns
        ]))
    )


def stage_percentiles(timings: DataFrame, question: str | None = None) -> DataFrame:
    """Mean and nearest-rank p50 and p95 per stage; ``timings`` is stage, seconds. With a column that
    names the question, a stage ``total`` has the same over the questions' whole times."""
    if question is not None:
        whole = timings.groupBy(question).agg(F.round(F.sum("seconds"), 6).alias("seconds"))
        timings = timings.select("stage", "seconds").unionByName(
            whole.select(F.lit("total").alias("stage"), "seconds"))
    levels = ranking.nearest_rank_percentiles(timings, ["stage"], "seconds", [0.5, 0.95])
    wide = levels.groupBy("stage").agg(
        F.max(F.when(F.col("p") == 0.5, F.col("seconds"))).alias("p50"),
        F.max(F.when(F.col("p") == 0.95, F.col("seconds"))).alias("p95"),
    )
    means = timings.groupBy("stage").agg(F.round(F.avg("seconds"), 6).alias("avg"))
    return means.join(wide, "stage")


def compare(base: DataFrame, final: DataFrame) -> DataFrame:
    """Two summaries side by side; a metric that one run lacks counts as 0."""
    b = base.select("metric", F.col("value").alias("base"))
    f = final.select("metric", F.col("value").alias("final"))
    diff = F.col("final") - F.col("base")
    return (
        b.join(f, "metric", "full_outer")
        .na.fill(0.0, ["base", "final"])
        .select(
            "metric", "base", "final", F.round(diff, 6).alias("diff"),
            F.when(F.col("base") == 0, "N/A").otherwise(
                F.format_string("%+.1f%%", F.round(diff / F.col("base") * 100, 1))
            ).alias("percent"),
        )
    )
