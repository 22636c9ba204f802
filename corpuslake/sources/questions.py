"""Question sets and evaluation results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS, Settings
from corpuslake.functions import text as tx
from corpuslake.operators import maintain
from corpuslake.schemas import QUESTIONS


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Questions with ``valid`` and ``reject_reason``; blank lines are skipped.

    Required: id, split, category, question. Answerable questions need a ground
    truth and keywords; unanswerable ones must not name relevant sources.
    """
    raw = F.trim(column)
    broken = F.try_parse_json(raw).isNull() | ~raw.startswith("{")
    has = lambda name: F.get_json_object(raw, f"$.{name}").isNotNull()
    missing = F.array_compact(F.array(*[
        F.when(~has(name), F.lit(name)) for name in ("id", "split", "category", "question")
    ]))
    empty_list = lambda name: F.coalesce(F.size(f"q.{name}"), F.lit(0)) <= 0
    unanswerable = F.coalesce("q.unanswerable", F.lit(False))
    reason = (
        F.when(broken, "invalid JSON")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
        .when(~unanswerable & (F.coalesce("q.ground_truth", F.lit("")) == ""), "no ground_truth")
        .when(~unanswerable & empty_list("answer_keywords"), "no answer_keywords")
        .when(unanswerable & ~empty_list("relevant_sources"), "unanswerable with sources")
    )
    return (
        lines.where(raw != "")
        .withColumn("q", F.from_json(raw, QUESTIONS))
        .withColumn("reject_reason", reason)
        .select(
            *[F.col(f"q.{name}").alias(name) for name in QUESTIONS.names if name != "unanswerable"],
            unanswerable.alias("unanswerable"),
            F.col("reject_reason").isNull().alias("valid"),
            "reject_reason",
        )
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def save_results(
    results: DataFrame, questions: DataFrame, files: DataFrame, path: str,
    label: str, split: str, settings: Settings = DEFAULTS,
) -> None:
    """Write per-question results with the run's metadata, one folder per label."""
    meta = F.struct(
        tx.iso_timestamp(F.current_timestamp()).alias("run_at"),
        F.lit(split).alias("split"),
        maintain.question_set_fingerprint(questions).scalar().alias("question_set_hash"),
        maintain.corpus_fingerprint(files).scalar().alias("corpus_fingerprint"),
        F.struct(
            F.lit(settings.vector_k).alias("vector_search_k"),
            F.lit(settings.bm25_k).alias("bm25_search_k"),
            F.lit(settings.hybrid_vector_weight).alias("hybrid_vector_weight"),
            F.lit(settings.rerank_top_k).alias("rerank_top_k"),
        ).alias("retrieval_config"),
        F.struct(
            F.lit("recursive").alias("chunk_strategy"),
            F.lit(settings.chunk_size).alias("chunk_size"),
            F.lit(settings.chunk_overlap).alias("chunk_overlap"),
        ).alias("chunk_config"),
    )
    (
        results.withColumn("meta", meta).withColumn("label", F.lit(label))
        .write.partitionBy("label").mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").json(path)
    )
