"""Training-data pipeline over ``documents``: toxic texts go, one text of each group of near
duplicates stays, benchmark leaks go, secrets are masked, and what is left is encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import (
    decontaminate, jaccard_join, secret_scan, sentencepiece_bpe, toxicity,
)
from corpuslake.llm.registry import table
from corpuslake.llm.workspace import Workspace, near

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labelled documents among
    these; null texts and texts of white space alone are kept."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    wordless = ~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    return toxicity.score(docs, model, *COLUMNS[1:]).where((F.col("predicted") == 0) | wordless).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one that gives the group its id. Texts
    without words and rows without doc_id are in no group and stay; of rows that repeat a doc_id
    all that belong to the kept id stay."""
    work = Workspace(spark, "pipeline")
    groups = jaccard_join.join(docs, work)
    gone = work.keep(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(near(gone), "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced and ``n_chars`` counted anew where text changed. Every run scans
    all of its texts, each distinct one once; the shared ledger gets what it lacks."""
    work = Workspace(spark, "pipeline")
    own = f"{work.base}/ledger"
    found = secret_scan.scan(docs, own).where(F.size("spans") > 0)
    found = work.keep(found.groupBy("blob").agg(F.first("spans").alias("spans")), "found")
    secret_scan.add_unseen(spark, own, secret_scan.shared_ledger(spark))
    keyed = docs.withColumn("blob", secret_scan.blob_of(F.col("text")))
    joined = keyed.join(near(found), "blob", "left").select(*COLUMNS, "spans")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secret_scan.redact(F.col("text"), F.col("spans")))
    return joined.withColumn("masked", text).select(
        "doc_id", F.col("masked").alias("text"), "lang", "source",
        F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(
            F.length("masked").cast("long")).alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they give, and the documents' other columns."""
    return sentencepiece_bpe.encode(
        docs, sentencepiece_bpe.default_model(), "doc_id", "lang", "source", "n_chars",
    ).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode),
]

# Neither training nor encoding can be said in SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again as the next one's input."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
