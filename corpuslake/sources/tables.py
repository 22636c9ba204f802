"""Reads over the knowledge tables, and the context snapshot sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators import context as ctx


def newest_documents(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents, newest first; with a limit a top-k, not a full sort."""
    ordered = documents.orderBy(F.desc("created_at"), "document_id")
    return ordered.limit(limit) if limit else ordered


def ready_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status") == "ready")


def chunks_of(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of the wanted documents in index order."""
    return chunks.join(wanted.select("document_id"), "document_id", "left_semi").orderBy(
        "document_id", "chunk_index"
    )


def with_source(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Source path of each chunk, ``unknown`` when its document is missing."""
    return chunks.join(
        documents.select("document_id", "source_path"), "document_id", "left"
    ).withColumn("source_path", F.coalesce("source_path", F.lit("unknown")))


def write_snapshots(contexts: DataFrame, path: str) -> None:
    """One JSON record per query."""
    ctx.snapshot(contexts).write.mode("overwrite").json(path)
