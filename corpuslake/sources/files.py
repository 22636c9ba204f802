"""Corpus files to documents: listing, loading by type, rejects as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import text as tx


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Supported files below ``root`` with their path relative to it.

    Only the listing is read: the content column is pruned unless used later.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # A plus sign is itself in a path, not an encoded blank.
    path = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    relative = F.substring_index(path, root.rstrip("/") + "/", -1)
    return files.withColumn("source_path", relative).where(
        tx.is_supported_file(F.col("source_path"))
    )


def load(files: DataFrame) -> DataFrame:
    """Text of plain, HTML and Markdown files, with a reason for each reject.

    PDF and DOCX need a parser for their format; their text enters as a table,
    so here they are rejects. Input is UTF-8.
    """
    kind = tx.file_extension(F.col("source_path"))
    raw = F.try_validate_utf8(F.col("content").cast("string"))
    text = (
        F.when(kind == "txt", raw)
        .when(kind.isin("html", "htm"), tx.html_to_text(raw))
        .when(kind == "md", tx.markdown_to_text(raw))
    )
    return files.select(
        F.sha2(F.col("source_path"), 256).alias("document_id"),
        "source_path",
        tx.file_fingerprint(F.col("content")).alias("file_hash"),
        F.col("length").alias("file_size"),
        text.alias("text"),
        F.when(kind.isin("pdf", "docx"), "needs_parser")
        .when(raw.isNull(), "not_utf8")
        .when(tx.is_blank(text), "blank")
        .alias("reject_reason"),
    )


def split_rejects(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable documents, and the rejects with their reasons."""
    return (
        loaded.where("reject_reason is null").drop("reject_reason"),
        loaded.where("reject_reason is not null").drop("text"),
    )


def drop_blank(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.where(~tx.is_blank(F.col(text)))


def check_uploads(listing: DataFrame) -> DataFrame:
    """Upload listing (name, size) with the reason for each refusal."""
    return listing.withColumn(
        "reject_reason", tx.upload_reject_reason(F.col("name"), F.col("size"))
    )
