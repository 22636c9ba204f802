"""Incremental ingest of arriving documents with Structured Streaming."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslake.config import DEFAULTS, Settings
from corpuslake.functions import text as tx
from corpuslake.operators import chunking, maintain
from corpuslake.schemas import DUPLICATES, KNOWLEDGE_CHUNKS, KNOWLEDGE_DOCUMENTS
from corpuslake.session import cut_lineage, path_exists


def _with(schema: StructType, *columns: str) -> StructType:
    result = StructType(list(schema.fields))
    for column in columns:
        result = result.add(column, "long")
    return result


@dataclass
class StreamTables:
    """Append-only tables, one partition per micro-batch.

    A replayed micro-batch overwrites its own partition, so replays change
    nothing. Readers take the newest row per path and the chunks it points to.
    """

    spark: SparkSession
    root: str
    settings: Settings = DEFAULTS
    chunker: Callable[[DataFrame], DataFrame] = chunking.line_chunks

    DOCUMENTS = _with(KNOWLEDGE_DOCUMENTS, "chunk_batch", "batch_id")
    CHUNKS = _with(KNOWLEDGE_CHUNKS, "batch_id")
    def _read(self, table: str, schema: StructType) -> DataFrame:
        path = f"{self.root}/{table}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _write(self, rows: DataFrame, table: str, schema: StructType, batch: int) -> None:
        (
            rows.withColumn("batch_id", F.lit(batch).cast("long")).select(*schema.names)
            .write.partitionBy("batch_id").mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{table}")
        )

    def documents(self, before: int | None = None, only: DataFrame | None = None,
                  on: str = "source_path") -> DataFrame:
        """Newest row per path; ``only`` narrows the table before the shuffle.

        With another column than the path, all paths that ever had one of its values
        are looked at, and those whose newest row still has one are given.
        """
        rows = self._read("documents", self.DOCUMENTS)
        if before is not None:
            rows = rows.where(F.col("batch_id") < before)
        wanted = None if only is None else only.select(on).distinct()
        if wanted is not None:
            paths = rows.join(wanted, on, "left_semi").select("source_path").distinct()
            rows = rows.join(paths, "source_path", "left_semi")
        rest = [name for name in self.DOCUMENTS.names if name != "source_path"]
        newest = rows.groupBy("source_path").agg(
            F.max_by(F.struct(*rest), "batch_id").alias("_row")
        ).select("source_path", *[F.col(f"_row.{name}").alias(name) for name in rest])
        if wanted is None or on == "source_path":
            return newest
        return newest.join(wanted, on, "left_semi").select(*newest.columns)

    def chunks(self) -> DataFrame:
        """Chunks that the newest document rows point to."""
        live = self.documents().select("document_id", F.col("chunk_batch").alias("batch_id"))
        return self._read("chunks", self.CHUNKS).join(
            live, ["document_id", "batch_id"], "left_semi"
        )

    def duplicates(self) -> DataFrame:
        return self._read("duplicates", DUPLICATES)

    def apply(self, files: DataFrame, batch: int) -> None:
        """Take one micro-batch of files (source_path, file_hash, file_size, text)."""
        files = files.groupBy("source_path").agg(
            F.max_by(F.struct("file_hash", "file_size", "text"), "file_hash").alias("_f")
        ).select("source_path", "_f.*")

        # Copies inside the batch: the smallest path stays. Only hashes and paths
        # are compared, the texts stay where they are.
        keepers = files.groupBy("file_hash").agg(F.min("source_path").alias("keeper"))
        known = self.documents(batch, files, on="file_hash").where(
            "status <> 'deleted'"
        ).groupBy("file_hash").agg(F.min("source_path").alias("known"))
        judged = (
            files.join(keepers, "file_hash").join(known, "file_hash", "left")
            .withColumn("existing_path", F.coalesce("known", "keeper"))
        )
        # A path that is already a document of its own goes on to the diff.
        own = self.documents(batch, files).select("source_path", F.lit(True).alias("_own"))
        # Read several times below, so the batch is judged once and kept.
        judged = cut_lineage(judged.join(own, "source_path", "left"), "batch")
        is_copy = (F.col("existing_path") != F.col("source_path")) & F.col("_own").isNull()
        self._write(judged.where(is_copy), "duplicates", DUPLICATES, batch)
        arrived = judged.where(~is_copy).select(
            "source_path", "file_hash", "file_size", "text"
        )

        stored = self.documents(batch, arrived)
        changes = maintain.classify(arrived, stored, self.settings).where(
            F.col("change").isin("added", "modified")
        )
        todo = arrived.join(changes.select("source_path", "document_id"), "source_path").join(
            stored.select(
                "source_path", F.col("chunk_batch").alias("_old_batch"),
                F.col("chunk_count").alias("_old_count"),
            ),
            "source_path", "left",
        ).withColumn(
            "document_id", F.coalesce("document_id", F.sha2("source_path", 256))
        )
        todo = cut_lineage(todo, "batch")
        blank = tx.is_blank(F.col("text"))
        fresh = self.chunker(todo.where(~blank))
        self._write(fresh, "chunks", self.CHUNKS, batch)
        counts = self._read("chunks", self.CHUNKS).where(
            F.col("batch_id") == batch
        ).groupBy("document_id").agg(F.count("*").alias("chunk_count"))
        had_rows = F.col("_old_batch").isNotNull()
        rows = todo.join(counts, "document_id", "left").select(
            "document_id", "source_path", "file_hash", "file_size",
            F.when(~blank | had_rows, "ready").otherwise("failed").alias("status"),
            F.coalesce(
                "chunk_count", F.when(blank, F.col("_old_count")), F.lit(0)
            ).cast("long").alias("chunk_count"),
            F.lit(self.settings.index_schema_version).alias("index_schema_version"),
            F.lit(self.settings.embedding_provider).alias("embedding_provider"),
            F.lit(self.settings.embedding_model).alias("embedding_model"),
            F.when(blank, F.concat(
                F.lit("Not indexed: empty file "),
                F.col("source_path"),
            )).alias("error_message"),
            F.when(blank, F.col("_old_batch")).otherwise(F.lit(batch).cast("long"))
            .alias("chunk_batch"),
        )
        # Written last: without its document row a chunk is not seen.
        self._write(rows, "documents", self.DOCUMENTS, batch)


def ingest(
    arrivals: DataFrame, prepare: Callable[[DataFrame], DataFrame],
    tables: StreamTables, checkpoint: str,
) -> None:
    """Run the stream over everything that has arrived, then stop.

    ``prepare`` turns arriving rows into files. The stream's own checkpoint
    makes a restart go on after the last finished micro-batch.
    """
    query = (
        arrivals.writeStream.foreachBatch(
            lambda rows, batch: tables.apply(prepare(rows), batch)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
