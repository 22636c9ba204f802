"""Keeping the tables in step with the corpus: diff, publish, audit, roll back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS, Settings
from corpuslake.functions import text as tx
from corpuslake.operators import ranking

# --- fingerprints ----------------------------------------------------------

def set_fingerprint(lines: DataFrame, key: str, line: str, width: int = 4) -> DataFrame:
    """Order-blind fingerprint of a table of lines: 16 hex digits.

    Lines are sorted and hashed inside buckets of the key's hash (16^width of
    them), then the bucket hashes are hashed in order. A bucket holds a small
    share of the keys, so no task sees the whole table.
    """
    buckets = (
        lines.withColumn("_bucket", F.substring(F.sha2(key, 256), 1, width))
        .groupBy("_bucket")
        .agg(
            F.sha2(
                F.array_join(F.array_sort(F.collect_list(F.col(line))), "\n"), 256
            ).alias("_hash")
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("_bucket", "_hash")))
    return buckets.agg(
        F.substring(
            F.sha2(F.array_join(F.transform(ordered, lambda b: b["_hash"]), ""), 256), 1, 16
        ).alias("fingerprint")
    )


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """Fingerprint of all paths and file hashes."""
    lines = files.select(
        F.col("source_path").alias("key"),
        F.concat_ws(":", "source_path", "file_hash").alias("line"),
    )
    return set_fingerprint(lines, "key", "line")


def question_set_fingerprint(questions: DataFrame) -> DataFrame:
    lines = questions.select(
        F.col("id").cast("string").alias("key"),
        F.to_json(F.struct(*sorted(questions.columns))).alias("line"),
    )
    return set_fingerprint(lines, "key", "line")


# --- snapshot diff ---------------------------------------------------------

def is_stale(file_hash, settings: Settings = DEFAULTS):
    """Does a stored document need indexing again?"""
    wanted = {
        "status": F.lit("ready"),
        "error_message": F.lit(""),
        "file_hash": file_hash,
        **{name: F.lit(getattr(settings, name)) for name in (
            "index_schema_version", "embedding_provider", "embedding_model")},
    }
    stored = {name: F.col(name) for name in wanted}
    stored["error_message"] = F.coalesce(F.col("error_message"), F.lit(""))
    as_text = lambda row: F.struct(*[v.cast("string").alias(n) for n, v in row.items()])
    return ~as_text(stored).eqNullSafe(as_text(wanted))


def classify(
    files: DataFrame, stored: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """added, modified, deleted or unchanged for every path on either side.

    ``files`` has source_path and file_hash, ``stored`` is the document table.
    Documents already marked as deleted do not count again.
    """
    known = stored.select(
        "source_path", "document_id", "file_hash", "status", "error_message",
        "index_schema_version", "embedding_provider", "embedding_model",
    ).withColumn("_known", F.lit(True))
    listed = files.select("source_path", F.col("file_hash").alias("new_hash")).withColumn(
        "_listed", F.lit(True)
    )
    change = (
        F.when(F.col("_known").isNull(), "added")
        .when(F.col("_listed").isNull() & (F.col("status") == "deleted"), None)
        .when(F.col("_listed").isNull(), "deleted")
        .when(is_stale(F.col("new_hash"), settings), "modified")
        .otherwise("unchanged")
    )
    return (
        listed.join(known, "source_path", "full_outer")
        .withColumn("change", change)
        .where("change is not null")
        .select(
            "source_path", "change", "document_id",
            F.coalesce("new_hash", "file_hash").alias("file_hash"),
        )
    )


def duplicate_uploads(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """Uploads whose content is already stored: id and path of the newest copy."""
    newest = stored.where("status <> 'deleted'").groupBy("file_hash").agg(
        F.max_by(
            F.struct("document_id", "source_path"), F.struct("created_at", "document_id")
        ).alias("_copy")
    )
    return uploads.join(newest, "file_hash", "left").select(
        *[c for c in uploads.columns],
        F.col("_copy.document_id").alias("existing_id"),
        F.col("_copy.source_path").alias("existing_path"),
    )


# --- audits ----------------------------------------------------------------

def id_differences(expected: DataFrame, actual: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids on one side only, each with its kind."""
    left, right = expected.select(key).distinct(), actual.select(key).distinct()
    return (
        left.join(right, key, "left_anti").withColumn("kind", F.lit("missing"))
        .unionByName(right.join(left, key, "left_anti").withColumn("kind", F.lit("unexpected")))
    )


def audit(expected: DataFrame, actual: DataFrame, key: str = "chunk_id", samples: int = 5) -> DataFrame:
    """One report row: counts of both sides, differences and the first few of each.

    The differences are one full outer join; ids are counted with partial sums
    and only ``samples`` ids per kind leave a task.
    """
    sides = (
        expected.select(key).groupBy(key).agg(F.count("*").alias("_e"))
        .join(actual.select(key).groupBy(key).agg(F.count("*").alias("_a")), key, "full_outer")
    )
    totals = sides.agg(
        F.coalesce(F.sum("_e"), F.lit(0)).alias("expected_count"),
        F.coalesce(F.sum("_a"), F.lit(0)).alias("actual_count"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("missing_count"),
        F.count(F.when(F.col("_e").isNull(), 1)).alias("unexpected_count"),
    )
    apart = sides.where("_a is null or _e is null").select(
        key, F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("kind")
    )
    first = ranking.top_k(apart, ["kind"], [F.asc(key)], samples)
    of_kind = lambda kind: F.array_sort(
        F.collect_list(F.when(F.col("kind") == kind, F.col(key)))
    )
    shown = first.agg(
        F.struct(of_kind("missing").alias("m"), of_kind("unexpected").alias("u"))
    ).scalar()
    return (
        totals.withColumn("_shown", shown)
        .select(
            "expected_count", "actual_count", "missing_count", "unexpected_count",
            F.col("_shown.m").alias("missing_sample"),
            F.col("_shown.u").alias("unexpected_sample"),
        )
        .withColumn(
            "consistent",
            (F.col("expected_count") == F.col("actual_count"))
            & (F.col("missing_count") == 0) & (F.col("unexpected_count") == 0),
        )
    )


def active_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of ready documents."""
    ready = documents.where(F.col("status") == "ready").select("document_id")
    return chunks.join(ready, "document_id", "left_semi")


def stale_vectors(vectors: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors of the given documents that no current chunk stands behind."""
    return vectors.join(documents.select("document_id"), "document_id", "left_semi").join(
        chunks.select("chunk_id"), "chunk_id", "left_anti"
    )


def generation_catalogue(vectors: DataFrame, state: DataFrame) -> DataFrame:
    """Name, row count and active flag of every generation."""
    active = state.select(F.col("active_generation").alias("generation")).withColumn(
        "is_active", F.lit(True)
    )
    return (
        vectors.groupBy("generation").agg(F.count("*").alias("count"))
        .join(active, "generation", "left")
        .withColumn("is_active", F.coalesce("is_active", F.lit(False)))
    )


def readiness(active_name: str | None, vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Consistency of the active generation with the active chunks, one row."""
    actual = vectors.where(F.col("generation") == F.lit(active_name))
    report = audit(chunks, actual)
    detail = (
        F.when(F.lit(active_name is None), "no active generation")
        .when(F.col("actual_count") == 0, "active generation not found")
        .when(F.col("actual_count") != F.col("expected_count"), "counts differ")
        .when(~F.col("consistent"), "ids differ")
    )
    return report.select(
        F.lit(active_name).alias("generation"),
        F.col("actual_count").alias("vector_count"),
        F.col("expected_count").alias("chunk_count"),
        "missing_sample",
        "unexpected_sample",
        F.when(detail.isNull(), "ok").otherwise("fail").alias("status"),
        detail.alias("detail"),
    )


# --- row-level changes -----------------------------------------------------

def mark_failures(
    documents: DataFrame, failures: DataFrame, old_chunks: DataFrame
) -> DataFrame:
    """Record failed attempts: documents with usable old rows stay ready."""
    had_rows = old_chunks.select("document_id").distinct().withColumn("_had", F.lit(True))
    failed = failures.select("document_id", F.col("error").alias("_error"))
    message = F.substring(
        F.concat(F.lit("Not indexed: "), F.col("_error")), 1, 1000
    )
    return (
        documents.join(failed, "document_id", "left").join(had_rows, "document_id", "left")
        .withColumn(
            "status",
            F.when(F.col("_error").isNull(), F.col("status"))
            .when(F.col("_had"), "ready").otherwise("failed"),
        )
        .withColumn(
            "error_message",
            F.when(F.col("_error").isNotNull(), message).otherwise(F.col("error_message")),
        )
        .drop("_error", "_had")
    )


def delete_documents(documents: DataFrame, rows: DataFrame, gone: DataFrame):
    """Rows of the deleted documents are dropped, the documents stay marked."""
    ids = gone.select("document_id").distinct()
    left = rows.join(ids, "document_id", "left_anti")
    flag = ids.withColumn("_gone", F.lit(True))
    marked = (
        documents.join(flag, "document_id", "left")
        .withColumns({
            "status": F.when(F.col("_gone"), "deleted").otherwise(F.col("status")),
            "chunk_count": F.when(F.col("_gone"), 0).otherwise(F.col("chunk_count")),
            "error_message": F.when(F.col("_gone"), F.lit(None)).otherwise(
                F.col("error_message")
            ),
        })
        .drop("_gone")
    )
    return marked, left


def run_counters(items: DataFrame) -> DataFrame:
    """Totals, status and the first 20 errors of each run.

    ``items`` has run_id, item_id, ok and error. Counting uses partial sums; only
    20 error rows per run leave a task.
    """
    totals = items.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
    )
    first = ranking.top_k(
        items.where(~F.col("ok")), ["run_id"], [F.asc("item_id")], 20
    ).groupBy("run_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "error"))), lambda e: e["error"]
        ).alias("errors")
    )
    return totals.join(first, "run_id", "left").select(
        "run_id", "total", F.col("total").alias("processed"), "succeeded", "failed",
        F.when(F.col("failed") == 0, "completed").otherwise("partial").alias("status"),
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
    )


# --- sync as tables --------------------------------------------------------

@dataclass
class Synced:
    """Tables after a sync, and the diff it was made from."""

    documents: DataFrame
    chunks: DataFrame
    changes: DataFrame
    failures: DataFrame
    fresh: DataFrame  # chunks of added and modified files
    replaced: DataFrame  # document_id whose earlier chunks are gone
    touched: DataFrame  # document_id whose document row is new or changed


def sync(
    files: DataFrame,
    stored: DataFrame,
    old_chunks: DataFrame,
    chunker,
    settings: Settings = DEFAULTS,
) -> Synced:
    """Bring documents and chunks in step with the files.

    ``files`` has document_id, source_path, file_hash, file_size and text. Only
    added and modified files are chunked. A file without readable text fails and
    keeps its old rows; all other rows of changed and deleted files are replaced.
    """
    changes = classify(files, stored, settings)
    changed = files.join(
        changes.where(F.col("change").isin("added", "modified"))
        .select("source_path", F.col("document_id").alias("_old_id")),
        "source_path",
    ).withColumn("document_id", F.coalesce("_old_id", "document_id")).drop("_old_id")
    readable = changed.where(~tx.is_blank(F.col("text")))
    failures = changed.where(tx.is_blank(F.col("text"))).select(
        "document_id", "source_path", "file_hash", "file_size",
        F.concat(F.lit("empty file "), F.col("source_path")).alias("error"),
    )
    fresh = chunker(readable)
    gone = changes.where("change = 'deleted'").select("document_id")
    replaced = readable.select("document_id").unionByName(gone).distinct()
    chunks = old_chunks.join(replaced, "document_id", "left_anti").unionByName(
        fresh.select(*old_chunks.columns)
    )
    counts = fresh.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    indexed = readable.join(counts, "document_id", "left").select(
        "document_id", "source_path", "file_hash", "file_size",
        F.lit("ready").alias("status"),
        F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"),
        F.lit(settings.index_schema_version).alias("index_schema_version"),
        F.lit(settings.embedding_provider).alias("embedding_provider"),
        F.lit(settings.embedding_model).alias("embedding_model"),
        F.lit(None).cast("string").alias("error_message"),
    )
    first_failures = failures.join(stored, "source_path", "left_anti").select(
        "document_id", "source_path", "file_hash", "file_size",
        F.lit("failed").alias("status"), F.lit(0).cast("long").alias("chunk_count"),
        F.lit(settings.index_schema_version).alias("index_schema_version"),
        F.lit(settings.embedding_provider).alias("embedding_provider"),
        F.lit(settings.embedding_model).alias("embedding_model"),
        F.substring(
            F.concat(F.lit("Not indexed: "), F.col("error")), 1, 1000
        ).alias("error_message"),
    )
    kept = stored.join(indexed, "document_id", "left_anti")
    kept = mark_failures(kept, failures, old_chunks)
    kept, _ = delete_documents(kept, old_chunks, gone)
    documents = (
        kept.select(*indexed.columns).unionByName(indexed).unionByName(first_failures)
    )
    touched = replaced.unionByName(failures.select("document_id")).distinct()
    return Synced(documents, chunks, changes, failures, fresh, replaced, touched)


def sync_report(synced: Synced) -> DataFrame:
    """Counts and status of a sync, one row."""
    kinds = synced.changes.agg(*[
        F.count_if(F.col("change") == kind).alias(kind)
        for kind in ("added", "modified", "deleted", "unchanged")
    ])
    failed = synced.failures.agg(F.count("*")).scalar()
    return kinds.withColumn("failed", failed).select(
        F.when(F.col("failed") == 0, "completed").otherwise("partial").alias("status"),
        (F.col("added") + F.col("modified") - F.col("failed")).alias("indexed"),
        "failed", "deleted", "unchanged",
    )
