"""Queries on corpus maintenance and streaming ingest."""

import time

from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS
from corpuslake.functions import text as tx
from corpuslake.operators import bm25, chunking, maintain, vector
from corpuslake.plans.registry import query
from corpuslake.schemas import KNOWLEDGE_CHUNKS, KNOWLEDGE_DOCUMENTS
from corpuslake.session import shared_dir
from corpuslake.sources.store import Store
from corpuslake.streaming.ingest import StreamTables, ingest


def old_chunks(k):
    """One chunk per stored document, as left by the earlier run."""
    return k.stored().select(
        F.concat(F.lit("old"), "document_id").alias("chunk_id"), "document_id", "file_hash",
        F.lit(0).cast("long").alias("chunk_index"), F.lit("old text").alias("content"),
        F.lit("old").alias("content_hash"), F.lit(4).cast("long").alias("token_count"), "source_path",
    )


def synced(k):
    return maintain.sync(
        k.documents(), k.stored().select(*KNOWLEDGE_DOCUMENTS.names), old_chunks(k), chunking.line_chunks
    )


@query("m1_snapshot_diff", "SELECT source_path, change, document_id, file_hash FROM kdiff")
def m1(k):
    return maintain.classify(k.documents(), k.stored())


@query("m2_sync_chunks", """
SELECT chunk_id, document_id, chunk_index FROM kchunks WHERE document_id IN (
  SELECT d.document_id FROM kdocs d JOIN kdiff x USING (source_path) WHERE change IN ('added', 'modified'))
UNION ALL SELECT 'old' || document_id, document_id, 0 FROM kstored WHERE document_id NOT IN (
  SELECT d.document_id FROM kdocs d JOIN kdiff x USING (source_path) WHERE change IN ('added', 'modified'))
  AND source_path NOT IN (SELECT source_path FROM kdiff WHERE change = 'deleted')""")
def m2(k):
    return synced(k).chunks.select("chunk_id", "document_id", "chunk_index")


@query("m2_sync_documents", """
SELECT coalesce(s.document_id, d.document_id) AS document_id, coalesce(d.source_path, s.source_path) AS source_path,
       CASE WHEN d.source_path IS NULL THEN 'deleted' ELSE 'ready' END AS status,
       coalesce(d.file_hash, s.file_hash) AS file_hash
FROM kdocs d FULL OUTER JOIN kstored s USING (source_path)""")
def m2b(k):
    return synced(k).documents.select("document_id", "source_path", "status", "file_hash")


@query("m2_sync_report", """
SELECT 'completed' AS status, count(*) FILTER (WHERE change IN ('added', 'modified')) AS indexed, 0 AS failed,
       count(*) FILTER (WHERE change = 'deleted') AS deleted, count(*) FILTER (WHERE change = 'unchanged') AS unchanged
FROM kdiff""")
def m2c(k):
    return maintain.sync_report(synced(k))


def _store(k):
    return Store(k.spark, shared_dir(k.spark, "store"))


def _store_files(k, docs):
    return docs.select("document_id", "source_path", "file_hash", "file_size", "text")


def _embed(chunks):
    return vector.hashed_embedding(chunks.select("chunk_id", "document_id", "content"), "content")


def _two_syncs(k):
    target = _store(k)
    first = k.documents().withColumn(
        "text", F.when(F.col("lang") == "de", F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    ).withColumn("file_hash", F.sha2("text", 256))
    target.sync("g1", _store_files(k, first), chunking.line_chunks, _embed)
    target.sync("g2", _store_files(k, k.documents()), chunking.line_chunks, _embed)
    return target


@query("m3_replace_documents", "SELECT chunk_id, document_id, chunk_index FROM kchunks")
def m3(k):
    """Two syncs over the store; the second replaces the changed documents."""
    return _two_syncs(k).read("chunks", "g2").select("chunk_id", "document_id", "chunk_index")


@query("m3_delta_rows", """
SELECT chunk_id, document_id FROM kchunks JOIN kdocs USING (document_id) WHERE lang = 'de'""")
def m3b(k):
    """What the second sync wrote: rows of changed documents only."""
    return _two_syncs(k)._stored("vectors").where("generation = 'g2'").select("chunk_id", "document_id")


@query("m2_dry_run", """
SELECT count(*) FILTER (WHERE lang <> 'es') AS modified, count(*) FILTER (WHERE lang = 'es') AS added,
       (SELECT count(*) FROM kdocs JOIN kchunks USING (document_id) WHERE lang <> 'es') AS n_chunks FROM kdocs""")
def m2b(k):
    """What a sync would do, and that it did nothing."""
    target, docs = _store(k), k.documents()
    older = docs.where("lang <> 'es'").withColumn("file_hash", F.concat(F.lit("old"), "file_hash"))
    target.sync("g1", _store_files(k, older), chunking.line_chunks, _embed)
    told = target.sync("g2", _store_files(k, docs), chunking.line_chunks, _embed, dry_run=True)
    added = docs.where("lang = 'es'").count()
    return target.read("chunks", target.active()).agg(F.count("*").alias("n_chunks")).select(
        F.lit(told["indexed"] - added).alias("modified"), F.lit(added).alias("added"), "n_chunks")


@query("m4_publish", """
SELECT chunk_id, document_id FROM kchunks""")
def m4(k):
    target = _store(k)
    target.sync("g1", _store_files(k, k.documents()), chunking.line_chunks, _embed)
    return target.read("vectors", target.active()).select("chunk_id", "document_id")


@query("m5_mark_failures", """
SELECT d.document_id, CASE WHEN lang <> 'fr' THEN d.status WHEN s.document_id IS NOT NULL THEN 'ready' ELSE 'failed' END AS status,
       CASE WHEN lang = 'fr' THEN substr('Not indexed: ' || text, 1, 1000) END AS error_message
FROM kdocs d LEFT JOIN kstored s USING (document_id)""")
def m5(k):
    docs = k.documents().withColumn("error_message", F.lit(None).cast("string"))
    failed = k.documents().where("lang = 'fr'").select("document_id", F.col("text").alias("error"))
    return maintain.mark_failures(docs, failed, old_chunks(k)).select("document_id", "status", "error_message")


@query("m6_delete_documents", """
SELECT document_id, CASE WHEN lang = 'es' THEN 'deleted' ELSE status END AS status,
       CASE WHEN lang = 'es' THEN 0 ELSE 1 END AS chunk_count FROM kdocs""")
def m6(k):
    docs = k.documents().withColumns({
        "chunk_count": F.lit(1).cast("long"), "error_message": F.lit(None).cast("string")
    })
    marked, _ = maintain.delete_documents(docs, k.chunks(), docs.where("lang = 'es'"))
    return marked.select("document_id", "status", "chunk_count")


@query("m6_rows_after_delete", """
SELECT chunk_id FROM kchunks WHERE document_id IN (SELECT document_id FROM kdocs WHERE lang <> 'es')""")
def m6b(k):
    docs = k.documents().withColumns({
        "chunk_count": F.lit(1).cast("long"), "error_message": F.lit(None).cast("string")
    })
    _, left = maintain.delete_documents(docs, k.chunks(), docs.where("lang = 'es'"))
    return left.select("chunk_id")


AUDIT = """
SELECT (SELECT count(*) FROM kactive) AS expected_count, count(*) AS actual_count,
       (SELECT count(*) FROM kactive WHERE chunk_id NOT IN (SELECT chunk_id FROM kgens WHERE generation = '{g}')) AS missing_count,
       (SELECT count(*) FROM kgens WHERE generation = '{g}' AND chunk_id NOT IN (SELECT chunk_id FROM kactive)) AS unexpected_count,
       coalesce((SELECT string_agg(chunk_id, ',' ORDER BY chunk_id) FROM (SELECT chunk_id FROM kactive
          WHERE chunk_id NOT IN (SELECT chunk_id FROM kgens WHERE generation = '{g}') ORDER BY 1 LIMIT 5)), '') AS missing_sample,
       coalesce((SELECT string_agg(chunk_id, ',' ORDER BY chunk_id) FROM (SELECT chunk_id FROM kgens WHERE generation = '{g}'
          AND chunk_id NOT IN (SELECT chunk_id FROM kactive) ORDER BY 1 LIMIT 5)), '') AS unexpected_sample,
       {ok} AS consistent
FROM kgens WHERE generation = '{g}'"""


def _audit(k, name):
    actual = k.generations().where(F.col("generation") == name)
    return maintain.audit(k.active_chunks(), actual).withColumns({
        "missing_sample": F.array_join("missing_sample", ","),
        "unexpected_sample": F.array_join("unexpected_sample", ","),
    })


@query("m4_audit_equal", AUDIT.format(g="g2", ok="true"))
def m4b(k):
    return _audit(k, "g2")


@query("m7_rollback_gate", AUDIT.format(g="g1", ok="false"))
def m7(k):
    return _audit(k, "g1")


@query("m7_rollback_accepted", """
SELECT g AS generation, (SELECT count(*) FROM kchunks) AS count, g = 'g1' AS is_active FROM (VALUES ('g1'), ('g2')) t(g)""")
def m7c(k):
    """Nothing changed between two generations, so that the older one may be active again."""
    target = _store(k)
    for name in ("g1", "g2"):
        target.sync(name, _store_files(k, k.documents()), chunking.line_chunks, _embed)
    target.rollback("g1")
    return target.catalogue()


@query("m7_rollback", """
SELECT 'g1' AS generation, (SELECT count(*) FROM kchunks JOIN kdocs USING (document_id) WHERE lang <> 'es') AS count,
       false AS is_active, 'error' AS rollback
UNION ALL SELECT 'g2', (SELECT count(*) FROM kchunks), true, 'error'""")
def m7b(k):
    """A rollback to a generation with other ids is refused and changes nothing."""
    target = _store(k)
    target.sync("g1", _store_files(k, k.documents().where("lang <> 'es'")), chunking.line_chunks, _embed)
    target.sync("g2", _store_files(k, k.documents()), chunking.line_chunks, _embed)
    refused = target.rollback("g1")
    return target.catalogue().withColumn("rollback", F.lit(refused["status"]))


@query("m8_cleanup_generation", """
SELECT 'g2' AS generation, (SELECT count(*) FROM kchunks) AS count, true AS is_active, 'error' AS active_cleanup,
       'completed' AS old_cleanup""")
def m8(k):
    target = _store(k)
    target.sync("g1", _store_files(k, k.documents().where("lang <> 'es'")), chunking.line_chunks, _embed)
    target.sync("g2", _store_files(k, k.documents()), chunking.line_chunks, _embed)
    kept, gone = target.cleanup("g2")["status"], target.cleanup("g1")["status"]
    return target.catalogue().withColumns({"active_cleanup": F.lit(kept), "old_cleanup": F.lit(gone)})


@query("m9_readiness", """
SELECT 'g1' AS generation, (SELECT count(*) FROM kgens WHERE generation = 'g1') AS vector_count,
       (SELECT count(*) FROM kactive) AS chunk_count, 'fail' AS status, 'counts differ' AS detail
UNION ALL SELECT 'g2', (SELECT count(*) FROM kactive), (SELECT count(*) FROM kactive), 'ok', NULL""")
def m9(k):
    report = lambda name: maintain.readiness(name, k.generations(), k.active_chunks()).select(
        "generation", "vector_count", "chunk_count", "status", "detail"
    )
    return report("g1").unionByName(report("g2"))


@query("m10_signature_staleness", """
WITH n AS (SELECT count(*) FILTER (WHERE lang <> 'es') AS old, count(*) AS new,
                  (SELECT count(*) FROM kdocs WHERE status = 'ready' AND lang = 'es') > 0 AS changed FROM kactive)
SELECT 'built' AS step, false AS stale, old AS n_chunks FROM n
UNION ALL SELECT 'documents changed', changed, old FROM n
UNION ALL SELECT 'published again', false, new FROM n""")
def m10(k):
    """A stored index before and after documents change, and after it was published again."""
    spark, path = k.spark, shared_dir(k.spark, "m10")
    ready = k.documents().where("status = 'ready'")
    signed = lambda docs: maintain.corpus_fingerprint(docs).first()["fingerprint"]
    size = lambda index: index.stats.first()["n_chunks"]
    old, new = signed(ready.where("lang <> 'es'")), signed(ready)
    index = bm25.stored_index(chunking.line_chunks(ready.where("lang <> 'es'")), path, old)
    steps = [("built", bm25.open_index(spark, path, old) is None, size(index)),
             ("documents changed", bm25.open_index(spark, path, new) is None, size(index))]
    index = bm25.stored_index(k.active_chunks(), path, new)
    steps.append(("published again", bm25.open_index(spark, path, new) is None, size(index)))
    return spark.createDataFrame(steps, "step string, stale boolean, n_chunks long")


@query("m11_persisted_count", """
SELECT (SELECT count(*) FROM kactive) AS persisted, (SELECT count(*) FROM kchunks) AS staged,
       (SELECT count(*) FROM kactive) = (SELECT count(*) FROM kchunks) AS equal""")
def m11(k):
    staged = k.chunks()
    persisted = maintain.active_chunks(staged, k.documents())
    row = persisted.agg(F.count("*").alias("persisted")).withColumn(
        "staged", staged.agg(F.count("*")).scalar()
    )
    return row.withColumn("equal", F.col("persisted") == F.col("staged"))


# --- streaming -------------------------------------------------------------

ARRIVAL = "doc_id bigint, text string, lang string, source string"


def as_files(rows):
    return rows.select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"),
        F.sha2("text", 256).alias("file_hash"),
        F.octet_length("text").cast("long").alias("file_size"),
        "text",
    )


def streamed(k, runs: int = 1):
    """All documents as arriving files, in three micro-batches: by doc_id modulo three."""
    landing = shared_dir(k.spark, "landing")
    docs = k.table("documents").select("doc_id", "text", "lang", "source")
    for part in range(3):
        docs.where(F.col("doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)  # arrivals are taken by their file times
    tables = StreamTables(k.spark, shared_dir(k.spark, "stream"))
    for _ in range(runs):
        arrivals = k.spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(landing)
        ingest(arrivals, as_files, tables, shared_dir(k.spark, "progress"))
    return tables


# Of equal texts, the first batch stays, and in it the smallest path.
ARRIVED = """
WITH a AS (
  SELECT *, 'docs/' || doc_id || '.txt' AS source_path, doc_id % 3 AS batch FROM documents),
kept AS (
  SELECT *, sha256(source_path) AS document_id, sha256(text) AS file_hash FROM a
  QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY batch, source_path) = 1),
pieces AS (
  SELECT document_id, file_hash, batch, content, row_number() OVER (PARTITION BY document_id ORDER BY min(pos)) - 1 AS chunk_index
  FROM (SELECT document_id, file_hash, batch, unnest(generate_series(1, len(l))) AS pos, trim(unnest(l)) AS content
        FROM (SELECT *, string_split(text, chr(10)) AS l FROM kept))
  WHERE content <> '' GROUP BY document_id, file_hash, batch, content)
"""


@query("n1_incremental_ingest", ARRIVED + """
SELECT k.document_id, k.source_path, CASE WHEN trim(k.text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'failed' ELSE 'ready' END AS status,
       coalesce(c.n, 0) AS chunk_count, k.batch AS chunk_batch
FROM kept k LEFT JOIN (SELECT document_id, count(*) AS n FROM pieces GROUP BY 1) c USING (document_id)""")
def n1(k):
    return streamed(k).documents().select("document_id", "source_path", "status", "chunk_count", "chunk_batch")


@query("n2_replay_is_idempotent", ARRIVED + """
SELECT sha256(document_id || ':' || file_hash || ':2:' || chunk_index) AS chunk_id, document_id, chunk_index, batch AS batch_id
FROM pieces""")
def n2(k):
    """The same arrivals twice, without the memory of the first run."""
    return streamed(k, runs=2).chunks().select("chunk_id", "document_id", "chunk_index", "batch_id")


@query("n3_duplicate_arrivals", """
SELECT count(*) AS dropped FROM documents
WHERE doc_id NOT IN (SELECT arg_min(doc_id, doc_id) FROM documents GROUP BY sha256(text))""")
def n3(k):
    return streamed(k).duplicates().agg(F.count("*").alias("dropped"))


@query("n4_retry_failed", """
WITH a AS (SELECT *, 'docs/' || doc_id || '.txt' AS source_path FROM documents),
kept AS (
  SELECT *, sha256(source_path) AS document_id FROM a
  QUALIFY lang = 'es' OR row_number() OVER (PARTITION BY sha256(text) ORDER BY source_path) = 1),
p AS (SELECT document_id, count(DISTINCT trim(content)) AS n FROM (
  SELECT document_id, unnest(string_split(text, chr(10))) AS content FROM kept) WHERE trim(content) <> '' GROUP BY 1)
SELECT document_id, source_path, 'ready' AS status, coalesce(n, 0) AS chunk_count, NULL::VARCHAR AS error_message
FROM kept LEFT JOIN p USING (document_id)""")
def n4(k):
    """Documents arrive with blank texts first and fail, then whole, and are taken."""
    tables = StreamTables(k.spark, shared_dir(k.spark, "stream"))
    whole = k.table("documents")
    docs, early = as_files(whole), as_files(whole.where("lang = 'es'"))
    blanked = early.withColumn("text", F.lit(" ")).withColumn("file_hash", F.sha2(F.concat("source_path", F.lit("blank")), 256))
    tables.apply(blanked, 0)
    tables.apply(docs, 1)
    return tables.documents().select("document_id", "source_path", "status", "chunk_count", "error_message")
