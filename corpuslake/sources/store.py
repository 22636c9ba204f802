"""Generations on a shared file system: write, audit, publish, roll back, clean."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS, Settings
from corpuslake.operators import maintain
from corpuslake.operators.graph_build import Graph, clean_orphans, drop_documents
from corpuslake.schemas import (
    CHUNK_VECTORS,
    INDEX_STATE,
    KNOWLEDGE_CHUNKS,
    KNOWLEDGE_DOCUMENTS,
    row,
)
from corpuslake.session import path_exists


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


MANIFEST = row(generation="string", parent="string", stored_as="string", seq="bigint")
REMOVED = row(document_id="string", scope="string", generation="string")


@dataclass
class Store:
    """Tables ``documents``, ``chunks`` and ``vectors`` by generation, and an append-only pointer table
    ``state``; the newest pointer row names the active generation.

    A generation holds only what changed since its parent: new rows, and in ``removed`` the documents whose
    earlier rows are gone (scope ``rows``: chunks and vectors, ``documents``: the document row). Reading
    merges the chain from the oldest to the newest. ``manifest`` names the parent of a generation
    and the partition it is stored as; its newest row counts, so that a generation is rewritten as a whole
    (``compact``) without a moment at which it is incomplete. A crash before the pointer is written
    leaves an unused partition and the old generation active."""

    spark: SparkSession
    root: str
    settings: Settings = DEFAULTS
    longest_chain: int = 8

    TABLES = {
        "documents": KNOWLEDGE_DOCUMENTS,
        "chunks": KNOWLEDGE_CHUNKS,
        "vectors": CHUNK_VECTORS,
        "removed": REMOVED,
    }

    def _stored(self, table: str) -> DataFrame:
        """All rows of a table as they are stored; ``generation`` is the partition."""
        schema = self.TABLES[table]
        if "generation" not in schema.names:
            schema = type(schema)(list(schema.fields)).add("generation", "string")
        path = f"{self.root}/{table}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def write(self, table: str, rows: DataFrame, stored_as: str) -> None:
        """Replace one partition of a table; others stay.

        The commit protocol makes a partial write invisible, and writing the
        same rows again gives the same partition.
        """
        columns = [name for name in self.TABLES[table].names if name != "generation"]
        (
            rows.select(*columns).withColumn("generation", F.lit(stored_as))
            .write.partitionBy("generation").mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{table}")
        )

    # --- manifest ----------------------------------------------------------

    def manifest(self) -> dict[str, tuple[str | None, str]]:
        """Parent and partition of every generation (a few rows)."""
        path = f"{self.root}/manifest"
        if not path_exists(self.spark, path):
            return {}
        known: dict = {}
        for r in self.spark.read.schema(MANIFEST).parquet(path).orderBy("seq").collect():
            known.pop(r["generation"], None)
            if r["stored_as"] is not None:
                known[r["generation"]] = (r["parent"], r["stored_as"])
        return known

    def register(self, generation: str, parent: str | None, stored_as: str | None) -> None:
        path = f"{self.root}/manifest"
        last = self.spark.read.schema(MANIFEST).parquet(path).agg(F.max("seq")).first()[0] if path_exists(self.spark, path) else 0
        self.spark.createDataFrame([(generation, parent, stored_as, last + 1)], MANIFEST).coalesce(1).write.mode(
            "append").parquet(path)

    def chain(self, generation: str) -> list[str]:
        """Partitions that make up a generation, the newest first."""
        known, names = self.manifest(), []
        while generation is not None and generation in known:
            generation, stored_as = known[generation]
            names.append(stored_as)
        return names

    def read(self, table: str, generation: str) -> DataFrame:
        """Rows of one generation, merged from its chain (partition-pruned)."""
        names = self.chain(generation)
        rows = self._stored(table).where(F.col("generation").isin(names) if names else F.lit(False))
        if len(names) > 1:
            age = F.array_position(F.lit(names), F.col("generation"))
            scope = "documents" if table == "documents" else "rows"
            gone = self._stored("removed").where(F.col("generation").isin(names) & (F.col("scope") == scope))
            gone = gone.groupBy("document_id").agg(F.min(age).alias("_gone"))
            rows = rows.withColumn("_age", age).join(gone, "document_id", "left").where(
                "_gone is null or _age <= _gone").drop("_age", "_gone")
        return rows.withColumn("generation", F.lit(generation)).select(*self._stored(table).columns)

    def compact(self, generation: str) -> None:
        """Store a generation whole: it no longer needs its parents."""
        if len(self.chain(generation)) < 2:
            return
        stored_as = f"{generation}~{uuid.uuid4().hex[:8]}"
        for table in ("documents", "chunks", "vectors"):
            self.write(table, self.read(table, generation), stored_as)
        self.register(generation, None, stored_as)

    # --- pointer -----------------------------------------------------------

    def state(self) -> DataFrame:
        path = f"{self.root}/state"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], INDEX_STATE)
        return self.spark.read.schema(INDEX_STATE).parquet(path)

    def pointer(self):
        """Newest pointer row, or None."""
        return self.state().orderBy(F.desc("seq")).limit(1).first()

    def active(self) -> str | None:
        row = self.pointer()
        return row["active_generation"] if row else None

    def signature(self) -> str:
        """Changes whenever the index changes; compare it before reusing tables."""
        row = self.pointer()
        if row is None:
            return ""
        return "|".join(str(row[name] or "") for name in INDEX_STATE.names[1:])

    def activate(self, generation: str, corpus_fp: str = "") -> None:
        last = self.pointer()
        self.spark.range(1).select(
            F.lit((last["seq"] if last else 0) + 1).cast("long").alias("seq"),
            F.lit(generation).alias("active_generation"),
            F.lit(self.settings.index_schema_version).alias("index_schema_version"),
            F.lit(self.settings.embedding_fingerprint).alias("embedding_fingerprint"),
            F.lit(corpus_fp).alias("corpus_fingerprint"),
            F.current_timestamp().alias("updated_at"),
        ).coalesce(1).write.mode("append").parquet(f"{self.root}/state")

    # --- write, audit, publish ---------------------------------------------

    def publish(
        self,
        generation: str,
        documents: DataFrame,
        chunks: DataFrame,
        vectors: DataFrame,
        failures: DataFrame | None = None,
    ) -> dict:
        """Build a generation, audit it by reading it back, then switch to it.

        Any failed document or audit difference leaves the old generation active
        and removes the build.
        """
        if generation == self.active():
            raise ValueError(f"refusing to overwrite the active generation {generation}")
        if failures is not None:
            lost = failures.count()
            if lost:
                first = failures.orderBy("document_id").select("error").limit(20).collect()
                return {"status": "failed", "generation": generation,
                        "documents_failed": lost, "errors": [r["error"] for r in first]}
        self.write("documents", documents, generation)
        self.write("chunks", chunks, generation)
        self.write("vectors", vectors, generation)
        self.register(generation, None, generation)
        return self._audited(generation)

    def _audited(self, generation: str) -> dict:
        """Switch to a generation if its vectors equal its chunks; else remove it."""
        stored = self.read("chunks", generation)
        ready = maintain.active_chunks(stored, self.read("documents", generation))
        report = maintain.audit(ready, self.read("vectors", generation)).first()
        staged = stored.count()
        if not report["consistent"] or staged != report["expected_count"] or not staged:
            self.discard(generation)
            return {"status": "validation_failed", "generation": generation,
                    **report.asDict()}
        old = self.active()
        fingerprint = maintain.corpus_fingerprint(
            self.read("documents", generation).where("status <> 'deleted'")
        ).first()["fingerprint"]
        self.activate(generation, fingerprint)
        return {"status": "completed", "generation": generation, "old_generation": old,
                "total_chunks": staged}

    def sync(
        self, generation: str, files: DataFrame, chunker, embedder, dry_run: bool = False, graph: Graph | None = None,
    ) -> dict:
        """Incremental sync: only changed files are chunked and embedded, once, and only their rows are
        written. A dry run tells what would change and writes nothing. With a graph, the answer also holds it
        without what came from replaced documents (``graph``)."""
        active = self.active()
        if generation == active:
            raise ValueError(f"refusing to overwrite the active generation {generation}")
        if active is not None and not dry_run and len(self.chain(active)) >= self.longest_chain:
            self.compact(active)
        stored = self.read("documents", active).drop("generation")
        old_chunks = self.read("chunks", active).drop("generation")

        def staged(readable: DataFrame) -> DataFrame:
            if dry_run:
                return old_chunks.limit(0)
            self.write("chunks", chunker(readable), generation)
            return self._stored("chunks").where(F.col("generation") == generation).drop("generation")

        done = maintain.sync(files, stored, old_chunks, staged, self.settings)
        report = maintain.sync_report(done).first().asDict()
        if dry_run:
            return {**report, "sync_status": "dry_run"}
        if active is None and report["failed"]:
            _delete(self.spark, f"{self.root}/chunks/generation={generation}")
            return self.publish(generation, done.documents, done.chunks, old_chunks, done.failures)
        scoped = lambda ids, scope: ids.select("document_id", F.lit(scope).alias("scope"))
        self.write("removed", scoped(done.replaced, "rows").unionByName(scoped(done.touched, "documents")), generation)
        self.write("documents", done.documents.join(done.touched, "document_id", "left_semi"), generation)
        self.write("vectors", embedder(done.fresh), generation)
        self.register(generation, active, generation)
        outcome = self._audited(generation)
        if graph is not None:
            outcome["graph"] = clean_orphans(drop_documents(graph, self._stored("removed").where(
                (F.col("generation") == generation) & (F.col("scope") == "rows"))))
        return {**report, **outcome, "sync_status": "partial" if report["failed"] else "completed"}

    # --- rollback and clean-up ---------------------------------------------

    def catalogue(self) -> DataFrame:
        pointer = self.state().orderBy(F.desc("seq")).limit(1)
        vectors = self._stored("vectors").limit(0)
        for generation in self.manifest():
            vectors = vectors.unionByName(self.read("vectors", generation))
        return maintain.generation_catalogue(vectors, pointer)

    def readiness(self) -> DataFrame:
        active = self.active()
        chunks = maintain.active_chunks(
            self.read("chunks", active), self.read("documents", active)
        )
        return maintain.readiness(active, self.read("vectors", active), chunks)

    def rollback(self, generation: str) -> dict:
        """Point back to a generation only if its ids equal the current chunks."""
        target = self.read("vectors", generation)
        if target.isEmpty():
            return {"status": "error", "message": f"generation {generation} not found"}
        active = self.active()
        current = maintain.active_chunks(
            self.read("chunks", active), self.read("documents", active)
        )
        report = maintain.audit(current, target).first()
        if report["missing_count"] or report["unexpected_count"]:
            return {"status": "error", "message": "ids differ from the current chunks",
                    "vector_count": report["actual_count"],
                    "chunk_count": report["expected_count"]}
        # The chunks are the same, and so is the corpus they came from.
        self.activate(generation, self.pointer()["corpus_fingerprint"])
        return {"status": "completed", "active_generation": generation,
                "vector_count": report["actual_count"]}

    def cleanup(self, generation: str) -> dict:
        if generation == self.active():
            return {"status": "error", "message": "cannot delete the active generation"}
        self.discard(generation)
        return {"status": "completed", "deleted_generation": generation}

    def discard(self, generation: str) -> None:
        """Remove a generation; those that build on it are stored whole first."""
        known = self.manifest()
        if generation == self.active() or generation not in known:
            return
        for child, (parent, _) in known.items():
            if parent == generation:
                self.compact(child)
        self.register(generation, None, None)
        for table in self.TABLES:
            _delete(self.spark, f"{self.root}/{table}/generation={known[generation][1]}")
