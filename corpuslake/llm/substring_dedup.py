"""Substring dedup with difference-cover anchors.

Only windows that start at cover positions (modulo a period) are hashed. Whatever the offset of two
equal passages, the cover has a position where both are anchored, so that a long match shares an
anchor. Where an anchor occurs in two documents, the whole windows around it are compared; of a
window that also starts in a document with a smaller id, all words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.words import Block, Hasher, blocks
from corpuslake.llm.workspace import Workspace

WINDOW = 50
# Every difference modulo 31 is one of two members of this set.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_COVERED = np.isin(np.arange(PERIOD), COVER)


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def words_of(block: Block, d: int) -> list[bytes]:
    return block.data[block.bounds[d] : block.bounds[d + 1]].tobytes().split(None)


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def wholes(block: Block, words: np.ndarray) -> np.ndarray:
    """Hash of all the words of each document."""
    return Hasher(32).spans(words, block.first[:-1], block.first[1:]).astype(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, whole, and the digest of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Hasher(31)
        for batch in batches:
            for block in blocks(batch["text"]):
                n = len(block.n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(block.rows.start, n), long(block.n_words),
                     long(wholes(block, block.hashes(one))),
                     pa.array([digest(words_of(block, d)) for d in range(n)], pa.string())],
                    ["doc_id", "n_words", "whole", "sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, whole long, sha256 string")


def anchors(docs: DataFrame) -> DataFrame:
    """anchor, whole, pos: hashed windows at cover positions, and where they lie. Documents of
    equal words report the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Hasher(31), Hasher(33)
        for batch in batches:
            for block in blocks(batch["text"]):
                words = block.hashes(one)
                start = block.windows(ANCHOR)
                doc = block.doc[start]
                at = start - block.first[doc]
                keep = _COVERED[at % PERIOD] & (block.n_words[doc] >= WINDOW)
                start, doc, at = start[keep], doc[keep], at[keep]
                yield pa.RecordBatch.from_arrays(
                    [long(two.spans(words, start, start + ANCHOR)), long(wholes(block, words)[doc]),
                     pa.array(at.astype(np.int32))], ["anchor", "whole", "pos"])

    return docs.where("doc_id is not null").select("text").mapInArrow(
        run, "anchor long, whole long, pos int")


def windows(docs: DataFrame) -> DataFrame:
    """high, low (hash of a window), doc_id, whole, pos, for all windows that hold an anchor at one of the
    places ``at``. ``whole`` says which text of a doc_id the places belong to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other, two, three = Hasher(31), Hasher(34), Hasher(35), Hasher(36)
        for batch in batches:
            for block in blocks(batch["text"]):
                n = len(block.n_words)
                words = block.hashes(one)
                places = batch["at"].slice(block.rows.start, n)
                counts = places.value_lengths().to_numpy()
                whole = wholes(block, words)
                own = batch["whole"].slice(block.rows.start, n).to_numpy() == whole
                marks = np.zeros(len(block.start) + 1, np.int64)
                flat = places.flatten().to_numpy() + np.repeat(block.first[:-1], counts)
                marks[flat[np.repeat(own, counts)]] = 1
                held = np.append(0, np.cumsum(marks))
                start = block.windows(WINDOW)
                start = start[held[start + PERIOD] > held[start]]
                doc = block.doc[start]
                yield pa.RecordBatch.from_arrays(
                    [long(two.spans(words, start, start + WINDOW)),
                     long(three.spans(block.hashes(other), start, start + WINDOW)),
                     batch["doc_id"].slice(block.rows.start, n).take(pa.array(doc)), long(whole[doc]),
                     pa.array((start - block.first[doc]).astype(np.int32))],
                    ["high", "low", "doc_id", "whole", "pos"])

    return docs.select("doc_id", "whole", "at", "text").mapInArrow(
        run, f"high long, low long, doc_id {dict(docs.dtypes)['doc_id']}, whole long, pos int")


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, whole, n_removed, kept: the words that no window at one of the places covers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Hasher(31)
        for batch in batches:
            removed, texts, own = [], [], []
            for block in blocks(batch["text"]):
                n = len(block.n_words)
                own.append(batch["whole"].slice(block.rows.start, n).to_numpy()
                           == wholes(block, block.hashes(one)))
                places = batch["at"].slice(block.rows.start, n).to_pylist()
                for d, at in enumerate(places):
                    words = words_of(block, d)
                    gone = np.zeros(len(words), bool)
                    for p in at:
                        gone[p : p + WINDOW] = True
                    removed.append(int(gone.sum()))
                    texts.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["whole"], pa.array(removed, pa.int64()), pa.array(texts, pa.binary())],
                ["doc_id", "whole", "n_removed", "kept"]).filter(pa.array(np.concatenate(own or [[]]).astype(bool)))

    return docs.select("doc_id", "whole", "at", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, whole long, n_removed long, kept binary")


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Documents that have places; the places are hashed, and the texts stream past them."""
    return docs.join(places.hint("shuffle_hash"), "doc_id")


def dedup(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (null where nothing is removed).

    A null text has no words. Documents under 50 words and rows without doc_id lose nothing, and the
    latter take nothing from others. Rows that repeat a doc_id are judged one by one; equal ids are
    never smaller than one another. Other columns are dropped.
    """
    work = work or Workspace(docs.sparkSession, "substrings")
    docs = docs.select("doc_id", "text")
    rows = work.keep(describe(docs), "rows")
    long_rows = rows.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    leads = work.keep(long_rows.groupBy("sha256").agg(
        F.min("doc_id").alias("lead"), F.first("whole").alias("whole")), "leads")

    # Of a written table one shuffle serves both sides; a hot anchor is only counted and compared, never gathered.
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n = max(int(n), (rows.agg(F.sum("n_words")).first()[0] or 0) // 5_000_000)
    found = work.keep(anchors(docs), "anchors").where("anchor is not null").repartition(n, "anchor")
    shared = found.groupBy("anchor").agg(
        F.min("whole").alias("low"), F.max("whole").alias("high"), F.max("pos").alias("last"),
    ).where("low <> high and last >= 0").select("anchor")
    shared = found.join(shared.hint("shuffle_hash"), "anchor").groupBy("whole").agg(
        F.collect_set("pos").alias("at"))
    shared = shared.join(leads, "whole").select(F.col("lead").alias("doc_id"), "whole", "at")
    shared = work.keep(shared, "shared")
    del found
    work.drop("anchors")

    found = work.keep(windows(with_places(docs, shared)), "windows")
    work.drop("shared")
    found = found.where("high is not null and low is not null and doc_id is not null").repartition(n, "high")
    least = found.groupBy("high", "low").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
        F.max("pos").alias("last"), F.max("whole").alias("any"),
    ).where("least < most and last >= 0 and any is not null").select("high", "low", "least")
    taken = found.join(least.hint("shuffle_hash"), ["high", "low"]).where("least < doc_id")
    taken = work.keep(taken.groupBy("doc_id", "whole").agg(F.collect_set("pos").alias("at")), "taken")
    del found
    work.drop("windows")

    less = work.keep(cut(with_places(docs, taken)), "less")
    work.drop("taken")
    rest = rows.join(leads.select("sha256", "lead"), "sha256", "left")
    rest = rest.join(less, ["doc_id", "whole"], "left")
    copy = F.coalesce((F.col("n_words") >= WINDOW) & (F.col("lead") < F.col("doc_id")), F.lit(False))
    return rest.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256))
        .otherwise(F.coalesce(F.sha2("kept", 256), "sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept"))


@query("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
