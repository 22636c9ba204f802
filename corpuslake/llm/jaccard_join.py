"""N-gram Jaccard join by a size-aware split into small and large sets.

A document is the set of its 5-word shingles. Documents with equal sets are one class. Two small
sets find each other through subsets of a fixed size that both hold whole; every pair with a large
set through inverted lists of the first shingles in a common order (frequent shingles last), of
which a similar pair shares one at least. The boundary is the size with the lowest estimated cost.
Each list compares its members with one of them first; members that this puts into one component
need no further comparison, and all other pairs of a list are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.links import linked
from corpuslake.llm.registry import query, table
from corpuslake.llm.words import Block, Hasher, blocks, mix, ragged
from corpuslake.llm.workspace import Workspace, components, near

WORDS = 5
NUM, DEN = 80, 100  # the least similarity
SMALL = 30  # whole sets are kept up to this size; the boundary lies below 0.8 of it
HOT_LIMIT = 1_000_000  # frequent shingles that are broadcast: 8 MB at most
_TOP = np.uint64(1 << 63)


def overlap(n: int, m: int) -> int:
    """Least intersection of similar sets of these sizes."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_size(n):
    """Of the first so many elements similar sets share one."""
    return n + (-NUM * n // DEN) + 1


def shingles(block: Block, hashers: tuple[Hasher, Hasher]) -> tuple[np.ndarray, np.ndarray]:
    """Documents (within the block) and 63-bit hashes of all shingles; not yet distinct."""
    of_words, of_shingles = hashers
    words = block.hashes(of_words)
    start = block.windows(WORDS)
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < WORDS))
    doc = block.doc
    start = np.concatenate([start, block.first[short]])
    end = np.concatenate([start[: len(start) - len(short)] + WORDS, block.first[short + 1]])
    return doc[start], of_shingles.spans(words, start, end) & ~_TOP


def sets(texts: pa.Array, hot: np.ndarray) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Blocks with the sizes of the sets and their elements, document by document, each in the
    common order: by hash, but all of ``hot`` (sorted) after the others."""
    hashers = Hasher(11, lower=True), Hasher(12)
    for block in blocks(texts):
        doc, token = shingles(block, hashers)
        key = token
        if len(hot):
            at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
            key = token | np.where(hot[at] == token, _TOP, np.uint64(0))
        order = np.lexsort((key, doc))
        doc, token = doc[order], token[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        doc, token = doc[new], token[new]
        yield block, np.bincount(doc, minlength=len(block.n_words)), token


def signature(sizes: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each set, whatever its order; 0 for an empty one."""
    total = np.append(np.uint64(0), np.cumsum(mix(tokens ^ mix(np.array([seed], np.uint64)))))
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, mix(total[ends] - total[ends - sizes]) & ~_TOP, np.uint64(0)).astype(np.int64)


def sketches(sizes: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """How many elements of a set fall into each of about n / 2 buckets (255: that many or more).
    Sketches of two lengths compare by folding the longer one."""
    width = 1 << np.maximum(3, np.ceil(np.log2(np.maximum(sizes, 1))).astype(int) - 1)
    base = np.cumsum(width) - width
    bucket = np.repeat(base, sizes) + (tokens & np.repeat(width - 1, sizes).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(bucket, minlength=int(width.sum())), 255).astype(np.uint8)
    return [counts[b : b + w].tobytes() for b, w in zip(base, width)]


def may_be_similar(x: bytes, y: bytes) -> bool:
    """False only for sets that cannot be: by their sizes, or as no intersection can be larger
    than what the buckets allow."""
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (x, y))
    if x.max() == 255 or y.max() == 255:
        return True
    n, m = int(x.sum()), int(y.sum())
    if NUM * max(n, m) > DEN * min(n, m):
        return False
    short = min(len(x), len(y))
    x, y = (s.reshape(-1, short).sum(0) for s in (x, y))
    return int(np.minimum(x, y).sum()) >= overlap(n, m)


def frequent(docs: DataFrame, least: int = 16) -> np.ndarray:
    """Shingles that ``least`` documents or more have, sorted. The result orders the
    shingles and decides nothing else, so that its bound costs time at most, never a pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, tokens in sets(batch["text"], np.zeros(0, np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64))], ["token"])

    # Few repeat within a task, so that summing up before the shuffle would only cost memory.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = (
        docs.select("text").mapInArrow(run, "token long").repartition(parts, "token").groupBy("token")
        .agg(F.count("*").alias("n")).where(F.col("n") >= least)
        .orderBy(F.desc("n"), "token").limit(HOT_LIMIT).select("token").toPandas()
    )
    return np.sort(top["token"].to_numpy().astype(np.uint64))


def describe(docs: DataFrame, hot) -> DataFrame:
    """doc_id, n, node (signature of the set), its first elements (all of a small set), sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = hot.value
        for batch in batches:
            for block, sizes, tokens in sets(batch["text"], order):
                kept = np.where(sizes <= SMALL, sizes, prefix_size(sizes))
                starts = np.cumsum(sizes) - sizes
                place = np.arange(len(tokens)) - np.repeat(starts, sizes)
                first = tokens[place < np.repeat(kept, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(block.rows.start, len(sizes)), pa.array(sizes),
                     pa.array(signature(sizes, tokens, 7)), ragged(kept, first.astype(np.int64), pa.int64()),
                     pa.array(sketches(sizes, tokens), pa.binary())],
                    ["doc_id", "n", "node", "first", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, node long, first array<long>, sketch binary")


def whole_sets(docs: DataFrame) -> DataFrame:
    """node and all elements (sorted, as bytes) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sizes, tokens in sets(batch["text"], np.zeros(0, np.uint64)):
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signature(sizes, tokens, 7)),
                     pa.array([tokens[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary())],
                    ["node", "elements"])

    return docs.select("text").mapInArrow(run, "node long, elements binary")


# --- small sets ------------------------------------------------------------------


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a set of ``n`` may have to share with one up to the boundary."""
    partners = [m for m in range(1, boundary + 1) if NUM * max(n, m) <= DEN * min(n, m)]
    return sorted({overlap(n, m) for m in partners})


def subsets(small: DataFrame, boundary: int) -> DataFrame:
    """node, size, token: a token for each subset of the needed sizes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(13)
        for batch in batches:
            nodes, sizes, tokens = [], [], []
            for node, elements in zip(batch["node"].to_pylist(), batch["first"].to_pylist()):
                elements = sorted(elements)
                for size in subset_sizes(len(elements), boundary):
                    rows = np.array(list(combinations(elements, size)), np.int64).astype(np.uint64)
                    at = np.arange(len(rows)) * size
                    found = hasher.spans(rows.ravel(), at, at + size) & ~_TOP
                    tokens.append(found)
                    nodes.append(np.full(len(found), node))
                    sizes.append(np.full(len(found), len(elements), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)),
                     pa.array(np.concatenate(tokens).astype(np.int64))], ["node", "size", "token"])

    return small.select("node", "first").mapInArrow(run, "node long, size int, token long")


def prefixes(leads: DataFrame) -> DataFrame:
    """node, n, place, token of the first elements in the common order."""
    size = prefix_size_column().cast("int")
    return leads.select("node", "n", F.posexplode(F.slice("first", 1, size)).alias("place", "token"))


def best_boundary(leads: DataFrame) -> int:
    """Size up to which subsets cost less than scanning lists, by the sizes and the lists of all
    small sets (one row per size reaches the driver)."""
    entries = prefixes(leads.where(F.col("n") <= SMALL))
    lists = entries.groupBy("token").agg(F.count("*").alias("c"))
    scans = dict(entries.join(lists, "token").groupBy("n").agg(F.sum("c").alias("s")).collect())
    counts = dict(leads.where(F.col("n") <= SMALL).groupBy("n").count().collect())

    def cost(x: int) -> int:
        light = sum(c * sum(comb(n, k) for k in subset_sizes(n, x)) for n, c in counts.items() if n <= x)
        return light + sum(s for n, s in scans.items() if DEN * n >= NUM * (x + 1))

    return min(range(0, SMALL * NUM // DEN), key=lambda x: (cost(x), x))


# --- pairs -------------------------------------------------------------------------


def similar(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if NUM * max(len(x), len(y)) > DEN * min(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(DEN * same >= NUM * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = elements.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    y = elements.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are compared with A-Z in lower case. A null or empty text, or one without words, has an
    empty set and links with nothing. A row without doc_id keeps its set size, gets no component
    and links with nothing. Rows that repeat a doc_id are compared like any others. Other columns
    are dropped.
    """
    work = work or Workspace(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", "text")
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs))  # at most HOT_LIMIT hashes
    work.drop()
    rows = work.keep(describe(docs, hot), "rows")
    real = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = work.keep(real.groupBy("node").agg(F.min("doc_id").alias("lead")), "classes")
    lead = classes.select("node", F.col("lead").alias("doc_id")).hint("shuffle_hash")
    leads = work.keep(real.join(lead, ["node", "doc_id"], "left_semi").select("node", "n", "first", "sketch"), "leads")

    boundary = best_boundary(leads)
    large = leads.where(DEN * F.col("n") >= NUM * (boundary + 1))
    # If the element at this place is the first common one, all common ones lie from it on.
    most = f"(size - place) * {NUM + DEN} div {NUM} - size"
    entries = prefixes(large).select("token", "node", F.col("n").cast("int").alias("size"), "place")
    if boundary:
        small = work.keep(subsets(leads.where(F.col("n") <= boundary), boundary), "subsets")
        entries = entries.union(small.select("token", "node", "size", F.lit(0).alias("place")))
    steps = iter(range(1, 3))

    def check(pairs: DataFrame) -> DataFrame:
        step = next(steps)
        return _verified(docs, classes, work.keep(_fitting(pairs, leads), f"pairs-{step}"), work, step)

    links = linked(entries.where("token is not null").repartition(_partitions(leads), "token"), most, check, work)
    work.drop("subsets", "pairs-1", "pairs-2", "leads")

    found = components(links, work, "all").select("node", "component")
    placed = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("lead").alias("component_id"))
    placed = work.keep(placed.join(smallest, "component").select("node", "component_id"), "placed")
    return rows.join(placed, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .otherwise(F.col("doc_id")).alias("component_id"))


def _partitions(leads: DataFrame) -> int:
    """So many that a partition has about a million entries, and as Spark's setting at least."""
    n = leads.agg(F.sum(prefix_size_column())).first()[0] or 0
    return max(int(leads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(n) // 1_000_000))


def prefix_size_column():
    return F.expr(f"n - ({NUM} * n + {DEN - 1}) div {DEN} + 1")


def _fitting(pairs: DataFrame, leads: DataFrame) -> DataFrame:
    """Pairs that their sketches do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_be_similar(x, y) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = leads.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    y = leads.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, work: Workspace, step: int) -> DataFrame:
    """Links among the pairs; only documents that take part are read for it."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = work.keep(classes.join(nodes, "node").select(F.col("lead").alias("doc_id")), f"ids-{step}")
    elements = work.keep(whole_sets(docs.join(near(ids), "doc_id", "left_semi")), f"elements-{step}")
    links = work.keep(similar(pairs, elements), f"verified-{step}")
    work.drop(f"elements-{step}", f"ids-{step}")
    return links


@query("op1_jaccard_join")
def op1_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
