"""Keyword search: stored inverted index, corpus statistics and exact Okapi BM25 top-k.

The index is built in one pass over the texts and kept as tables: ``forward`` (one row per chunk with
its tokens and their counts), ``tokens`` (document frequency, idf and largest impact) and ``blocks``
(postings of a token by falling impact, a row for ``BLOCK`` of them, with the block's upper bound).
A search reads the first blocks, scores their best chunks in full for a k-th score that the answer reaches
in any case, and then only opens blocks whose bound, with all that the other tokens could add, comes up to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS, Settings
from corpuslake.functions import text as tx
from corpuslake.operators import ranking
from corpuslake.session import cut_lineage, path_exists, shared_dir

CHUNK_COLUMNS = ["chunk_id", "document_id", "chunk_index"]
FORMAT = 2  # of the stored tables; an index of another one is not opened
BLOCK = 64  # postings of a block
SHARD = 1 << 22  # postings of a shard, about; a token's postings are ranked shard by shard
SENT = 1 << 14  # blocks that are sent on at a time
SLACK = 1e-5  # scores are rounded to six places
ASKED = 200_000  # tokens of queries that are broadcast
CELLS = 1 << 18  # counts of chunks and queries that are held at a time
LOOKED_UP = 0.25  # part of the score to reach that tokens may add which only candidates are looked up for


def term_counts(tokens: pa.ListArray) -> pa.ListArray:
    """Distinct tokens of each row in order, with their counts (token, tf)."""
    words = pc.dictionary_encode(pc.list_flatten(tokens), null_encoding="encode")
    known = words.dictionary
    order = pc.sort_indices(known).to_numpy()
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    key = np.sort(pc.list_parent_indices(tokens).to_numpy() * len(known) + rank[words.indices.to_numpy()])
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    row, word = np.divmod(key[start], max(1, len(known)))
    bounds = np.append(0, np.cumsum(np.bincount(row, minlength=len(tokens))))
    terms = pa.StructArray.from_arrays(
        [known.take(pa.array(order[word])), pa.array(np.diff(np.append(start, len(key))), pa.int64())], ["token", "tf"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), terms, mask=tokens.is_null())


def forward_rows(chunks: DataFrame, tokenizer=tx.tokens) -> DataFrame:
    """One row per chunk: its length in tokens and its terms. Nothing is shuffled."""
    cut = chunks.select(*CHUNK_COLUMNS, tokenizer(F.col("content")).alias("terms"))
    cut = cut.select(*CHUNK_COLUMNS, F.size("terms").cast("long").alias("length"), "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch[c] for c in (*CHUNK_COLUMNS, "length")]
            yield pa.RecordBatch.from_arrays([*own, term_counts(batch["terms"])], batch.schema.names)

    kinds = dict(cut.dtypes)
    ids = ", ".join(f"{c} {kinds[c]}" for c in CHUNK_COLUMNS)
    return cut.mapInArrow(run, f"{ids}, length long, terms array<struct<token: string, tf: long>>")


def postings(chunks: DataFrame, tokenizer=tx.tokens) -> DataFrame:
    """One row per token and chunk: count in the chunk and chunk length."""
    return forward_rows(chunks, tokenizer).select(*CHUNK_COLUMNS, "length", F.inline("terms"))


def corpus_stats(forward: DataFrame) -> DataFrame:
    """One row: number of chunks and average length, blank chunks included."""
    return forward.agg(F.count("*").alias("n_chunks"), F.avg("length").alias("avg_length"))


def token_idf(counts: DataFrame, stats: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """idf of each token, from its document frequency (token, df; other columns stay); a negative idf becomes a share
    of the mean idf over the whole vocabulary."""
    n = stats.select("n_chunks").scalar()
    raw = counts.withColumn(
        "_raw",
        F.log(n - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5)),
    )
    # Rounded, so that the sum does not depend on the order of addition.
    mean = raw.agg(F.round(F.avg("_raw"), 9).alias("mean")).scalar()
    return raw.select(
        *counts.columns,
        F.when(F.col("_raw") < 0, F.lit(settings.bm25_epsilon) * mean)
        .otherwise(F.col("_raw"))
        .alias("idf"),
    )


def impact(tf, length, average, settings: Settings):
    """Share of a token in a chunk's score, to be weighed with the query's part (columns or arrays)."""
    k1, b = settings.bm25_k1, settings.bm25_b
    return tf * (k1 + 1) / (tf + k1 * (1.0 - b + b * length / average))


def block_rows(forward: DataFrame, average: float, settings: Settings) -> DataFrame:
    """token, shard, block, n (postings), top (largest impact) and members (chunk_no, impact) of each block. A shard
    is a run of chunks of one task, so that postings are ranked where their chunks lie and none is shuffled."""
    size, most = BLOCK, SHARD

    def ranked(held: list[tuple], shard: int) -> Iterator[pa.RecordBatch]:
        words = pa.chunked_array([h[0] for h in held]).unify_dictionaries().combine_chunks()
        known = words.dictionary
        order = pc.sort_indices(known).to_numpy()
        rank = np.empty(len(known), np.int32)
        rank[order] = np.arange(len(known), dtype=np.int32)
        word = rank[words.indices.to_numpy()]
        chunk, share = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        place = np.lexsort((chunk, -share, word))
        word, chunk, share = word[place], chunk[place], share[place]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        within = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
        start = np.flatnonzero(within % size == 0)
        end = np.append(start, len(word))[1:]
        for at in range(0, len(start), SENT):
            s, e = start[at:at + SENT], end[at:at + SENT]
            members = pa.StructArray.from_arrays([pa.array(chunk[s[0]:e[-1]]), pa.array(share[s[0]:e[-1]])], ["chunk_no", "impact"])
            yield pa.RecordBatch.from_arrays(
                [known.take(pa.array(order[word[s]])), pa.array(np.full(len(s), shard)), pa.array((within[s] // size).astype(np.int32)),
                 pa.array(e - s), pa.array(share[s]),
                 pa.ListArray.from_arrays(pa.array(np.append(s, e[-1]) - s[0], pa.int32()), members)],
                ["token", "shard", "block", "n", "top", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, shard = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            row, terms = pc.list_parent_indices(batch["terms"]).to_numpy(), pc.list_flatten(batch["terms"])
            if not len(row):
                continue
            tf = pc.struct_field(terms, "tf").to_numpy()
            held.append((
                pc.dictionary_encode(pc.struct_field(terms, "token")), batch["chunk_no"].to_numpy()[row],
                impact(tf, batch["length"].fill_null(0).to_numpy()[row], average, settings)))
            n += len(row)
            if n >= most:
                yield from ranked(held, shard)
                held, n, shard = [], 0, shard + 1
        if held:
            yield from ranked(held, shard)

    return forward.select("chunk_no", "length", "terms").mapInArrow(
        run, "token string, shard long, block int, n long, top double, members array<struct<chunk_no: long, impact: double>>")


@dataclass
class KeywordIndex:
    """Tables of a stored index; ``signature`` tells what it was built from."""

    forward: DataFrame
    tokens: DataFrame
    blocks: DataFrame
    stats: DataFrame
    signature: str
    settings: Settings = DEFAULTS

    def postings(self) -> DataFrame:
        return self.forward.select("chunk_no", *CHUNK_COLUMNS, "length", F.inline("terms"))


def open_index(spark: SparkSession, path: str, signature: str, settings: Settings = DEFAULTS) -> KeywordIndex | None:
    """The index stored at ``path``; None if there is none that was finished, or its signature is another."""
    if not path_exists(spark, f"{path}/ready/_SUCCESS"):
        return None
    known = spark.read.schema("signature string").parquet(f"{path}/ready").first()
    if known is None or known[0] != f"{FORMAT}:{signature}":
        return None
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return KeywordIndex(read("forward"), read("tokens"), read("blocks"), read("stats"), signature, settings)


def write_index(
    chunks: DataFrame, path: str, signature: str = "", settings: Settings = DEFAULTS, tokenizer=tx.tokens,
) -> KeywordIndex:
    """Build and store the index. Texts are tokenised once, by the table of chunks; the signature is written last, so that
    a build that broke off is not taken for an index."""
    spark = chunks.sparkSession
    forward_rows(chunks, tokenizer).withColumn("chunk_no", F.monotonically_increasing_id()).write.mode(
        "overwrite").parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")  # chunk_no is fixed from here on
    corpus_stats(forward).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    average = stats.first()["avg_length"]
    block_rows(forward, average, settings).write.mode("overwrite").parquet(f"{path}/blocks")
    counts = spark.read.parquet(f"{path}/blocks").groupBy("token").agg(F.sum("n").alias("df"), F.max("top").alias("max_impact"))
    token_idf(counts, stats, settings).write.mode("overwrite").parquet(f"{path}/tokens")
    spark.createDataFrame([(f"{FORMAT}:{signature}",)], "signature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/ready")
    return open_index(spark, path, signature, settings)


def stored_index(chunks: DataFrame, path: str, signature: str, settings: Settings = DEFAULTS, tokenizer=tx.tokens) -> KeywordIndex:
    """The index at ``path`` if it is of this signature, else a new one in its place."""
    known = open_index(chunks.sparkSession, path, signature, settings)
    return known or write_index(chunks, path, signature, settings, tokenizer)


def query_tokens(queries: DataFrame, tokenizer=tx.tokens) -> DataFrame:
    """Distinct tokens of each query with their number of occurrences."""
    return (
        queries.select("query_id", F.explode(tokenizer(F.col("query"))).alias("token"))
        .groupBy("query_id", "token")
        .agg(F.count("*").alias("qtf"))
    )


def _counted(forward: DataFrame, asked: pa.Table, kind_of_id: str) -> DataFrame:
    """query_id, chunk_id, shared_tokens of each row of ``forward``, counted where the row lies."""
    spark, kind = forward.sparkSession, forward.schema["chunk_id"].dataType.simpleString()
    ids = pc.unique(asked["query_id"])
    words = pc.unique(asked["token"])
    word, query = (pc.index_in(asked[c], value_set=v).to_numpy() for c, v in (("token", words), ("query_id", ids)))
    order = np.argsort(word, kind="stable")
    first = np.searchsorted(word[order], np.arange(len(words) + 1))
    shared = spark.sparkContext.broadcast((ids, words, query[order].astype(np.int64), first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, queries, first = shared.value
        step = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row = pc.list_parent_indices(part["tokens"]).to_numpy()
                word = pc.fill_null(pc.index_in(pc.list_flatten(part["tokens"]), value_set=words), -1).to_numpy()
                row, word = row[word >= 0], word[word >= 0]
                n = first[word + 1] - first[word]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[word], n)
                cells = np.bincount(np.repeat(row, n) * len(ids) + queries[place], minlength=1)
                found = np.flatnonzero(cells)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(found % max(1, len(ids)))), part["chunk_id"].take(pa.array(found // max(1, len(ids)))),
                     pa.array(cells[found], pa.int64())], ["query_id", "chunk_id", "shared_tokens"])

    schema = f"query_id {kind_of_id}, chunk_id {kind}, shared_tokens long"
    return forward.select("chunk_id", F.transform("terms", lambda t: t["token"]).alias("tokens")).mapInArrow(run, schema)


def shared_tokens(queries: DataFrame, index: KeywordIndex, tokenizer=tx.tokens) -> DataFrame:
    """Pairs of a query and a chunk that share a token, with the number of distinct tokens they share.

    Most pairs share one, so that the pairs are not shuffled: the tokens of the queries go to the rows
    of the chunks, up to ``ASKED`` of them; more are joined to the postings. Rows that repeat a
    chunk id count as one chunk."""
    asked = query_tokens(queries, tokenizer).select("query_id", "token")
    few = asked.limit(ASKED + 1).toArrow()
    if few.num_rows > ASKED:
        return index.postings().join(asked, "token").groupBy("query_id", "chunk_id").agg(F.count("*").alias("shared_tokens"))
    forward, kind = index.forward, dict(asked.dtypes)["query_id"]
    twice = forward.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_id").alias("twice"))
    if twice.isEmpty():
        return _counted(forward, few, kind)
    same = F.col("chunk_id").eqNullSafe(F.col("twice"))
    again = _counted(forward.join(twice, same, "left_semi"), few, kind).groupBy("query_id", "chunk_id").agg(
        F.sum("shared_tokens").alias("shared_tokens"))
    return _counted(forward.join(twice, same, "left_anti"), few, kind).unionByName(again)


def scored(pairs: DataFrame, weighted: DataFrame, index: KeywordIndex) -> DataFrame:
    """Full BM25 scores of pairs (query_id, chunk_no), from the terms of the chunks."""
    average = F.lit(index.stats.first()["avg_length"]).cast("double")
    terms = pairs.join(index.forward, "chunk_no").select("query_id", "chunk_no", *CHUNK_COLUMNS, "length", F.inline("terms"))
    gain = F.col("weight") * impact(F.col("tf"), F.col("length"), average, index.settings)
    return terms.join(weighted.select("query_id", "token", "weight"), ["query_id", "token"]).groupBy(
        "query_id", "chunk_no", *CHUNK_COLUMNS).agg(F.round(F.sum(gain), 6).alias("score"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc("document_id"), F.asc("chunk_index")]
    return ranking.top_k(rows.where("score > 0"), ["query_id"], order, k)


def search(
    queries: DataFrame,
    chunks: DataFrame,
    settings: Settings = DEFAULTS,
    tokenizer=tx.tokens,
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Best chunks of each query with a score above 0; ties in corpus order. Exact: a chunk is passed
    over only where its upper bound is below a score that k chunks are known to reach."""
    if index is None:
        index = write_index(chunks, shared_dir(queries.sparkSession, "keywords"), settings=settings, tokenizer=tokenizer)
    k = settings.bm25_k
    weighted = query_tokens(queries, tokenizer).join(index.tokens, "token").select(
        "query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"),
        (F.col("qtf") * F.col("idf") * F.col("max_impact")).alias("most"))
    # Tokens with a negative weight only lower a score: they add nothing to a bound.
    add = F.greatest("most", F.lit(0.0))
    own, rising = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("most", "token")
    weighted = cut_lineage(weighted.withColumn("total", F.sum(add).over(own)).withColumn("upto", F.sum(add).over(rising)), "weights")

    # A score that k chunks reach: the best chunks of each token's first blocks, scored in full.
    first = index.blocks.where("block = 0").join(weighted.where("weight > 0"), "token")
    partial = first.select("query_id", "weight", F.inline("members")).groupBy("query_id", "chunk_no").agg(
        F.sum(F.col("weight") * F.col("impact")).alias("part"))
    leaders = ranking.top_k(partial, ["query_id"], [F.desc("part"), F.asc("chunk_no")], 4 * k).select("query_id", "chunk_no")
    known = _best(scored(cut_lineage(leaders, "leaders"), weighted, index), k)
    reached = cut_lineage(known.where(F.col("rank") == k - 1).select("query_id", (F.col("score") - SLACK).alias("reached")), "reached")

    # A chunk that reaches it holds an essential token: the others, the commonest, together stay below a part of it.
    # It lies in blocks of essential tokens whose bound, with all that other tokens could add, comes up to
    # it; and what they give it, with all that the commonest could add, comes up to it.
    bounds = weighted.where("weight > 0").join(reached, "query_id", "left").fillna(0.0, ["reached"])
    bounds = bounds.withColumn("essential", F.col("upto") >= LOOKED_UP * F.col("reached"))
    bounds = bounds.withColumn("rest", F.sum(F.when(F.col("essential"), 0.0).otherwise(add)).over(own)).where("essential")
    opened = index.blocks.join(bounds, "token").where(
        F.col("weight") * F.col("top") >= F.col("reached") - F.col("total") + F.col("most"))
    given = opened.select("query_id", "weight", "reached", "rest", F.inline("members")).groupBy("query_id", "chunk_no").agg(
        F.sum(F.col("weight") * F.col("impact")).alias("part"), F.max(F.col("reached") - F.col("rest")).alias("least"))
    pairs = cut_lineage(given.where(F.col("part") >= F.col("least") - SLACK).select("query_id", "chunk_no"), "pairs")
    return _best(scored(pairs, weighted, index), k).drop("chunk_no")
