"""Vectors: hashed text embeddings, exact search by blocks, an inverted file and an LSH variant."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.config import DEFAULTS, Settings
from corpuslake.functions import text as tx
from corpuslake.operators import ranking
from corpuslake.session import cut_lineage

# A block of query vectors that meets a group of vectors in one task.
QUERY_BLOCK_BYTES = 16 << 20
# Vectors of such a group, about.
GROUP_ROWS = 16_384
# Scores held at a time: vectors of a group times queries.
TILE_CELLS = 4_000_000


def token_buckets(text, dims: int = DEFAULTS.embedding_dims):
    """Hash bucket of every token of a text."""
    return F.transform(
        tx.tokens(text),
        lambda word: F.conv(F.substring(F.md5(word.cast("binary")), 1, 6), 16, 10).cast("int")
        % dims,
    )


def hashed_embedding(
    df: DataFrame, text: str, out: str = "embedding", dims: int = DEFAULTS.embedding_dims
) -> DataFrame:
    """Unit vector of hashed token counts; texts without tokens get a zero vector.

    Hashing runs in the JVM, counting in one numpy call per Arrow batch.
    """
    hashed = df.withColumn("_buckets", token_buckets(F.col(text), dims))
    schema = T.StructType(
        df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))]
    )

    kept, names = df.columns, schema.names

    def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_buckets"))
            rows = batch.num_rows
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            cells = np.repeat(np.arange(rows), lengths) * dims + flat
            counts = np.bincount(cells.astype(np.int64), minlength=rows * dims)
            matrix = counts.reshape(rows, dims).astype(np.float64)
            norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            matrix = np.divide(matrix, norms, out=matrix, where=norms > 0)
            vectors = pa.ListArray.from_arrays(
                pa.array(np.arange(rows + 1) * dims, pa.int32()),
                pa.array(matrix.ravel()),
            )
            same = [batch.column(batch.schema.get_field_index(name)) for name in kept]
            yield pa.RecordBatch.from_arrays(same + [vectors], names=names)

    return hashed.mapInArrow(count_buckets, schema)


def embed(
    df: DataFrame,
    text: str,
    model: Callable[[list[str]], np.ndarray],
    dims: int,
    is_query: bool = False,
    out: str = "embedding",
) -> DataFrame:
    """Embedding by a pluggable model: a batch of texts in, as many vectors out."""
    prefix = "query: " if is_query else "passage: "

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        vectors = model([prefix + value for value in texts])
        if len(vectors) != len(texts):
            raise ValueError(f"model returned {len(vectors)} vectors for {len(texts)} texts")
        return pd.Series([np.asarray(v, dtype=np.float32).tolist() for v in vectors])

    return df.withColumn(out, run(F.col(text)))


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _best_of(query_ids: pa.Array, query_matrix: np.ndarray, ids: pa.Array, matrix: np.ndarray, k: int, tile_cells: int):
    """Query ids, row ids and scores of each query's best ``k`` rows; of equal scores the smallest ids."""
    order = pc.sort_indices(ids)
    ids, matrix = ids.take(order), matrix[order.to_numpy()]
    step = max(1, tile_cells // max(1, len(ids)))
    out = []
    for at in range(0, len(query_ids), step):
        # Rows are in id order, so that the first of equal scores is the smallest id.
        scores = np.round(matrix @ query_matrix[at : at + step].T, 6) + 0.0
        keep = min(k, len(ids))
        floor = np.partition(scores, -keep, axis=0)[-keep]
        above, level = scores > floor, scores == floor
        fill = np.cumsum(level, axis=0) <= keep - above.sum(axis=0)
        rows, cols = np.nonzero(above | (level & fill))
        out.append((query_ids.take(pa.array(cols + at)), ids.take(pa.array(rows)), pa.array(scores[rows, cols])))
    return out


def _score_groups(queries: DataFrame, vectors: DataFrame, keys: list[str], id_column: str, k: int, tile_cells: int) -> DataFrame:
    """Best ``k`` rows of each query within each group that both sides share; both sides of a group are
    in memory together, so their sizes must be bounded."""
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), vectors.schema[id_column],
        T.StructField("score", T.DoubleType())])
    types = dict(zip(schema.names, pa_types(schema)))

    def run(key, asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked.num_rows or not stored.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in types.items()})
        flat = lambda t, c: t.column(c).combine_chunks()
        parts = _best_of(flat(asked, "query_id"), _matrix(flat(asked, "embedding")), flat(stored, id_column),
                         _matrix(flat(stored, "embedding")), k, tile_cells)
        return pa.concat_tables([pa.table(dict(zip(schema.names, part))) for part in parts])

    asked = queries.select(*keys, "query_id", "embedding").groupBy(*keys)
    return asked.cogroup(vectors.select(*keys, id_column, "embedding").groupBy(*keys)).applyInArrow(run, schema)


def pa_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(field.dataType) for field in schema.fields]


def search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = DEFAULTS.vector_k,
    id_column: str = "chunk_id",
    block_bytes: int = QUERY_BLOCK_BYTES,
    tile_cells: int = TILE_CELLS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Exact best ``k`` vectors of each query by dot product.

    ``queries`` has query_id and embedding, ``vectors`` an id and embedding of
    the same length. Queries are dealt into blocks of a checked size and vectors into groups
    of about ``group_rows``; every block meets every group in one task, which multiplies them and
    keeps the best ``k`` of each query. Neither side passes the driver.
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    blocks = max(1, -(-size["n"] * (size["dims"] or 1) * 8 // block_bytes))
    groups = max(1, -(-vectors.count() // group_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    asked = queries.select("query_id", "embedding", dealt("query_id", blocks).alias("_block"), every(groups).alias("_group"))
    stored = vectors.select(id_column, "embedding", dealt(id_column, groups).alias("_group"), every(blocks).alias("_block"))
    found = _score_groups(asked, stored, ["_block", "_group"], id_column, k, tile_cells)
    return ranking.top_k(found, ["query_id"], [F.desc("score"), F.asc(id_column)], k)


# --- inverted file ---------------------------------------------------------

def train_cells(vectors: DataFrame, cells: int, sample: int = 64, rounds: int = 12, seed: int = 5) -> DataFrame:
    """cell and centroid: spherical k-means on at most ``sample`` vectors a cell, those with the smallest
    hashes of the vector. One task trains on the sample; zero vectors are left out."""
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("_h", F.xxhash64("embedding")).orderBy("_h").limit(cells * sample)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(batch.column(0)) for batch in batches if batch.num_rows]
        if not parts:
            return
        points = np.concatenate(parts)
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        rng = np.random.default_rng(seed)
        centres = points[rng.permutation(len(points))[:cells]].copy()
        for _ in range(rounds):
            near = (points @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(list(centres), pa.list_(pa.float64()))],
            ["cell", "centroid"])

    return rows.select("embedding", "_h").repartition(1).sortWithinPartitions("_h").select("embedding").mapInArrow(
        train, "cell int, centroid array<double>")


def nearest_cells(df: DataFrame, key: str, cells: DataFrame, n: int) -> DataFrame:
    """key, embedding and the ``n`` cells with the nearest centroids (a row each)."""
    rows = cells.orderBy("cell").collect()  # as many as cells, a documented parameter
    shared = df.sparkSession.sparkContext.broadcast(np.array([r["centroid"] for r in rows]))
    schema = T.StructType([df.schema[key], df.schema["embedding"], T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(-(_matrix(batch.column(1)) @ centres.T), axis=1, kind="stable")[:, :n]
            rows = np.repeat(np.arange(batch.num_rows), near.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                 pa.array(near.ravel().astype(np.int32))], names=schema.names)

    return df.select(key, "embedding").mapInArrow(run, schema)


@dataclass
class InvertedFile:
    """Vectors by cell (``cell, part`` and the vectors' columns), the parts of each cell, and its centroids.
    Cells of many vectors are split into parts of about ``part_rows``."""

    centroids: DataFrame
    rows: DataFrame
    parts: DataFrame
    id_column: str
    probes: int


def inverted_file(
    vectors: DataFrame, id_column: str = "chunk_id", cells: int | None = None, share: float = 0.08,
    part_rows: int = GROUP_ROWS, most_cells: int = 4096,
) -> InvertedFile:
    """Index all vectors under trained cells: about the square root of their number, ``most_cells`` at
    most. A query looks into the nearest ``share`` of the cells."""
    base = cut_lineage(vectors.select(id_column, "embedding"), "vectors")
    cells = cells or max(1, min(most_cells, round(base.count() ** 0.5)))
    centres = cut_lineage(train_cells(base, cells), "centroids")
    placed = cut_lineage(nearest_cells(base, id_column, centres, 1), "cells")
    parts = cut_lineage(placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn(
        "parts", F.ceil(F.col("n") / part_rows).cast("int")), "parts")
    rows = placed.join(F.broadcast(parts), "cell").withColumn(
        "part", F.pmod(F.xxhash64(id_column), F.col("parts")).cast("int")).drop("n", "parts")
    return InvertedFile(centres, rows, parts, id_column, max(1, -(-int(cells * share * 100) // 100)))


def search_cells(queries: DataFrame, index: InvertedFile, k: int = DEFAULTS.vector_k, query_rows: int = 4096) -> DataFrame:
    """Best ``k`` vectors of each query among those in its nearest cells, scored exactly. Queries that find
    fewer than ``k`` there are searched in all vectors. A cell that many queries ask for is asked in several groups."""
    probes = cut_lineage(nearest_cells(queries, "query_id", index.centroids, index.probes), "probes")
    asked = probes.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("lots"))
    lots = cut_lineage(asked.join(index.parts.select("cell", "parts"), "cell"), "lots")  # a row a cell
    left = probes.join(F.broadcast(lots), "cell").withColumn(
        "lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = index.rows.join(F.broadcast(lots.select("cell", "lots")), "cell").withColumn(
        "lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    found = _score_groups(left, right, ["cell", "part", "lot"], index.id_column, k, TILE_CELLS)
    near = cut_lineage(ranking.top_k(found, ["query_id"], [F.desc("score"), F.asc(index.id_column)], k), "near")
    return filled_up(near, queries, index.rows, k, index.id_column)


def filled_up(near: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, id_column: str) -> DataFrame:
    """``near`` with the exact answer in place of those that have fewer than ``k`` rows."""
    full = near.groupBy("query_id").count().where(F.col("count") >= k)
    short = cut_lineage(queries.select("query_id", "embedding").join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return near
    rest = search(short, vectors, k, id_column)
    return near.join(full, "query_id", "left_semi").unionByName(rest.select(*near.columns))


def band_codes(df: DataFrame, key: str, planes: np.ndarray, bands: int) -> DataFrame:
    """``key``, band, code: signs of random projections, some bits for each band."""
    bits = len(planes) // bands
    weights = (1 << np.arange(bits)).astype(np.int64)
    schema = T.StructType([
        df.schema[key], T.StructField("band", T.IntegerType()), T.StructField("code", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _matrix(batch.column(1)) @ planes.T > 0
            codes = signs.reshape(-1, bands, bits) @ weights
            rows = np.repeat(np.arange(batch.num_rows), bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)),
                 pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)),
                 pa.array(codes.ravel())],
                names=schema.names,
            )

    return df.select(key, "embedding").mapInArrow(run, schema)


def search_lsh(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = DEFAULTS.vector_k,
    id_column: str = "chunk_id",
    bands: int = 32,
    bits: int = 5,
    seed: int = 7,
) -> DataFrame:
    """Approximate variant: vectors that agree with the query in all signs of a band
    are scored exactly. A query that finds fewer than ``k`` that way is searched in
    all vectors, so that every query gets its ``k`` rows. More bits make smaller
    buckets, more bands raise the recall.
    """
    dims = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    planes = np.random.default_rng(seed).normal(size=(bands * bits, dims))
    asked = band_codes(queries, "query_id", planes, bands)
    stored = band_codes(vectors, id_column, planes, bands)
    pairs = asked.join(stored, ["band", "code"]).select("query_id", id_column).distinct()
    both = pairs.join(
        queries.select("query_id", F.col("embedding").alias("_q")), "query_id"
    ).join(vectors.select(id_column, F.col("embedding").alias("_v")), id_column)
    dot = F.aggregate(
        F.zip_with("_q", "_v", lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x,
    )
    near = ranking.top_k(
        both.select("query_id", id_column, (F.round(dot, 6) + 0.0).alias("score")),
        ["query_id"], [F.desc("score"), F.asc(id_column)], k,
    )
    near = cut_lineage(near, "near")
    return filled_up(near, queries, vectors, k, id_column)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Unit mean vector per label, as prototype queries.

    The mean is taken per dimension with partial sums, so a label with most of
    the rows shuffles one row per task and dimension.
    """
    means = (
        vectors.select(label, F.posexplode("embedding").alias("dim", "x"))
        .groupBy(label, "dim")
        .agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    )
    dense = means.groupBy(label).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]
        ).alias("mean")
    )
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return dense.select(
        F.col(label).alias("query_id"),
        F.transform("mean", lambda x: x / norm).alias("embedding"),
    )
