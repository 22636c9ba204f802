"""Hard-negative mining: Strassen products of anchor and candidate tiles.

Rows are packed into tiles of whole numbers. Every block of anchors meets every tile of candidates in
a cell that both were sent to; a cell multiplies them by Strassen's recursion on int64, which is exact,
and keeps per anchor a heap of its best positives, or per anchor and positive a heap of the best rows
in its window. Heaps of cells are merged by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.workspace import Workspace

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # window of a negative's score, in hundredths of the positive's
ANCHORS = 1024  # anchors of a block
TILE = 2048  # candidates of a tile
CELL = 4  # tiles that a block of anchors meets in one cell
LEAF = 16  # inner size up to which tiles are multiplied directly
LIMIT = 1 << 22  # whole components beyond it are cut to it, so that a hundredfold score stays a long

TILES = "part long, ids binary, labels binary, width int, values binary, floors binary"
MERGED = "anchor_id long, slot int, positive_id long, positive_score long, row_id long, score long"
NOTHING = -(1 << 63) + 1


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices, exact modulo 2**64. Odd sizes are padded with zeros."""
    m, k = a.shape
    n = b.shape[1]
    if k <= LEAF or min(m, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.empty((2 * m, 2 * n), np.int64)
    c11, c12, c21, c22 = out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:]
    p = strassen(a11 + a22, b11 + b22)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12)
    c11 += strassen(a12 - a22, b21 + b22)
    return out


def eligible(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector (whole numbers) of the rows that take part."""
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(x.cast("double") * 256))).cast("long"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(~odd)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vector"))


def pack(rows: DataFrame) -> DataFrame:
    """Tiles of up to ``TILE`` rows each, out of the partitions as they are."""
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, TILE - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == TILE:
                    yield from _tile(pa.Table.from_batches(held)).to_batches()
                    held, n = [], 0
        if held:
            yield from _tile(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(tiles, TILES)


def _tile(rows: pa.Table) -> pa.Table:
    """One row: ids (ascending), labels, the values as a matrix of ``width`` columns (shorter vectors
    end in zeros), and of anchors with positives each positive's score and id (``floors``)."""
    rows = rows.combine_chunks().sort_by("vec_id").combine_chunks()
    sizes = pc.list_value_length(rows["vector"]).to_numpy().astype(np.int64)
    width = int(sizes.max(initial=0))
    values = np.zeros((len(sizes), width), np.int32)
    values[np.arange(width) < sizes[:, None]] = pc.list_flatten(rows["vector"]).to_numpy()
    floors = np.full((len(sizes), 2 * POSITIVES), NOTHING)
    if "positives" in rows.column_names:
        for i, own in enumerate(rows["positives"].to_pylist()):
            for k, x in enumerate(own):
                floors[i, 2 * k : 2 * k + 2] = x["score"], x["id"]
    ids = rows["vec_id"].to_numpy().astype(np.int64)
    part = int(np.bitwise_xor.reduce(ids * 1_000_003 + np.arange(len(ids))))
    return pa.table({
        "part": [part], "ids": [ids.tobytes()], "labels": [rows["label"].to_numpy().astype(np.int64).tobytes()],
        "width": pa.array([width], pa.int32()), "values": [values.tobytes()], "floors": [floors.tobytes()]})


class Tile:
    def __init__(self, row: dict):
        self.ids, self.labels, floors = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "floors"))
        self.values = np.frombuffer(row["values"], np.int32).reshape(len(self.ids), row["width"]).astype(np.int64)
        self.positive_scores, self.positive_ids = floors.reshape(len(self.ids), POSITIVES, 2).transpose(2, 0, 1)


def products(anchors: Tile, tile: Tile) -> np.ndarray:
    """Scores of all anchors against all rows of a tile; narrower vectors are padded with zeros."""
    width = max(anchors.values.shape[1], tile.values.shape[1])
    a, b = (np.pad(x.values, ((0, 0), (0, width - x.values.shape[1]))) for x in (anchors, tile))
    return strassen(a, np.ascontiguousarray(b.T))


class Heaps:
    """The best ``size`` rows of each key: higher scores first, then smaller ids. Rows of other tiles
    are merged in; a key's kept and new rows are sorted together."""

    def __init__(self, size: int):
        self.size = size
        self.key = self.score = self.row = np.zeros(0, np.int64)

    def merge(self, key: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        key, score, row = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.row, row)))
        order = np.lexsort((row, -score, key))
        key, score, row = key[order], score[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        kept = place < self.size
        self.key, self.score, self.row = key[kept], score[kept], row[kept]


def add_positives(heaps: Heaps, anchors: Tile, tile: Tile) -> None:
    """Rows of the anchor's label, but for those with its id."""
    scores = products(anchors, tile)
    for label in np.intersect1d(anchors.labels, tile.labels):
        rows, columns = np.flatnonzero(anchors.labels == label), np.flatnonzero(tile.labels == label)
        own = scores[np.ix_(rows, columns)]
        own[tile.ids[columns] == anchors.ids[rows][:, None]] = NOTHING
        top = np.argsort(-own, axis=1, kind="stable")[:, :POSITIVES]
        score = np.take_along_axis(own, top, 1).ravel()
        real = score != NOTHING
        heaps.merge(np.repeat(rows, top.shape[1])[real], score[real], tile.ids[columns][top.ravel()][real])


def add_windows(heaps: Heaps, anchors: Tile, tile: Tile) -> None:
    """Rows of other labels in the window of each positive (key: anchor and place of the positive)."""
    scores = products(anchors, tile)
    found = []
    for i, wanted in enumerate(anchors.positive_scores):
        slots = np.flatnonzero(wanted >= 0)  # a negative score has an empty window
        if not len(slots):
            continue
        own = scores[i]
        # Rows between the ends of all windows, best first: those of one window lie together.
        inside = np.flatnonzero((own * 100 >= LOW * wanted[slots].min()) & (own * 100 <= HIGH * wanted[slots].max())
                                & (tile.labels != anchors.labels[i]))
        inside = inside[np.argsort(-own[inside], kind="stable")]
        down = -100 * own[inside]
        for k in slots:
            first = np.searchsorted(down, -HIGH * wanted[k], "left")
            end = min(np.searchsorted(down, -LOW * wanted[k], "right"), first + NEGATIVES)
            if end > first:
                at = inside[first:end]
                found.append((np.full(end - first, i * POSITIVES + k), own[at], tile.ids[at]))
    if found:
        heaps.merge(*(np.concatenate(x) for x in zip(*found)))


def mined(blocks: DataFrame, tiles: DataFrame, n_blocks: int, n_tiles: int, windows: bool) -> DataFrame:
    """Heaps of every cell. A cell is one block of anchors with one group of about ``CELL`` tiles:
    tiles are copied for every block, and blocks for every group."""
    groups = max(1, -(-n_tiles // CELL))
    names = ("ids", "labels", "width", "values", "floors")
    right = tiles.select(F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int").alias("g"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), *names)
    left = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "block", *names)
    add = add_windows if windows else add_positives

    def cell(key, own: pa.Table, others: pa.Table) -> pa.Table:
        out = []
        for row in own.to_pylist():
            anchors, heaps = Tile(row), Heaps(NEGATIVES if windows else POSITIVES)
            for i in range(others.num_rows):
                add(heaps, anchors, Tile(others.slice(i, 1).to_pylist()[0]))
            at, slot = np.divmod(heaps.key, POSITIVES) if windows else (heaps.key, np.zeros_like(heaps.key))
            out.append((anchors.ids[at], slot.astype(np.int32), anchors.positive_ids[at, slot],
                        anchors.positive_scores[at, slot], heaps.row, heaps.score))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int32 if k == 1 else np.int64) for k in range(6)]
        return pa.table([pa.array(x) for x in columns], [c.split()[0] for c in MERGED.split(", ")])

    return left.groupBy("block", "g").cogroup(right.groupBy("block", "g")).applyInArrow(cell, MERGED)


def best(rows: DataFrame, k: int) -> DataFrame:
    """Merge the heaps of all cells: the first ``k`` rows of each key, with their rank from 1."""
    own = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "row_id")
    return rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, is_anchor: Column | None = None, work: Workspace | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows
    where ``is_anchor`` holds (by default, vec_id divisible by 100).

    Rows with a null id, label or vector, or a null or non-finite component take no part; vectors of
    unlike lengths count as padded with zeros. Rows that repeat a vec_id are rows of their own as
    positives and negatives, but no row with the anchor's vec_id is its positive, and of anchors
    that repeat a vec_id the one with the smallest label, then vector, asks. Equal scores are
    ordered by vec_id. A row without positives or negatives gives no rows, as does an empty
    table. Whole components beyond ``LIMIT`` are cut to it. Other columns are dropped.
    """
    work = work or Workspace(embeddings.sparkSession, "negatives")
    rows = eligible(embeddings)
    tiles = work.keep(pack(rows), "tiles")
    asked = rows.where(F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x"))
    asked = work.keep(asked.select("vec_id", "x.label", "x.vector"), "anchors")
    n_tiles, n_blocks = tiles.count(), max(1, -(-asked.count() // ANCHORS))

    def blocks(anchors: DataFrame) -> DataFrame:
        dealt = anchors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"))
        packed = dealt.applyInArrow(lambda key, own: _tile(own).append_column("block", pa.array(key)), TILES + ", block int")
        return packed

    near = best(mined(blocks(asked), tiles, n_blocks, n_tiles, False), POSITIVES)
    near = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "score", F.col("row_id").alias("id")))).alias("positives"))
    found = work.keep(asked.join(near.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "positives")
    hard = best(mined(blocks(found), tiles, n_blocks, n_tiles, True), NEGATIVES)
    return hard.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"),
                       "positive_score", F.col("score").alias("negative_score"))


@query("op12_hard_negatives", """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS row_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, row_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id)
QUALIFY rank <= 10
""")
def op12_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))
