"""From documents to chunks: splitting, tail merge, dedup and chunk records."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.config import DEFAULTS, SPLIT_SEPARATORS, Settings
from corpuslake.functions import text as tx
from corpuslake.operators import ranking
from corpuslake.session import cut_lineage

PIECES = T.StructType([
    T.StructField("document_id", T.StringType()),
    T.StructField("part_index", T.IntegerType()),
    T.StructField("piece_index", T.IntegerType()),
    T.StructField("content", T.StringType()),
])


def _size(text: str) -> int:
    return max(1, len(text) // 2) if text else 0


def split_text(
    text: str,
    size: int,
    overlap: int,
    separators: tuple[str, ...] = SPLIT_SEPARATORS,
) -> list[str]:
    """Recursive character split of one text, sizes in tokens."""
    level = next(
        (i for i, sep in enumerate(separators) if sep == "" or sep in text),
        len(separators) - 1,
    )
    mark, finer = separators[level], separators[level + 1 :]
    if mark:
        head, *tail = text.split(mark)
        pieces = [piece for piece in [head] + [mark + rest for rest in tail] if piece]
    else:
        pieces = list(text)

    chunks: list[str] = []
    window: list[tuple[str, int]] = []
    held = 0

    def emit() -> None:
        packed = "".join(piece for piece, _ in window).strip()
        if packed:
            chunks.append(packed)

    for piece in pieces:
        cost = _size(piece)
        if cost >= size:
            if window:
                emit()
                window, held = [], 0
            chunks += split_text(piece, size, overlap, finer) if finer else [piece]
            continue
        if window and held + cost > size:
            emit()
            drop = 0
            while drop < len(window) and (held > overlap or held + cost > size):
                held -= window[drop][1]
                drop += 1
            window = window[drop:]
        window.append((piece, cost))
        held += cost
    if window:
        emit()
    return chunks


def split_documents(
    parts: DataFrame,
    settings: Settings = DEFAULTS,
    size: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Split each part of a document; one row per piece, whole texts.

    ``parts`` has document_id, part_index and content. A text is one row, so the
    work spreads evenly even when one document has most of the parts.
    """
    limit, overlap = size or settings.chunk_size, settings.chunk_overlap

    def split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc, part, i, piece)
                for doc, part, content in zip(
                    batch.document_id, batch.part_index, batch.content
                )
                for i, piece in enumerate(split_text(content, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=PIECES.names)

    spread = parts.select("document_id", "part_index", "content")
    if partitions:
        spread = spread.repartition(partitions, "document_id", "part_index")
    return spread.mapInPandas(split_batches, PIECES)


def with_positions(pieces: DataFrame) -> DataFrame:
    """One order column per document from part and piece numbers."""
    return pieces.withColumn(
        "pos",
        F.shiftleft(F.col("part_index").cast("long"), 32) + F.col("piece_index"),
    )


def merge_tiny_tails(
    pieces: DataFrame, min_tokens: int = DEFAULTS.min_chunk_size, order: str = "pos"
) -> DataFrame:
    """Append each tiny piece, but never the first, to the piece before it.

    A group starts at every piece that is not tiny and at the first one; group
    numbers are a running count that spreads a hot document over many tasks.
    Only short pieces ever share a group with their head, and a group ends at
    the next normal piece.
    """
    tiny = tx.token_count(F.col("content")) < min_tokens
    numbered = ranking.position(pieces, ["document_id"], order, "_seq")
    starts = F.when((F.col("_seq") == 0) | ~tiny, 1).otherwise(0).cast("long")
    grouped = ranking.running_sum(numbered, ["document_id"], "_seq", starts, "_group")
    rest = [c for c in pieces.columns if c not in ("document_id", "content", order)]
    return grouped.groupBy("document_id", "_group").agg(
        F.min(order).alias(order),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_seq", "content"))),
                lambda item: item["content"],
            ),
            "\n",
        ).alias("content"),
        *[F.min_by(name, order).alias(name) for name in rest],
    ).drop("_group")


def dedup_pieces(pieces: DataFrame, order: str = "pos") -> DataFrame:
    """Keep the first of equal pieces of a document, then number them from 0."""
    hashed = pieces.withColumn("content_hash", tx.content_hash(F.col("content")))
    first = ranking.first_per_key(
        hashed, ["document_id", "content_hash"], F.col(order)
    )
    return ranking.position(first, ["document_id"], order, "chunk_index")


def chunk_records(
    pieces: DataFrame, documents: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Chunk table rows from numbered pieces and their documents.

    The open metadata of a piece goes to a map, without the keys that are
    columns of their own.
    """
    own = ["chunk_id", "document_id", "file_hash", "chunk_index"]
    if "metadata" not in pieces.columns:
        pieces = pieces.withColumn(
            "metadata", F.create_map().cast("map<string,string>")
        )
    facts = F.map_concat(
        F.map_filter(
            F.col("metadata"),
            lambda key, _: ~key.isin(*own, "source", "filename", "content_hash"),
        ),
        F.create_map(
            F.lit("source"), F.col("source_path"),
            F.lit("filename"), tx.file_name(F.col("source_path")),
            F.lit("content_hash"), F.col("content_hash"),
        ),
    )
    return pieces.join(
        documents.select("document_id", "file_hash", "source_path"), "document_id"
    ).select(
        tx.chunk_key(
            F.col("document_id"),
            F.col("file_hash"),
            F.col("chunk_index"),
            settings.index_schema_version,
        ).alias("chunk_id"),
        "document_id",
        "file_hash",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "content",
        "content_hash",
        tx.token_count(F.col("content")).cast("long").alias("token_count"),
        F.try_element_at("metadata", F.lit("page")).cast("int").alias("page"),
        F.try_element_at("metadata", F.lit("section")).alias("section"),
        "source_path",
        facts.alias("metadata"),
    )


def chunk_documents(
    documents: DataFrame, settings: Settings = DEFAULTS, partitions: int | None = None
) -> DataFrame:
    """Whole chain: split, merge tiny tails, dedup, number, build records."""
    parts = documents.select(
        "document_id", F.lit(0).alias("part_index"), F.col("text").alias("content")
    ).where(~tx.is_blank(F.col("content")))
    pieces = with_positions(split_documents(parts, settings, partitions=partitions))
    merged = merge_tiny_tails(pieces, settings.min_chunk_size)
    return chunk_records(dedup_pieces(merged), documents, settings)


def line_chunks(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One chunk per distinct non-blank line of a document.

    All lines of a document are in one row, so dedup and numbering happen inside
    that row: no shuffle, and a document with many copies of a line costs no more.
    """
    lines = F.array_distinct(
        F.transform(
            F.filter(F.split("text", "\n"), lambda line: ~tx.is_blank(line)), tx.strip_line
        )
    )
    exploded = documents.select(
        "document_id", "file_hash", "source_path",
        F.posexplode(lines).alias("chunk_index", "content"),
    )
    return exploded.select(
        tx.chunk_key(
            F.col("document_id"),
            F.col("file_hash"),
            F.col("chunk_index"),
            settings.index_schema_version,
        ).alias("chunk_id"),
        "document_id",
        "file_hash",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "content",
        F.sha2("content", 256).alias("content_hash"),
        tx.token_count(F.col("content")).cast("long").alias("token_count"),
        "source_path",
    )


def semantic_groups(
    units: DataFrame, p: float = 0.95, vector: str = "embedding"
) -> DataFrame:
    """Group consecutive units of a document; break where the distance to the
    unit before is above the ``p`` percentile of the document's distances.

    ``units`` has document_id, unit_id (integer order) and a vector column.
    """
    placed = ranking.position(units, ["document_id"], "unit_id", "pos")
    paired = ranking.previous(placed, ["document_id"], "pos", {vector: "_before"})
    as_double = lambda c: F.col(c).cast("array<double>")
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )
    norms = F.sqrt(
        dot(as_double(vector), as_double(vector))
        * dot(as_double("_before"), as_double("_before"))
    )
    distance = F.when(
        F.col("_before").isNotNull(),
        F.round(1 - dot(as_double(vector), as_double("_before")) / norms, 6),
    )
    measured = paired.select("document_id", "unit_id", "pos", distance.alias("distance"))
    cuts = ranking.interpolated_percentile(
        measured, ["document_id"], "distance", p, "threshold"
    )
    flagged = measured.join(cuts, "document_id", "left").withColumn(
        "is_break",
        F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)),
    )
    return ranking.running_sum(
        flagged, ["document_id"], "pos", F.col("is_break").cast("long"), "group_id"
    )


# A sentence: up to and with its closing marks.
SENTENCE = r"[^.!?。！？]+[.!?。！？]*"


def semantic_pieces(
    pieces: DataFrame, embedder: Callable[[DataFrame], DataFrame], p: float = 0.95
) -> DataFrame:
    """Cut each piece where neighbouring sentences are far apart: document_id, pos, group_id, content.

    ``pieces`` has document_id, pos and content, ``embedder`` adds ``embedding`` to rows with a content
    column. A group ends where the distance to the next sentence is above the ``p`` percentile
    of the piece's distances, so that each piece has a threshold of its own. Pieces are short: all
    sentences of one are handled in its row. Pieces without a sentence give no row.
    """
    cut = F.filter(F.transform(F.regexp_extract_all("content", F.lit(SENTENCE), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    sentences = pieces.select("document_id", "pos", F.posexplode(cut).alias("at", "content"))
    listed = embedder(sentences).groupBy("document_id", "pos").agg(F.array_sort(F.collect_list(F.struct(
        "at", "content", F.col("embedding").cast("array<double>").alias("v")))).alias("s"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    def distance(a, b):
        norm = F.sqrt(dot(a, a) * dot(b, b))
        return F.when(norm > 0, F.round(1 - dot(a, b) / norm, 6))

    # The distance of each sentence to the one before it (none for the first).
    listed = listed.withColumn("d", tx.once(F.col("s"), lambda s: F.transform(
        s, lambda x, i: F.when(i > 0, distance(x["v"], F.get(s, i - 1)["v"])))))

    def threshold(known):
        spot = F.lit(p) * (F.size(known) - 1)
        low, high = F.get(known, F.floor(spot).cast("int")), F.get(known, F.ceil(spot).cast("int"))
        return low + (high - low) * (spot - F.floor(spot))

    far = tx.once(F.sort_array(F.filter("d", lambda x: x.isNotNull())), threshold)
    breaks = tx.once(far, lambda t: F.filter(F.transform("d", lambda x, i: F.when(x > t, i)), lambda i: i.isNotNull()))
    groups = tx.once(F.concat(F.array(F.lit(0)), breaks), lambda b: F.transform(b, lambda first, g: F.slice(
        "s", first + 1, F.coalesce(F.get(b, g + 1), F.size("s")) - first)))
    texts = F.transform(groups, lambda own: F.array_join(F.transform(own, lambda x: x["content"]), " "))
    return listed.select("document_id", "pos", F.posexplode(texts).alias("group_id", "content"))


def semantic_chunks(
    documents: DataFrame, embedder: Callable[[DataFrame], DataFrame], settings: Settings = DEFAULTS,
    p: float = 0.95, partitions: int | None = None,
) -> DataFrame:
    """Pieces of twice the chunk size, cut by meaning, then by size (with overlap).

    ``documents`` has document_id and text. Where the embedder fails, texts are split by size alone.
    """
    parts = documents.select(
        "document_id", F.lit(0).alias("part_index"), F.col("text").alias("content")
    ).where(~tx.is_blank(F.col("content")))
    coarse = with_positions(split_documents(parts, settings, 2 * settings.chunk_size, partitions))
    try:
        found = cut_lineage(semantic_pieces(coarse.select("document_id", "pos", "content"), embedder, p), "semantic")
    except Exception:  # the embedder is a plug-in: whatever it raises, the texts are still split
        found = with_positions(split_documents(parts, settings, partitions=partitions)).withColumn("group_id", F.lit(0))
    order = Window.partitionBy("document_id", "span").orderBy("pos", "group_id")
    spans = found.withColumn("span", F.floor(F.col("pos") / 4096))
    sized = spans.groupBy("document_id", "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("document_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.select("document_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    texts = spans.withColumn("row", F.row_number().over(order) - 1).join(sized, ["document_id", "span"]).select(
        "document_id", (F.col("offset") + F.col("row")).cast("int").alias("part_index"), "content")
    return with_positions(split_documents(texts, settings))
