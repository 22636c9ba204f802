"""Functions for SQL users: tokeniser, match score and splitter."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS, Settings
from corpuslake.functions import text
from corpuslake.operators.chunking import split_text


def register_sql(spark: SparkSession, settings: Settings = DEFAULTS) -> None:
    """Make ``corpus_tokens``, ``name_match_score`` and ``split_chunks`` known.

    The first two are SQL expressions and stay inside the JVM (the first one splits
    as ``text.tokens`` does); the splitter is a table function on Arrow batches, to be
    called with ``LATERAL``.
    """
    spark.sql(
        r"""
        CREATE OR REPLACE TEMPORARY FUNCTION corpus_tokens(content STRING)
        RETURNS ARRAY<STRING>
        RETURN CASE WHEN rlike(content, r'CJK') THEN flatten(transform(
            regexp_extract_all(lower(content), r'CJK+|[\p{L}\p{N}&&[^INNER]]+', 0),
            w -> CASE WHEN rlike(w, r'^CJK') AND length(w) > 1
                THEN transform(sequence(1, length(w) - 1), i -> substr(w, i, 2))
                ELSE array(w) END))
        ELSE filter(split(lower(content), r'[^\p{L}\p{N}]+'), w -> w <> '') END
        """.replace("CJK", text.CJK).replace("INNER", text.CJK[1:-1])
    )
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION name_match_score(query STRING, name STRING)
        RETURNS DOUBLE
        RETURN CASE
            WHEN length(query) = 0 OR length(name) = 0 THEN 0D
            WHEN query = name THEN 1D
            WHEN contains(query, name) THEN 0.8D + 0.2D * length(name) / length(query)
            WHEN contains(name, query) THEN 0.5D + 0.3D * length(query) / length(name)
            ELSE 0D END
        """
    )
    size, overlap = settings.chunk_size, settings.chunk_overlap

    @F.udtf(returnType="piece_index: int, content: string", useArrow=True)
    class SplitChunks:
        def eval(self, content: str):
            for i, piece in enumerate(split_text(content or "", size, overlap)):
                yield i, piece

    spark.udtf.register("split_chunks", SplitChunks)
