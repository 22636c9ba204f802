"""Declared row types; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()), "doubles": T.ArrayType(T.DoubleType()),
}


def row(**columns: str | T.DataType) -> T.StructType:
    """Row type from column names and short kinds."""
    return T.StructType([
        T.StructField(name, _KINDS[kind] if isinstance(kind, str) else kind)
        for name, kind in columns.items()
    ])


KNOWLEDGE_DOCUMENTS = row(
    document_id="string", source_path="string", file_hash="string", file_size="bigint",
    status="string", chunk_count="bigint", index_schema_version="int",
    embedding_provider="string", embedding_model="string", error_message="string",
)
KNOWLEDGE_CHUNKS = row(
    chunk_id="string", document_id="string", file_hash="string", chunk_index="bigint",
    content="string", content_hash="string", token_count="bigint", source_path="string",
)
CHUNK_VECTORS = row(
    chunk_id="string", document_id="string", embedding="doubles", generation="string"
)
INDEX_STATE = row(
    seq="bigint", active_generation="string", index_schema_version="int",
    embedding_fingerprint="string", corpus_fingerprint="string", updated_at="timestamp",
)
DUPLICATES = row(
    source_path="string", file_hash="string", existing_path="string", batch_id="bigint"
)
RELEVANT = row(source="string", page="int", section="string", evidence="string")
QUESTIONS = row(
    id="string", split="string", category="string", question="string",
    ground_truth="string", relevant_sources=T.ArrayType(RELEVANT),
    answer_keywords="strings", unanswerable="boolean",
)
