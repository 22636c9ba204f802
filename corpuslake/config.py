"""Default settings of the engine, grouped in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # chunking
    chunk_size: int = 384
    chunk_overlap: int = 64
    min_chunk_size: int = 80
    index_schema_version: int = 2
    max_document_mb: int = 50
    # channels
    vector_k: int = 8
    bm25_k: int = 8
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    hybrid_vector_weight: float = 0.70
    vector_weight: float = 0.50
    bm25_weight: float = 0.25
    graph_weight: float = 0.25
    # fusion and rerank
    rrf_k: int = 60
    candidate_k: int = 12
    rerank_top_k: int = 5
    # context
    max_context_tokens: int = 3000
    context_safety_ratio: float = 0.85
    max_context_chunks: int = 5
    max_chunks_per_source: int = 2
    # history
    max_history_messages: int = 10
    history_total_chars: int = 3000
    # knowledge graph
    graph_schema_version: int = 1
    graph_batch_size: int = 6
    graph_batch_chars: int = 6000
    graph_min_confidence: float = 0.60
    graph_entity_k: int = 5
    graph_max_hops: int = 2
    graph_max_relations: int = 50
    # embedding identity
    embedding_provider: str = "hashing"
    embedding_model: str = "md5-64"
    embedding_dims: int = 64
    # vector writes
    ingest_batch_size: int = 128

    @property
    def context_budget(self) -> int:
        return int(self.max_context_tokens * self.context_safety_ratio)

    @property
    def embedding_fingerprint(self) -> str:
        return f"{self.embedding_provider}:{self.embedding_model}"

    def __post_init__(self):
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
        if self.chunk_size < 50:
            raise ValueError("chunk_size must be at least 50")
        if self.rrf_k < 1:
            raise ValueError("rrf_k must be at least 1")
        if not 0.0 <= self.hybrid_vector_weight <= 1.0:
            raise ValueError("hybrid_vector_weight must be between 0 and 1")
        if self.vector_weight + self.bm25_weight + self.graph_weight <= 0:
            raise ValueError("channel weights must sum to more than 0")
        if self.graph_max_hops not in (1, 2):
            raise ValueError("graph_max_hops must be 1 or 2")
        if not 0.0 < self.context_safety_ratio <= 1.0:
            raise ValueError("context_safety_ratio must be in (0, 1]")
        if not 0.0 <= self.graph_min_confidence <= 1.0:
            raise ValueError("graph_min_confidence must be between 0 and 1")
        if self.graph_batch_size < 1 or self.graph_batch_chars < 100:
            raise ValueError("graph batches need at least 1 chunk and 100 characters")


DEFAULTS = Settings()

# They decide which files, types and predicates are accepted.
SUPPORTED_EXTENSIONS = ("txt", "pdf", "md", "docx", "html", "htm")
ENTITY_TYPES = (
    "SYSTEM", "MODULE", "INTERFACE", "REQUIREMENT", "TEST_CASE", "ROLE",
    "ENVIRONMENT", "DOCUMENT", "VERSION", "TERM", "OTHER",
)
PREDICATES = (
    "CONTAINS", "PART_OF", "DEPENDS_ON", "CALLS", "PROVIDES", "IMPLEMENTS",
    "SATISFIES", "VERIFIED_BY", "DEPLOYED_ON", "OWNED_BY", "USES", "RELATED_TO",
)
RESERVED_STEMS = ("CON", "PRN", "AUX", "NUL") + tuple(
    f"{device}{number}" for device in ("COM", "LPT") for number in range(1, 10)
)
# Output texts.
NO_CONTEXT_TEXT = "知识库中没有与该问题相关的信息。"
CITATION_LABEL = "来源"
FILE_LABEL = "文件："
PAGE_LABEL = "页码："
SECTION_LABEL = "章节："
FACTS_LABEL = "图谱事实："
CONTENT_LABEL = "内容："
ROLE_NAMES = (("user", "用户"), ("assistant", "助手"))
NAME_EDGE_PUNCTUATION = "'!?。，.,;:、"
SENTENCE_ENDS = ("。", ".", "！", "！", "?", "？", "\n")
SPLIT_SEPARATORS = (
    "\n\n\n", "\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ", "",
)
