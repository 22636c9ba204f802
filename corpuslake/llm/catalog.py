"""All queries of this subpackage."""

from corpuslake.llm import (  # noqa: F401
    audio_match, decontaminate, hard_negatives, html_extract, jaccard_join, language_id, one_permutation, prefix_trie,
    secret_scan, sentencepiece_bpe, substring_dedup, toxicity, url_filter,
)
from corpuslake.llm.registry import ORACLES, QUERIES  # noqa: F401
