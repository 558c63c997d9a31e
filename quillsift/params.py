"""Constants that results depend on, as immutable parameter sets."""

from __future__ import annotations

from dataclasses import dataclass

# Input limits.
QUERY_MAX_CHARS = 4096
DOCSET_NAME_PATTERN = r"^[a-z0-9._-]{1,64}$"
TOKENS_DEFAULT = 4000
TOKENS_CAP = 4000
TOP_K_DEFAULT = 5
TOP_K_MIN = 1
TOP_K_MAX = 20
METADATA_MAX_CHARS = 500
PREVIEW_MAX_BYTES = 120
RERANK_MAX_DOCUMENTS = 40
RERANK_MAX_BYTES = 8192

# Manifest contract, version 1.
SCHEMA_VERSION = 1
MODEL_ID = "jinaai/jina-embeddings-v2-small-en"
VECTOR_DIM = 512
MODEL_ENGINE = "candle"
MODEL_DTYPE = "f16"
TOKENIZER = "default"
MANIFEST_LICENSES = ("MIT", "Apache-2.0", "CC-BY-4.0")

# Archive limits and update freshness.
ARCHIVE_MAX_BYTES = 512 * 1024 * 1024
ARCHIVE_MAX_ENTRY_BYTES = 256 * 1024 * 1024
ARCHIVE_MAX_ENTRIES = 100_000
FRESHNESS_SECONDS = 86_400

# Evaluation stages and gates.
STAGE_CUTOFFS = {
    "dense_at_40": 40,
    "fts_at_40": 40,
    "fused_at_40": 40,
    "mmr_at_5": 5,
    "output_at_5": 5,
}
WILSON_Z = 1.959963984540054
MIN_RECALL = 0.90
MIN_MRR = 0.70
MAX_FALSE_POSITIVE_RATE = 0.10


@dataclass(frozen=True)
class ChunkBudget:
    """Token budget of the chunker."""

    max_tokens: int = 512
    target_tokens: int = 384


@dataclass(frozen=True)
class SearchParams:
    """Ranking, fusion and gate parameters of a search."""

    rrf_k: int = 60
    pool_factor: int = 8
    pool_floor: int = 40
    mmr_lambda: float = 0.7
    url_penalty: float = 0.05
    min_answer_cosine: float = 0.82
    dual_rank1_rrf: float = 0.0331
    confident_cosine: float = 0.845
    metric: str = "l2"
    # Dense queries in half precision, as against a store's vectors.
    half_query: bool = False
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
