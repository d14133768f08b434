"""Results depend on them."""

RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT = 60.0, 0.65, 0.35
VECTOR_ADMISSION, KEYWORD_ADMISSION, TRIGRAM_THRESHOLD = 0.35, 0.45, 0.3
DEFAULT_TOP_K, MAX_TOP_K, CANDIDATE_FACTOR, MAX_CANDIDATES = 5, 50, 4, 100
CHUNK_SIZE, CHUNK_OVERLAP, MAX_CHUNKS, EMBED_BATCH, MAX_FILE_BYTES = 500, 50, 2000, 32, 10 * 1024 * 1024
LEASE_MINUTES, STALE_MINUTES = 3, 2
SCORE_FLOOR, RAG_BUDGET_TOKENS, TOOL_TOKENS = 0.2, 2000, 60
HISTORY_ROWS, CHARS_PER_TOKEN, DEFAULT_CONTEXT_TOKENS, OUTPUT_RESERVE = 200, 4, 4000, 1000
MAX_WORKFLOW_STEPS, PAGE_DEFAULT, PAGE_MAX = 50, 20, 200
LIMITER_COUNT, LIMITER_MINUTES, BREAKER_FAILURES, BREAKER_SECONDS = 10, 15, 5, 30
#: White space that trimming of contents removes at both ends.
TRIM_CLASS = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
TRIM_CHARS = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def clamp_top_k(k: int) -> int:
    return DEFAULT_TOP_K if k <= 0 else min(k, MAX_TOP_K)


def candidate_k(top_k: int) -> int:
    return min(max(CANDIDATE_FACTOR * top_k, top_k), MAX_CANDIDATES)


def clamp_limit(n: int) -> int:
    return PAGE_DEFAULT if n <= 0 else min(n, PAGE_MAX)
