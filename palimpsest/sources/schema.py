"""Schemas of the store and its artifacts, and the configuration they are opened with."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

TURN = "struct<role:string,content:string>"
KINDS = ("round", "fact")

MEMORIES = (
    "id bigint, user_id string, content string, created_at string, salience double, source string, supersedes bigint, "
    f"turns array<{TURN}>, round_key string, kind string, fact string, raw string, subject string, predicate string, object string, "
    "valid_time string, time_mention string, pair_key string, last_accessed string, initial_salience double, embedding array<float>"
)
PREDICTIONS = (
    "run_id string, question_id string, category string, is_abstention boolean, question string, answer string, predicted string, "
    "reader_prompt_tokens bigint, truncated boolean, tokens_dropped bigint, retrieved_ids array<string>, "
    "verdicts array<struct<correct:boolean,judge_hash:string,graded_utc:string>>"
)
BENCHMARK = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, "
    "haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)
LEDGER = "ts string, stage string, system string, projected_usd double, actual_usd double, supersedes_ts string, note string"
REGISTRY = "run_id string, date string, arm string, reader string, n string, score string, clean string, status string, claim string"
META = "key string, value string"
#: What a guard row holds for a stage that is not used.
UNUSED = "none"


@dataclass(frozen=True)
class Config:
    """How a store is written and read. Values out of range are refused."""

    dedup_cosine_threshold: float = 0.95
    top_k: int = 10
    dedup_entropy_gate: float = 2.0
    conflict_resolution: bool = True
    decay_half_life_days: float = 30.0
    decay_floor: float = 0.15
    ranking: str = "score"
    active_only: bool = True
    recall_min_relevance: float = 0.0
    weights: dict = field(default_factory=lambda: {"similarity": 1.0, "recency": 0.0})
    rerank_pool: int = 50
    time_weight: float = 0.05
    dedup_scope: str = "session"
    query_instruction: str = ""
    chunk_tokens: int = 0
    chunk_overlap: int = 64
    render_unit: str = "round+facts"
    render_format: str = "text"

    def __post_init__(self):
        rules = [
            (self.dedup_scope in ("session", "store"), "dedup_scope is session or store"),
            (self.ranking in ("similarity", "score", "rerank"), "ranking is similarity, score or rerank"),
            (self.render_unit in ("turns", "round+facts", "facts"), "render_unit is turns, round+facts or facts"),
            (self.render_format in ("text", "json"), "render_format is text or json"),
            (self.decay_half_life_days > 0, "decay_half_life_days is positive"),
            (0 < self.decay_floor <= 1, "decay_floor lies in (0, 1]"),
            (self.chunk_tokens >= 0 and (not self.chunk_tokens or 0 <= self.chunk_overlap < self.chunk_tokens), "chunk_overlap is less than chunk_tokens"),
            (isinstance(self.rerank_pool, int) and not isinstance(self.rerank_pool, bool) and self.rerank_pool > 0, "rerank_pool is a positive whole number"),
            (set(self.weights) == {"similarity", "recency"} and all(0 <= w < float("inf") for w in self.weights.values()), "weights are similarity and recency, finite and not negative"),
        ]
        for holds, rule in rules:
            if not holds:
                raise ValueError(rule)

    def guard_rows(self) -> list[tuple[str, str]]:
        """What must not change between openings of one store."""
        return [(f.name, str(getattr(self, f.name)) or UNUSED) for f in fields(self) if f.name.startswith(("dedup", "decay", "chunk", "conflict"))]
