"""Closed vocabularies and tuning constants."""

from __future__ import annotations

from dataclasses import dataclass

# The vocabularies that notes and extractions may use.
ENTITY_TYPES = ["Project", "Note", "Decision", "Idea", "Person", "Technology", "Meeting", "Agent", "Claim", "Problem", "Constraint", "Pattern", "Service", "Topic", "BoundedContext"]
FRONTMATTER_TYPES = ENTITY_TYPES[:12]
FOLDER_TYPES = {"projects": "Project", "ideas": "Idea", "decisions": "Decision", "people": "Person", "technologies": "Technology", "meetings": "Meeting", "agents": "Agent"}
RELATION_KEYS = ["relates_to", "mentions", "uses", "supports", "contradicts", "supersedes", "created_by"]
RELATION_TYPES = ["RELATES_TO", "MENTIONS", "USES", "SUPPORTS", "CONTRADICTS", "SUPERSEDES", "CREATED_BY", "ADDRESSES", "EXTRACTED_FROM", "PUBLISHES_TO", "SUBSCRIBES_TO", "CALLS_HTTP", "BELONGS_TO"]
EXTRACTED_TYPES = ["Decision", "Idea", "Claim", "Problem", "Constraint", "Pattern", "Technology", "Project", "Service", "Topic", "BoundedContext"]
EXTRACTED_RELATIONS = ["RELATES_TO", "USES", "SUPPORTS", "CONTRADICTS", "ADDRESSES", "SUPERSEDES", "PUBLISHES_TO", "SUBSCRIBES_TO", "CALLS_HTTP", "BELONGS_TO"]
NOTE_KINDS = ["measurement", "report", "task", "runbook", "decision", "doctrine", "idea", "index", "reference", "archive"]
KNOWLEDGE_TYPES = ["Constraint", "Decision", "Problem"]
KNOWLEDGE_RELATIONS = ["RELATES_TO", "ADDRESSES", "SUPPORTS", "CONTRADICTS", "USES", "EXTRACTED_FROM"]
CORRECTION_WORDS = ["correction", "corrected", "correcting", "retraction", "retracted", "retracts", "superseded", "supersedes", "invalidated", "wrong"]
STRICT_FOLDERS = {"technologies": 0.92, "projects/solution_designs": 0.92}
TRACKED_ROUTES = ["/search", "/context", "/note", "/entity", "/graph", "/impact", "/remember", "/proposal", "/proposals", "/promote", "/changes", "/note/update", "/note/undo", "/note/history", "/link"]
SKIPPED_FOLDERS = ["node_modules"]


@dataclass(frozen=True)
class Tuning:
    chunk_chars: int = 1500
    soft_cut: float = 0.6
    candidates: int = 50
    title_candidates: int = 10
    exact_candidates: int = 20
    rrf_k: int = 60
    vector_weight: float = 1.0
    text_weight: float = 1.0
    title_weight: float = 3.0
    exact_weight: float = 3.0
    correction_chars: int = 500
    own_hours: int = 48
    similar_above: float = 0.72
    similar_limit: int = 5
    similar_chars: int = 4000
    rare_tokens: int = 6
    dedup_base: float = 0.85
    doctor_threshold: float = 0.9
    hops: int = 3
    edge_cap: int = 200
    knowledge_cap: int = 30
    title_chars: int = 90
    slug_chars: int = 80
    cyrillic_floor: int = 40
    cyrillic_ratio: float = 0.15
    prompt_chars: int = 14_000
    debounce_ms: int = 500
    quiet_s: int = 180
    retry_s: int = 60


TUNING = Tuning()
