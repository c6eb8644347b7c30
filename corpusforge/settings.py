"""All knobs in one frozen record that is passed explicitly; its fingerprint covers every field by construction."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import platform


@dataclasses.dataclass(frozen=True)
class Settings:
    top_k: int = 6
    rrf_k: int = 60
    generate_top_n: int = 5
    neighbor_window: int = 0
    context_order: str = "reversed"
    prompt_variant: str = "base"
    exclude_diagrams: bool = False
    max_rewrites: int = 1
    type_routing: bool = True
    version_filter: bool = True
    team_routing: bool = False
    hyde: bool = False
    hyde_mode: str = "full"
    rerank: bool = False
    verify_grounding: bool = False
    chunk_size: int = 800
    chunk_overlap: int = 100
    min_chunk_chars: int = 30
    parent_size: int = 800
    parent_overlap: int = 100
    child_size: int = 300
    child_overlap: int = 30
    semantic_percentile: float = 95.0
    semantic_max_chars: int = 800
    seed_match_ratio: float = 0.7
    max_sub_questions: int = 3
    max_query_chars: int = 200
    max_hypothetical_chars: int = 500
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    table_marker: str = "[table: {n}]"
    diagram_marker: str = "[diagram: {n}]"
    archived_prefix: str = "[archived {version}] "
    context_separator: str = "\n---\n"

    def fingerprint(self) -> str:
        return hashlib.md5(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()

    def run_fingerprint(self, spark_version: str, models: dict[str, str] | None = None, manifest: dict | None = None) -> dict:
        """What a result file needs to be compared with another: all knobs, versions, host, models and the index it ran on."""
        manifest = manifest or {}
        return {
            "settings": dataclasses.asdict(self),
            "settings_md5": self.fingerprint(),
            "models": dict(models or {}),
            "vector_store": manifest.get("vector_store"),
            "index_chunks_md5": manifest.get("chunks_md5"),
            "n_chunks": manifest.get("n_chunks"),
            "versions": {"spark": spark_version, "python": platform.python_version()},
            "host": {"os": platform.platform(), "machine": platform.machine()},
        }


DEFAULTS = Settings()
