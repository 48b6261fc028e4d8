"""One frozen set of settings; every operator takes those it needs as parameters with these defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

# Document types by content type, URL patterns that are never followed, dropped query parameters.
DOCUMENT_TYPES = {
    "application/pdf": ".pdf",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
}
SKIP_PATTERNS = [
    r"/Search", r"/rss\.aspx", r"/List\.aspx", r"/MyAccount", r"/Admin", r"login|logout", r"[?&]month=", r"[?&]year=\d{4}",
    r"Calendar\.aspx\?.*(EID|view)=", r"/Facilities", r"translate\.google", r"\.(css|js|ico|woff2?|ttf|eot|map)(\?|$)",
]
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid")
# Kinds in display order.
KINDS = ["page", "document", "sitemap", "other"]


@dataclass(frozen=True)
class Config:
    user_agent: str = "corpusloom/0.1"
    chunk_chars: int = 1200
    chunk_overlap: int = 200
    boilerplate_floor: float = 0.2
    embed_width: int = 768
    embed_batch: int = 32
    frontier_batch: int = 200
    ttl_days: dict[int, int] = field(default_factory=lambda: {0: 7, 1: 7, 2: 30, 3: 180})
    error_hours: int = 6
    gone_days: int = 365
    top_k: int = 8
    per_resource: int = 3
    over_fetch: int = 5
    export_bytes: int = 4 * 1024 * 1024
    stale_minutes: int = 5
    stall_minutes: int = 3
    page_size: int = 50
    rank_constant: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    tick_files: int = 1


    @classmethod
    def from_environment(cls, environment: Mapping[str, str] = os.environ) -> Config:
        """The settings with those of the environment: CORPUSLOOM_CHUNK_CHARS and so on; a value of the wrong kind raises ValueError."""
        found = {}
        for f in fields(cls):
            value = environment.get(f"CORPUSLOOM_{f.name.upper()}")
            if value is not None and f.name != "ttl_days":
                found[f.name] = type(getattr(DEFAULT, f.name))(value)
        return cls(**found)


DEFAULT = Config()
