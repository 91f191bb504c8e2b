"""Thresholds and vocabularies of the pipeline as one frozen value."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Parameters; :meth:`from_env` reads ``SCRIPTORIUM_<NAME>``, a bad number falls back to the default."""

    author_match_threshold: float = 0.85
    author_accept_threshold: float = 0.90
    fuzzy_title_threshold: float = 0.85
    content_title_threshold: float = 0.96
    workplace_threshold: float = 0.92
    cohort_share: float = 0.8
    backward_days_error: int = 30
    home_keywords: tuple[str, ...] = ("univ technol borovice", "university of technology in borovice", "utb borovice")
    completion_timeout_s: float = 60.0
    completion_retries: int = 3
    completion_base_delay_s: float = 1.5
    lookup_timeout_s: float = 12.0

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Settings with what the environment overrides; lists are separated by commas."""
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(f"SCRIPTORIUM_{f.name.upper()}")
            if raw is None:
                continue
            kind = type(f.default)
            try:
                given[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw)
            except ValueError:
                continue
        return cls(**given)
