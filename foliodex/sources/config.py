"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "FOLIODEX_"


@dataclass(frozen=True)
class Settings:
    """What can be set; a variable is the prefix and the name in capitals."""

    search_limit: int = 20
    semantic_threshold: float = 2.0
    semantic_weight: float = 0.5
    keyword_weight: float = 0.5
    embedding_dimensions: int = 64
    extraction_strategy: str = "plain_first"
    retry_failed: bool = False
    chunk_tokens: int = 8_192
    chunk_overlap: int = 50


def settings(environment: Mapping[str, str] | None = None) -> Settings:
    """The defaults, with what the environment sets; 1, true, yes and on are true."""
    environment = os.environ if environment is None else environment
    kinds = {"int": int, "float": float, "str": str, "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on")}
    return Settings(**{f.name: kinds[str(f.type)](environment[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in environment})
