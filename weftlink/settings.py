"""Settings of an engine run, with defaults that environment variables replace."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Paths and limits; WEFTLINK_<NAME> in the environment sets a field."""

    data: str = "data"
    output: str = "output"
    models: str = "models"
    candidates: int = 50
    negatives: int = 5
    seed: int = 42

    @classmethod
    def load(cls, environment: dict[str, str] | None = None) -> Settings:
        found = os.environ if environment is None else environment
        given = {f.name: found[key] for f in fields(cls) if (key := f"WEFTLINK_{f.name.upper()}") in found}
        return cls(**{k: int(v) if isinstance(getattr(cls, k), int) else v for k, v in given.items()})
