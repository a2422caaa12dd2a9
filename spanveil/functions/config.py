"""Settings of a run, read strictly."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields

from spanveil.functions import fixed

STRATEGIES = ("placeholder", "simulate", "bypass")


def expand(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default}; an unset name without default is empty."""
    known = os.environ if env is None else env
    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}", lambda m: known.get(m[1]) or m[2] or "", text)


@dataclass
class Settings:
    strategy: str = "placeholder"
    thresholds: dict[str, float] = field(default_factory=lambda: dict(fixed.THRESHOLDS))
    allowed: list[str] | None = None
    overrides: dict[str, str] = field(default_factory=dict)
    forced: list[str] = field(default_factory=list)
    dictionary: dict[str, str] = field(default_factory=dict)
    fakes: dict[str, dict[str, str]] = field(default_factory=dict)
    ttl_seconds: int = 1800
    fail_closed: bool = True

    def __post_init__(self) -> None:
        types = set(fixed.ENTITY_TYPES)
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        if unknown := ({*self.thresholds, *self.overrides, *self.forced, *self.dictionary.values(), *(self.allowed or [])} - types) | (set(self.fakes) - set(fixed.SIMULATABLE)):
            raise ValueError(f"unknown types {sorted(unknown)}")
        if any(not 0 <= v <= 1 for v in self.thresholds.values()) or self.ttl_seconds <= 0:
            raise ValueError("thresholds lie between 0 and 1, and the time to live is positive")
        used = [f for pairs in self.fakes.values() for f in pairs.values()]
        if len(used) != len(set(used)) or any(not f.strip() for f in used):
            raise ValueError("each fake stands for one value")

    @classmethod
    def load(cls, values: dict, env: dict[str, str] | None = None) -> Settings:
        """Settings of a parsed file; an unknown key is an error."""
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown keys {sorted(unknown)}")

        def walk(v):
            if isinstance(v, str):
                return expand(v, env)
            if isinstance(v, dict):
                return {walk(k): walk(x) for k, x in v.items()}
            return [walk(x) for x in v] if isinstance(v, list) else v

        return cls(**walk(values))

    @classmethod
    def read(cls, spark, path: str, env: dict[str, str] | None = None) -> Settings:
        """Settings of a JSON file anywhere that Spark can read."""
        import json

        return cls.load(json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())), env)
