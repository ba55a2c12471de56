"""Settings, checked when they are read; nothing else in the package reads files or the environment for them."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from .functions.classify import CATEGORIES, RATING_BINS
from .operators.gate import GateLimits


@dataclass(frozen=True)
class Sampling:
    target: int = 180
    seed: int = 42
    categories: tuple[str, ...] = CATEGORIES
    rating_bins: tuple[tuple[int, int, str], ...] = RATING_BINS
    min_per_cell: int = 3
    max_per_category_share: float = 0.3

    def __post_init__(self) -> None:
        if self.target <= 0 or not 0 < self.max_per_category_share <= 1:
            raise ValueError("the target must be positive and the share within 0 to 1")
        if any(lo >= hi for lo, hi, _ in self.rating_bins):
            raise ValueError("a rating bin is empty")


@dataclass(frozen=True)
class Output:
    max_cases: int = 30
    max_field_bytes: int = 32 << 10
    max_problem_bytes: int = 256 << 10


@dataclass(frozen=True)
class Verification:
    max_cases: int = 50
    timeout_cap_seconds: float = 8.0
    memory_limit_mb: int = 512
    max_solutions: int = 8
    tolerance: float = 1e-6


@dataclass(frozen=True)
class Settings:
    gates: GateLimits = field(default_factory=GateLimits)
    sampling: Sampling = field(default_factory=Sampling)
    output: Output = field(default_factory=Output)
    verification: Verification = field(default_factory=Verification)

    def as_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def load(path: str, environment: Mapping[str, str] | None = None) -> Settings:
    """Settings from a JSON or YAML file; YAML needs the ``yaml`` module."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml  # optional; only files of that kind need it

        return settings(yaml.safe_load(text) or {}, environment)
    return settings(json.loads(text), environment)


def settings(given: Mapping | None = None, environment: Mapping[str, str] | None = None, prefix: str = "SIFTWORKS_") -> Settings:
    """Defaults, overlaid by nested values and then by variables such as ``SIFTWORKS_SAMPLING_TARGET``. Unknown names raise."""
    out = Settings()
    environment = os.environ if environment is None else environment
    for part in fields(Settings):
        now = getattr(out, part.name)
        known = {f.name for f in fields(now)}
        values = dict((given or {}).get(part.name, {}))
        for name in known:
            text = environment.get(f"{prefix}{part.name}_{name}".upper())
            if text is not None:
                old = getattr(now, name)
                values[name] = text.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(text) if isinstance(old, (int, float, str)) else json.loads(text)
        if values.keys() - known:
            raise ValueError(f"unknown settings of {part.name}: {sorted(values.keys() - known)}")
        made = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in values.items()}
        out = replace(out, **{part.name: replace(now, **made)})
    if (given or {}).keys() - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown parts: {sorted(given.keys() - {f.name for f in fields(Settings)})}")
    return out
