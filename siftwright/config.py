"""Settings with partial overrides, and the budget that applies to a call."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from siftwright.operators.packs import BUDGETS


@dataclass(frozen=True)
class Settings:
    token_budget: int = 8000
    mode_budgets: Mapping[str, int] = field(default_factory=lambda: dict(BUDGETS))
    memory_share: float = 0.3
    cache_ttl_seconds: int = 300
    coupling_threshold: int = 50

    def merged(self, overrides: Mapping[str, Any] | None) -> Settings:
        """Known keys with values of the right type and range replace the
        defaults, one by one; anything else leaves them as they are."""
        fresh: dict[str, Any] = {}
        for f in fields(self):
            value = (overrides or {}).get(f.name)
            if f.name == "mode_budgets" and isinstance(value, Mapping):
                fresh[f.name] = {**self.mode_budgets, **{k: v for k, v in value.items() if isinstance(v, int) and v > 0}}
            elif f.name == "memory_share" and isinstance(value, (int, float)) and 0 <= value <= 1:
                fresh[f.name] = float(value)
            elif f.name not in ("mode_budgets", "memory_share") and isinstance(value, int) and value > 0:
                fresh[f.name] = value
        return replace(self, **fresh)


def budget_for(mode: str, settings: Settings, baseline: int, explicit: int | None = None, environment: int | None = None) -> int:
    """Explicit beats environment beats settings; without either, half of the
    baseline, between 1000 and the token budget. The mode's own budget binds
    only the minimal mode."""
    asked = explicit if explicit is not None else environment
    ranker = min(settings.token_budget, max(1000, baseline // 2))
    if asked is not None:
        return min(ranker, asked)
    return min(ranker, settings.mode_budgets[mode]) if mode == "minimal" else ranker
