"""Settings of the request pipeline. Frozen: overrides make a new object or are columns, shared state is never changed."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from palimpsest.functions import fixed

MODES = ("FAST", "BALANCED", "MAX", "OFF")
ROUTES = ("human", "agent")


@dataclass(frozen=True)
class Settings:
    # names and defaults are fixed values: files written elsewhere are read with the same meaning
    mode: str = "MAX"
    route_mode: str = "human"
    min_confidence: float = 0.99
    min_savings_pct: float = fixed.LEAST_PERCENT
    min_savings_abs: int = fixed.LEAST_SAVED
    min_encode_tokens: int = fixed.LEAST_REQUEST
    inject_bootstrap: bool = True
    inject_terse_style: bool = True
    terse_style: str = "Reply terse, no preamble/summary. Code/paths/numbers exact."
    fold_history: bool = True
    fold_after_turns: int = 6
    history_style: str = "digest"
    abstractive_threshold_tokens: int = 8000
    seed_dictionary: bool = True
    cache_discount: float = fixed.CACHE_DISCOUNT
    scope: str = "global"

    @property
    def keep(self) -> int:
        """Newest messages that stay verbatim."""
        return 1 if self.mode == "MAX" else self.fold_after_turns

    @property
    def window(self) -> int:
        return fixed.DIGEST_WINDOW.get(self.mode, fixed.DIGEST_WINDOW_OTHERWISE)


def load(text: str | None) -> Settings:
    """Settings from JSON: unknown keys are ignored, a broken file gives the defaults, an unknown mode becomes BALANCED and an unknown route human."""
    try:
        raw = json.loads(text or "{}")
    except ValueError:
        raw = {}
    known = {f.name for f in fields(Settings)}
    out = replace(Settings(), **{k: v for k, v in raw.items() if k in known}) if isinstance(raw, dict) else Settings()
    mode, route = str(out.mode).upper(), str(out.route_mode).lower()
    return replace(out, mode=mode if mode in MODES else "BALANCED", route_mode=route if route in ROUTES else "human")


def save(settings: Settings) -> str:
    return json.dumps({f.name: getattr(settings, f.name) for f in fields(settings)}, indent=1)
