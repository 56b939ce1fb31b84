"""Knobs that change results, passed explicitly; nothing reads a global configuration."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults of the engine's thresholds."""

    signal_window_days: int = 730
    recent_days: int = 90
    min_signals: int = 2
    min_companies: int = 3
    max_ubiquity: float = 0.22
    min_tension_demand: int = 1
    min_tension_supply: int = 1
    min_early_demand: int = 2
    min_early_companies: int = 3
    max_adaptive_companies: int = 6
    theme_limit: int = 25
    min_eligibility: float = 0.50
    min_composite: float = 20.0
    merge_threshold: float = 0.45
    merge_threshold_plain: float = 0.65
    beneficiary_min_relevance: float = 8.0
    beneficiary_cap: int = 60
    momentum_recent_days: int = 30
    momentum_prior_days: int = 90
    min_text_length: int = 50
    chunk_words: int = 400
    chunk_overlap: int = 50


#: Signal types by what they speak for.
DEMAND = ("demand_surge", "capex_increase", "hiring_surge", "technology_adoption", "market_entry")
SUPPLY = ("supply_bottleneck", "inventory_drawdown")
#: Phrases of supply tightness.
CONSTRAINT_PHRASES = (
    "shortage", "allocation", "lead time", "backlog", "fully booked", "sold out", "bottleneck", "constrained", "rationing", "wait list",
    "supply tight", "capacity tight", "order push", "push-out", "push out", "extended lead", "cannot meet demand", "demand exceeds", "supply limited",
)
#: Weight of the first tier that a text matches.
CONSTRAINT_TIERS = (
    (("sold out", "fully booked", "cannot meet demand", "shortage", "rationing", "demand exceeds"), 1.50),
    (("allocation", "lead time", "extended lead"), 1.35),
    (("backlog", "bottleneck", "constrained", "capacity tight", "supply tight", "supply limited"), 1.25),
    (("order push", "push-out", "wait list"), 1.15),
)
