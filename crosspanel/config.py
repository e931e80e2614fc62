"""Parameters of the engine: lookbacks, thresholds and strategy constants, with their defaults.

Lookbacks count sessions of the panel. The defaults suit daily panels of a few hundred names; the
registered queries use `small()`, which fits the weekly panels derived from the sample tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    min_stocks: int = 150
    beta_window: int = 252
    beta_half_life: float = 126.0
    beta_min: int = 126
    momentum_window: int = 252
    momentum_skip: int = 21
    momentum_min: int = 126
    reversal: int = 21
    vol_window: int = 84
    vol_half_life: float = 42.0
    ou_window: int = 60
    ou_min: int = 30
    ou_half_life: float = 10.0
    regime_window: int = 252
    regime_min: int = 126
    regime_band: float = 0.15
    horizon: int = 21
    decile: float = 0.1
    top_metrics: int = 10
    books: int = 25
    concentration: float = 2.0
    cost_bps: float = 10.0
    sessions_a_year: float = 252.0
    risk_aversion: float = 5.0
    ic: float = 0.03
    z_clip: float = 2.5
    min_weight: float = 0.01
    max_weight: float = 0.10
    sector_cap: int = 10


def small(**changes) -> Params:
    """Parameters for a weekly panel of some tens of names."""
    base = Params(min_stocks=5, beta_window=52, beta_half_life=26.0, beta_min=26, momentum_window=52, momentum_skip=4, momentum_min=26, reversal=4, vol_window=26, vol_half_life=13.0, ou_window=30, ou_min=15, regime_window=52, regime_min=26, horizon=4, books=10, sessions_a_year=52.0, sector_cap=3, top_metrics=3, decile=0.2)
    return replace(base, **changes)
