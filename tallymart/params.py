"""Thresholds and tables of the analytics, in one immutable object that transforms take."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

ACTIVE, SOLD = ("nuovo", "visto"), ("scaduto", "venduto_rimosso")
HEALTHY = ("come-nuovo", "buono")
ALL_TIERS = "__all__"
CAR, PHONE = "automobile", "smartphone"


@dataclass(frozen=True)
class Params:
    # Results depend on them.
    target_margin_pct: dict[str, float] = field(default_factory=lambda: {CAR: 15.0, PHONE: 18.0})
    other_margin_pct: float = 15.0
    rounding_step: dict[str, int] = field(default_factory=lambda: {CAR: 50, PHONE: 10})
    other_step: int = 10
    opening_share: float = 0.93
    part_prices: dict[str, dict[str, int]] = field(
        default_factory=lambda: {
            "base": {"schermo-rotto": 290, "batteria-esausta": 70},
            "plus": {"schermo-rotto": 350, "batteria-esausta": 75},
            "pro": {"schermo-rotto": 330, "batteria-esausta": 75},
            "pro-max": {"schermo-rotto": 380, "batteria-esausta": 80},
        }
    )
    car_penalties: dict[str, int] = field(default_factory=lambda: {"frizione": 800, "graffi": 300, "grandine": 1000, "da-rivedere": 500, "spia-motore": 700, "incidentata": 3000, "fuso": 4000})
    phone_factors: dict[str, float] = field(default_factory=lambda: {"come-nuovo": 1.08, "buono": 1.0, "difetti": 0.82, "rotto": 0.55})
    car_factors: dict[str, float] = field(default_factory=lambda: {"buono": 1.0, "difetti": 0.9, "incidentata": 0.6})
    deal_pct: float = 15.0
    suspect_ratio: float = 0.55
    expensive_ratio: float = 1.15
    no_photo_ratio: float = 0.65
    pool_min: int = 3
    sold_min: int = 5
    box_min: int = 4
    sold_stats_min: int = 3
    bands_min: int = 6
    km_min: int = 8
    hold_days: int = 30
    motivated_days: float = 14.0
    motivated_drop_rate: float = 40.0
    stage_limits: dict[str, int] = field(default_factory=lambda: {"valutazione": 7, "contattato": 5, "offerta": 5, "acquistato": 14, "in_vendita": 30})
    owned_stages: tuple[str, ...] = ("acquistato", "in_vendita")
    alert_min_score: int = 55
    alert_min_drop_pct: float = 10.0
    reclassify_above: int = 3
    car_price_bounds: tuple[float, float] = (1000.0, 200_000.0)
    phone_price_floor: float = 50.0

    def overlaid(self, overrides: dict[str, Any]) -> Params:
        """These settings under the overrides that name known ones; unknown keys are ignored."""
        known = {k: v for k, v in overrides.items() if k in self.__dataclass_fields__ and v is not None}
        merged = {k: {**getattr(self, k), **v} if isinstance(v, dict) and isinstance(getattr(self, k), dict) else v for k, v in known.items()}
        return replace(self, **merged)


DEFAULTS = Params()
