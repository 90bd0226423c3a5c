"""Thresholds of the drift analysis, as one value that every operator takes."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Params:
    min_cohort: int = 500
    min_mature: int = 1000
    mag_floor: float = 25.0
    confirm_drop: float = 0.20
    creep_mean: float = 8.0
    durable_q: float = 0.50
    recent_years: float = 3.0
    elevated: float = 15.0
    gain_floor: float = 15.0
    replacement_floor: float = 10.0
    extreme_change: float = 50.0
    review_mass_floor: int = 10_000
    bin_days: int = 180
    min_revs: int = 50
    smooth_k: int = 5
    lead_floor: int = 50_000
    anomaly_min: float = 5.0
    growth_ratio: float = 3.0
    churn_anomaly: float = 10.0
    churn_min_bytes: int = 15_000
    rolling_window_months: int = 12
    rolling_tolerance_days: int = 35
    rolling_drop: float = 20.0
    mass_floor: int = 50_000
    neighbor_token_ratio: float = 0.5
    neighbor_byte_ratio: float = 0.8
    survival_hours: int = 48
    lexical_tokens: int = 100
    lexical_ratio: float = 4.0
    claim_similarity: float = 0.9

    #: An exact result is fresh only under the same values of these.
    CONFIRMATION = ("min_cohort", "min_mature", "mag_floor", "confirm_drop", "durable_q", "elevated")
    #: These are told with a result but don't make it stale.
    SWEEP = ("gain_floor", "replacement_floor", "extreme_change", "review_mass_floor")

    def contract(self, names: tuple[str, ...]) -> dict[str, float]:
        own = asdict(self)
        return {k: own[k] for k in names}

    def lines(self) -> list[str]:
        return [f"{f.name}={getattr(self, f.name)}" for f in fields(self)]


DEFAULT = Params()
