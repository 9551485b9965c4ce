"""Fixed values of the analyses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    min_non_null: int = 20
    confidence: float = 0.70
    id_ratio: float = 0.95
    categorical_levels: int = 20
    ordinal_levels: int = 12
    datetime_share: float = 0.90


@dataclass(frozen=True)
class Exact:
    measures: int = 6
    segments: int = 12
    outliers: int = 5
    robust_z: float = 3.5
    seasonal_cycles: int = 2
    prevalence_rows: int = 30
    group_rows: int = 10
    identity_rows: int = 10
    identity_tolerance: float = 1e-3
    identity_share: float = 0.99
    growth_min_share: float = 0.02
    customers: int = 10
    top_customers: int = 10


@dataclass(frozen=True)
class Scan:
    rho: float = 0.15
    rows: int = 30
    group_rows: int = 10
    levels: tuple[int, int] = (2, 10)
    eta_squared: float = 0.01
    tau: float = 0.10
    cap: int = 50


@dataclass(frozen=True)
class Gate:
    alpha: float = 0.05
    resamples: int = 10_000
    min_rows: int = 20
    family_max: int = 40
    interval_resamples: int = 1_000
    level: float = 0.95
    power: float = 0.8
    seed: int = 20260817
    # metric: (least effect, strong effect)
    bands: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {
            "spearman_rho": (0.10, 0.50),
            "kendall_tau_b": (0.07, 0.35),
            "cliffs_delta": (0.15, 0.47),
            "epsilon_squared": (0.10, 0.50),
            "cramers_v": (0.10, 0.50),
            "relative_change": (0.05, 0.25),
            "mase_reduction": (0.10, 0.40),
        }
    )


#: Order of figures in a report.
STORY_WEIGHTS = {
    "period_change": 90, "margins": 85, "price_volume_mix": 82, "variance_decomposition": 80, "prevalence": 75,
    "segment_growth": 72, "customer_view": 70, "outliers": 66, "rfm": 64, "seasonality": 60, "weighted_means": 60,
    "rates": 58, "concentration": 55, "segment_ranking": 40, "identity": 20, "data_quality": 15,
}

ROLES, EXACT, SCAN, GATE = Roles(), Exact(), Scan(), Gate()
