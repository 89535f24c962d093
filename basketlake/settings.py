"""Every tunable of the operators, with the defaults users of the workload expect."""

from __future__ import annotations

from dataclasses import dataclass, field

# Stock codes that are charges, fees or tests rather than merchandise.
ADMIN_CODES = (
    "ADJUST", "ADJUST2", "AMAZONFEE", "B", "BANK CHARGES", "C2", "CRUK", "D", "DOT",
    "GIFT_0001_10", "GIFT_0001_20", "GIFT_0001_30", "GIFT_0001_40", "GIFT_0001_50",
    "M", "PADS", "POST", "S", "SP1002", "TEST001", "TEST002",
)
# Prefix patterns of such codes, matched from the start without regard to case.
ADMIN_PATTERNS = ("^ADJUST", "^AMAZONFEE$", "^BANK CHARGES$", "^GIFT_", "^TEST")

# The behavioural inputs of segmentation and of the anomaly score.
BEHAVIOUR_FEATURES = (
    "recency_days", "frequency_orders", "net_spend", "avg_order_value", "avg_basket_units",
    "purchase_frequency_trend", "variance_interpurchase_gap_days", "return_rate",
    "markdown_affinity_proxy", "seasonal_purchase_concentration",
)

# Segment names from best to worst.
SEGMENT_NAMES = (
    "Champions", "Loyal High Value", "Established", "Developing",
    "Occasional", "At Risk", "Dormant", "Lowest Engagement",
)


@dataclass(frozen=True)
class CleaningSettings:
    admin_codes: tuple[str, ...] = ADMIN_CODES
    admin_patterns: tuple[str, ...] = ADMIN_PATTERNS
    iqr_multiplier: float = 3.0
    quantity_limit: int = 100_000
    price_limit: float = 50_000.0


@dataclass(frozen=True)
class SnapshotSettings:
    churn_days: int = 90
    clv_days: int = 180
    trend_days: int = 90


@dataclass(frozen=True)
class SplitSettings:
    train: float = 0.70
    validation: float = 0.15
    test: float = 0.15
    seed: int = 42
    version: str = "customer-split-v1"


@dataclass(frozen=True)
class ProductSettings:
    markdown_ratio: float = 0.90
    markdown_min_observations: int = 5
    rare_quantile: float = 0.10
    taxonomy_clusters: tuple[int, ...] = (12, 16, 20, 24, 30)
    max_terms: int = 5000
    components: int = 50
    min_cluster_share: float = 0.01
    silhouette_sample: int = 2000
    taxonomy_version: str = "taxonomy-v1"


@dataclass(frozen=True)
class RollingSettings:
    horizon_days: int = 180
    initial_history_days: int = 120
    min_history_days: int = 60
    min_history_orders: int = 2
    bulk_units: int = 10
    high_value: float = 100.0
    folds: int = 5
    bins: int = 10
    catastrophic_r2: float = -0.5
    tweedie_power: float = 1.5


@dataclass(frozen=True)
class SequenceSettings:
    horizon_days: int = 30
    length: int = 20
    max_snapshots: int = 8
    min_events: int = 2


@dataclass(frozen=True)
class SelectionSettings:
    correlation: float = 0.95
    vif: float = 10.0
    top_countries: int = 15
    min_recall: float = 0.70
    auc_tolerance: float = 0.01
    beta: float = 2.0
    anomaly_quantile: float = 0.99


@dataclass(frozen=True)
class RecommenderSettings:
    neighbours: int = 25
    top_k: int = 5
    popular: int = 50
    similarity_digits: int = 9


@dataclass(frozen=True)
class Settings:
    cleaning: CleaningSettings = field(default_factory=CleaningSettings)
    snapshots: SnapshotSettings = field(default_factory=SnapshotSettings)
    split: SplitSettings = field(default_factory=SplitSettings)
    products: ProductSettings = field(default_factory=ProductSettings)
    rolling: RollingSettings = field(default_factory=RollingSettings)
    sequences: SequenceSettings = field(default_factory=SequenceSettings)
    selection: SelectionSettings = field(default_factory=SelectionSettings)
    recommender: RecommenderSettings = field(default_factory=RecommenderSettings)


DEFAULTS = Settings()
