"""One settings object, passed to every operator that has a threshold."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LensConfig:
    # cleaning
    currency_shape_rate: float = 0.70
    numeric_rate: float = 0.95
    mixed_rate: float = 0.50
    date_rate: float = 0.95
    mixed_date_rate: float = 0.50
    high_null_rate: float = 0.40
    extreme_iqr: float = 3.0
    exclude_sentinels: bool = False  # True: sentinel words do not count against a cast

    # profiling
    profile_iqr: float = 1.5
    high_cardinality_ratio: float = 0.5
    high_cardinality_min: int = 10
    near_constant: int = 2
    high_missing_pct: float = 50.0
    sample_size: int = 5
    date_text_rate: float = 0.80
    long_text: float = 50.0
    identifier_ratio: float = 0.9
    identifier_min_int: int = 100
    identifier_min_text: int = 50

    # charts
    top_n: int = 10
    missing_rate: float = 0.40
    missing_red_pct: float = 40.0
    missing_amber_pct: float = 10.0
    pair_r: float = 0.40
    heatmap_r: float = 0.50
    pair_min_rows: int = 10
    heatmap_min_rows: int = 5
    chart_iqr: float = 1.5
    outlier_min_rows: int = 4
    low_cardinality: int = 20
    bins: int = 30
    numerics_per_category: int = 2
    numerics_per_datetime: int = 2
    chart_identifier_ratio: float = 0.95
    month_span_days: int = 730
    week_span_days: int = 60
    max_charts: int = 6

    # specs
    min_specs: int = 3
    max_specs: int = 5
    skew_for_median: float = 1.0
    preview_rows: int = 10
    max_insights: int = 5

    # execution
    columns_per_pass: int = 50       # columns in one wide aggregate (generated-code size)
    gram_columns: int = 300          # columns of one block of a Gram matrix
    gram_bytes: int = 64 << 20       # bytes of the Gram matrices that one task adds up
    distinct_rsd: float = 0.008      # relative error of the distinct sketch
    quantile_accuracy: int = 10_000  # percentile sketch size
    sorted_group_rows: int = 1 << 20  # larger groups are not sorted in one task for their quantiles
    frequent_counters: int = 1024    # values that a task counts per column for the most frequent ones
    broadcast_rows: int = 200_000    # a keyed side is broadcast only when counted below this
    density_cells: int = 64          # cells of a density grid in each direction
    density_points: int = 3          # a cell with at most so many rows shows them as points


DEFAULT = LensConfig()
