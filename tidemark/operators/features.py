"""The fifty panel features, in five groups, as window expressions of one dense panel.

All windows share one partitioning and order, so the whole panel is one shuffle. Columns of
the input: entity_id, event_time, open, high, low, close, close_raw, volume, and market,
sector and industry (benchmark closes, null where there is none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w

SHORT, MEDIUM, LONG, STRUCTURAL, PIVOT = 10, 20, 60, 252, 5
LEVEL_ATR, UPPER = 0.25, 0.25
PERIODS = {"day": 252, "week": 52, "month": 12}

DECLINE = [
    "peak_to_trough_decline", "decline_duration_bars", "decline_speed", "drawdown_pct", "momentum_deterioration",
    "rs_deterioration_vs_market", "rs_deterioration_vs_sector", "distance_from_historical_high", "lower_low_frequency",
    "downside_momentum_reduction", "volatility_contraction_onset",
]
CONSOLIDATION = [
    "normalized_range_width", "atr", "atr_percentile", "realized_volatility", "volatility_compression", "volume_contraction", "rvol",
    "support_test_count", "resistance_test_count", "failed_breakdown_count", "failed_breakout_count", "higher_low_development",
    "structure_transition",
]
AWAKENING = [
    "volatility_reexpansion", "volume_expansion", "rvol_increase", "range_expansion", "resistance_pressure", "higher_high_frequency",
    "higher_low_frequency", "momentum_improvement", "rs_improvement_vs_market", "rs_improvement_vs_sector", "time_in_upper_range",
]
CONFIRMATION = [
    "resistance_breakout_pct", "breakout_volume_ratio", "acceptance_followthrough", "retest_and_hold", "higher_high_magnitude",
    "rs_alignment_market", "rs_alignment_sector",
]
CONTEXT = [
    "rs_vs_market", "rs_vs_sector", "rs_vs_industry", "market_regime_trend", "market_regime_volatility", "market_regime_drawdown",
    "avg_dollar_volume", "spread_proxy",
]
FEATURES = DECLINE + CONSOLIDATION + AWAKENING + CONFIRMATION + CONTEXT


def feature_panel(panel: DataFrame, *, period: str = "day", short: int = SHORT, medium: int = MEDIUM, long: int = LONG,
                  structural: int = STRUCTURAL, pivot: int = PIVOT) -> DataFrame:
    """entity_id, event_time, close and all features, for every row of the panel."""
    S, M, L, T, V = short, medium, long, structural, pivot  # noqa: N806
    c = F.col
    close, high, low, volume = c("close"), c("high"), c("low"), c("volume")
    year = F.lit(float(PERIODS[period]) ** 0.5)
    out = w.extremes(panel.withColumn("_bar", F.row_number().over(w.history()).cast("double")), "close", T)
    # each step may use what the steps before it made
    steps: list[dict[str, Column]] = [
        {
            "_lr": w.log_return(close), "_tr": w.true_range(high, low, close), "_pct": w.change(close, M),
            "_hi": w.highest(high, M), "_lo": w.lowest(low, M),
            "_vol_m": w.mean(volume, M), "_min_v": w.lowest(close, V), "_low_v": w.lowest(low, V), "_high_v": w.highest(high, V),
            "_rs_m": w.ratio(close, c("market")), "_rs_s": w.ratio(close, c("sector")), "_slope": w.slope(close, M),
            "_mkt_lr": w.log_return(c("market")),
        },
        {
            "_std": w.std(c("_lr"), M), "atr": w.mean(c("_tr"), M), "rvol": w.ratio(volume, c("_vol_m")),
            "lower_low_frequency": w.share(close < w.shift(c("_min_v")), M), "_r": w.shift(c("_hi")), "_s": w.shift(c("_lo")),
            "_slope_rs_m": w.slope(c("_rs_m"), M), "_slope_rs_s": w.slope(c("_rs_s"), M),
        },
        {
            "decline_duration_bars": c("_since_max"),
            "peak_to_trough_decline": w.ratio(c("_after_max") - c("_highest"), c("_highest")),
            "drawdown_pct": w.ratio(close - c("_highest"), c("_highest")),
            "momentum_deterioration": c("_pct") - w.shift(c("_pct"), M),
            "rs_deterioration_vs_market": w.change(c("_rs_m"), T), "rs_deterioration_vs_sector": w.change(c("_rs_s"), T),
            "distance_from_historical_high": w.ratio(close - w.expanding_max(close), w.expanding_max(close)),
            "downside_momentum_reduction": w.shift(c("lower_low_frequency"), M) - c("lower_low_frequency"),
            "volatility_contraction_onset": w.ratio(c("_std"), w.shift(c("_std"), M)),
            "normalized_range_width": w.ratio(c("_hi") - c("_lo"), close),
            "atr_percentile": w.percentile_rank(c("atr"), T),
            "realized_volatility": c("_std") * year,
            "volatility_compression": w.ratio(c("_std"), w.shift(c("_std"), M)),
            "volume_contraction": w.ratio(c("_vol_m"), w.shift(c("_vol_m"), M)),
            "support_test_count": F.when(c("atr").isNotNull(), w.number(w.ratio(F.abs(low - c("_lo")), c("atr")) <= LEVEL_ATR, M)),
            "resistance_test_count": F.when(c("atr").isNotNull(), w.number(w.ratio(F.abs(high - c("_hi")), c("atr")) <= LEVEL_ATR, M)),
            "failed_breakdown_count": w.number((low < c("_s")) & (close > c("_s")), M),
            "failed_breakout_count": w.number((high > c("_r")) & (close < c("_r")), M),
            "higher_low_development": w.ratio(w.slope(c("_low_v"), M), close),
            "structure_transition": w.ratio(c("_slope"), c("atr")),
            "volatility_reexpansion": w.ratio(w.std(c("_lr"), S), w.std(c("_lr"), L)),
            "volume_expansion": w.ratio(w.mean(volume, S), w.mean(volume, L)),
            "rvol_increase": c("rvol") - w.shift(c("rvol"), S),
            "range_expansion": w.ratio(w.mean(c("_tr"), S), w.mean(c("_tr"), L)),
            "resistance_pressure": w.ratio(close - c("_lo"), c("_hi") - c("_lo")),
            "higher_high_frequency": w.share(high > w.shift(c("_high_v")), M),
            "higher_low_frequency": w.share(low > w.shift(c("_low_v")), M),
            "momentum_improvement": c("_pct") - w.shift(c("_pct"), M),
            "rs_improvement_vs_market": w.ratio(c("_slope_rs_m"), c("_rs_m")),
            "rs_improvement_vs_sector": w.ratio(c("_slope_rs_s"), c("_rs_s")),
            "time_in_upper_range": w.share(close >= c("_hi") - UPPER * (c("_hi") - c("_lo")), M),
            "resistance_breakout_pct": w.ratio(close - c("_r"), c("_r")),
            "breakout_volume_ratio": w.ratio(volume, c("_vol_m")),
            "acceptance_followthrough": w.share(close > c("_r"), S),
            "retest_and_hold": w.ratio(w.lowest(low, S) - c("_r"), c("_r")),
            "higher_high_magnitude": w.ratio(c("_hi") - w.shift(c("_hi"), M), w.shift(c("_hi"), M)),
            "rs_alignment_market": w.ratio(c("_slope"), close) * w.ratio(c("_slope_rs_m"), c("_rs_m")),
            "rs_alignment_sector": w.ratio(c("_slope"), close) * w.ratio(c("_slope_rs_s"), c("_rs_s")),
            "rs_vs_market": c("_pct") - w.change(c("market"), M), "rs_vs_sector": c("_pct") - w.change(c("sector"), M),
            "rs_vs_industry": c("_pct") - w.change(c("industry"), M),
            "market_regime_trend": w.ratio(w.slope(c("market"), L), c("market")),
            "market_regime_volatility": w.std(c("_mkt_lr"), M) * year,
            "market_regime_drawdown": w.ratio(c("market") - w.highest(c("market"), T), w.highest(c("market"), T)),
            "avg_dollar_volume": w.mean(c("close_raw") * volume, M),
            "spread_proxy": w.ratio(w.mean(high - low, M), close),
        },
    ]
    for step in steps:
        out = out.withColumns(step)
    out = out.withColumn("decline_speed", w.ratio(c("peak_to_trough_decline"), c("decline_duration_bars")))
    return out.select("entity_id", "event_time", "close", *FEATURES)


def last_vectors(features: DataFrame) -> DataFrame:
    """Each entity's features at the panel's last date; an entity without that bar has nulls."""
    last = features.agg(F.max("event_time").alias("_last"))
    return features.join(F.broadcast(last), F.col("event_time") == F.col("_last")).drop("_last")
