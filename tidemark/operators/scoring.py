"""Composite scores with explicit missing evidence: absent is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import wilson
from .states import mean_available

#: Ramps: value at 0, value at 100, logarithmic.
RAMPS: dict[str, tuple[float, float, bool]] = {
    "pattern_quality": (0, 1, False), "historical_failure": (1, 0, False), "regime_trend": (-0.001, 0.001, False),
    "regime_volatility": (0.45, 0.10, False), "regime_drawdown": (-0.35, 0, False), "dollar_volume": (5e4, 5e6, True),
    "spread_proxy": (0.12, 0.01, False), "volatility_compression": (1.5, 0.5, False), "atr_percentile": (0.9, 0.1, False),
    "range_width": (0.60, 0.05, False), "risk_liquidity": (0, 1, False), "risk_volatility_expansion": (1, 3, False),
    "risk_event_proximity": (90, 0, False), "opportunity_mfe": (0, 0.5, False), "sample_size": (5, 30, False),
    "interval_width": (0.5, 0.05, False), "feature_coverage": (0, 1, False), "weight_coverage": (0, 1, False), "event_clarity": (0, 45, False),
}
#: Shares of the components; fundamental context has none yet.
SHARES = {"pattern_quality": 0.25, "historical_evidence": 0.20, "market_regime": 0.15, "volume_liquidity": 0.10, "volatility_structure": 0.10, "fundamental_context": 0.0, "risk_reward": 0.10}
CONFIDENCE = {"sample_size": 0.30, "interval_width": 0.20, "feature_coverage": 0.20, "weight_coverage": 0.15, "event_clarity": 0.15}
MIN_WEIGHT = 0.85


def ramp(name: str, x: Column) -> Column:
    """0 to 100, clamped; null stays null; a logarithmic ramp has no value at or below 0."""
    low, high, log = RAMPS[name]
    if log:
        x, low, high = F.when(x > 0, F.log10(x)), F.log10(F.lit(float(low))), F.log10(F.lit(float(high)))
    else:
        low, high = F.lit(float(low)), F.lit(float(high))
    return F.when(x.isNotNull(), 100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low))))


def weighted(values: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """Weighted mean over what is known, and the share of weight that is known."""
    total, have = F.lit(0.0), F.lit(0.0)
    for name, v in values.items():
        total = total + F.coalesce(v * weights[name], F.lit(0.0))
        have = have + F.when(v.isNotNull(), F.lit(weights[name])).otherwise(F.lit(0.0))
    return total / F.nullif(have, F.lit(0.0)), have / sum(weights.values())


def score(df: DataFrame) -> DataFrame:
    """Adds the components, risk_level, weight_coverage, composite_score, opportunity, confidence and decision.

    Reads: quality, failures, resolved, sample_size, mean_mfe, features_known, eligible, lost, days_to_event,
    events_covered and the features named in the ramps."""
    c = F.col
    _, high = wilson(c("failures"), c("resolved"))
    low, _ = wilson(c("failures"), c("resolved"))
    shortfall = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("avg_dollar_volume")) / 1e6)
    event_risk = F.when(c("events_covered"), F.coalesce(ramp("risk_event_proximity", c("days_to_event").cast("double")), F.lit(0.0)))
    risks = [ramp("risk_liquidity", F.when(c("avg_dollar_volume").isNotNull(), shortfall)), ramp("risk_volatility_expansion", c("volatility_reexpansion")), event_risk]
    risk = (risks[0] + risks[1] + risks[2]) / 3
    parts = {
        "pattern_quality": ramp("pattern_quality", c("quality")),
        "historical_evidence": ramp("historical_failure", high),
        "market_regime": mean_available([ramp("regime_trend", c("market_regime_trend")), ramp("regime_volatility", c("market_regime_volatility")), ramp("regime_drawdown", c("market_regime_drawdown"))]),
        "volume_liquidity": mean_available([ramp("dollar_volume", c("avg_dollar_volume")), ramp("spread_proxy", c("spread_proxy"))]),
        "volatility_structure": mean_available([ramp("volatility_compression", c("volatility_compression")), ramp("atr_percentile", c("atr_percentile")), ramp("range_width", c("normalized_range_width"))]),
        "fundamental_context": F.lit(None).cast("double"),
        "risk_reward": 100 - risk,
    }
    out = df.withColumns({**parts, "risk_level": risk})
    weights = {k: v / 0.90 for k, v in SHARES.items()}
    composite, coverage = weighted({k: c(k) for k in parts}, weights)
    out = out.withColumn("composite_score", composite).withColumn("weight_coverage", coverage)
    factors = {
        "sample_size": ramp("sample_size", c("sample_size").cast("double")), "interval_width": ramp("interval_width", high - low),
        "feature_coverage": ramp("feature_coverage", c("features_known")), "weight_coverage": ramp("weight_coverage", c("weight_coverage")),
        "event_clarity": F.when(c("events_covered"), F.coalesce(ramp("event_clarity", c("days_to_event").cast("double")), F.lit(100.0))),
    }
    confidence, _ = weighted(factors, CONFIDENCE)
    out = out.withColumn("confidence", confidence).withColumn("opportunity", ramp("opportunity_mfe", c("mean_mfe")))
    decision = (
        F.when(~F.coalesce(c("eligible"), F.lit(False)), "ineligible").when(c("lost"), "lost_eligibility")
        .when(c("risk_level").isNull(), "risk_undetermined").when(c("weight_coverage") < MIN_WEIGHT, "thin_evidence")
        .when(c("opportunity").isNull(), "no_opportunity").when(c("confidence").isNull(), "no_confidence").otherwise("scored"))
    return out.withColumn("decision", decision)
