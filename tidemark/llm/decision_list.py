"""Sequential covering: grows and prunes threshold conjunctions from grouped
counts and gives them as an ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantiles of each feature that serve as thresholds.
QUANTILES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99, 0.995)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bin: int
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return F.coalesce((c > self.threshold) if self.above else (c <= self.threshold), F.lit(False))

    def holds(self, bins: dict) -> bool:
        return bins[self.feature] > self.bin if self.above else bins[self.feature] <= self.bin


Rule = tuple[Condition, ...]


def grouped_counts(labelled: DataFrame, features: list[str], label: str, fold: str) -> tuple[dict, list]:
    """Thresholds per feature and (bins, fold, label, count) groups, counted by Spark.

    What reaches the driver is at most one group per labelled row; callers bound those.
    """
    row = labelled.agg(
        *[F.percentile_approx(f, list(QUANTILES), 10_000).alias(f) for f in features]
    ).first()
    cuts = {}
    for f in features:
        values = sorted({float(x) for x in (row[f] or [])})
        cuts[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]  # midway, for margin on both sides
    bins = [
        sum([(F.col(f) > t).cast("int") for t in cuts[f]], F.lit(0)).alias(f) if cuts[f] else F.lit(0).alias(f)
        for f in features
    ]
    groups = labelled.select(*bins, label, fold).groupBy(*features, label, fold).count().collect()
    return cuts, [({f: r[f] for f in features}, r[fold], r[label], r["count"]) for r in groups]


def learn(
    cuts: dict, groups: list, *, max_rules: int = 24, max_conditions: int = 4,
    min_cover: int = 4, min_precision: float = 0.9, prune_fold: int = 0,
) -> list[Rule]:
    """Rules for label 1, in the order found. Each is grown on the folds other than
    `prune_fold` by FOIL gain, then loses trailing conditions while that does not lower
    (p - n) / (p + n) on the prune fold, and stays if its precision over all rows it
    covers is at least `min_precision`."""
    conditions = [
        Condition(f, above, i, t) for f, ts in cuts.items() for i, t in enumerate(ts) for above in (True, False)
    ]
    rest = sorted(groups, key=lambda g: (sorted(g[0].items()), g[1], g[2]))

    def counts(rule: Rule, rows: list) -> tuple[int, int]:
        p = n = 0
        for bins, _, y, c in rows:
            if all(k.holds(bins) for k in rule):
                p, n = (p + c, n) if y else (p, n + c)
        return p, n

    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow = [g for g in rest if g[1] != prune_fold]
        prune = [g for g in rest if g[1] == prune_fold]
        rule: Rule = ()
        covered = grow
        p0, n0 = counts((), covered)
        while p0 >= min_cover and n0 and len(rule) < max_conditions:
            best, gain = None, 1e-9
            by_bin: dict = {}
            for bins, _, y, c in covered:
                for f, b in bins.items():
                    cell = by_bin.setdefault((f, b), [0, 0])
                    cell[0 if y else 1] += c
            for k in conditions:
                p = n = 0
                for b in range(len(cuts[k.feature]) + 1):
                    if (b > k.bin) == k.above and (cell := by_bin.get((k.feature, b))):
                        p, n = p + cell[0], n + cell[1]
                if p >= min_cover:
                    g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if g > gain:
                        best, gain = k, g
            if best is None:
                break
            rule += (best,)
            covered = [g for g in covered if best.holds(g[0])]
            p0, n0 = counts((), covered)
        if not rule:
            break

        def worth(r: Rule) -> float:
            p, n = counts(r, prune)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) > worth(rule):
            rule = rule[:-1]
        p, n = counts(rule, rest)
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(rule)
        rest = [g for g in rest if not all(k.holds(g[0]) for k in rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        hit = rule[0].column()
        for k in rule[1:]:
            hit = hit & k.column()
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))
