"""Severity, tier and weight rules. The numbers are fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights of the kinds of shared entities, points and order of severities, bounds of the tiers.
WEIGHTS = {"instruments": 4.0, "devices": 3.0, "merchants": 2.0, "ips": 1.0}
POINTS = {"HIGH": 25, "MEDIUM": 12, "LOW": 5}
ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
TIERS = (0.60, 0.35)
AT_LEAST = {"sharing": (5, 3, 2), "ip": (8, 4, 2), "merchant": (6, 3, 2)}


def steps(value: Column, bounds, names=("HIGH", "MEDIUM", "LOW"), test="__ge__") -> Column:
    """The name of the first bound that `value` meets; null if it meets none."""
    out = F.lit(None).cast("string")
    for bound, name in reversed(list(zip(bounds, names))):
        out = F.when(getattr(value, test)(bound), name).otherwise(out)
    return out


def tier(risk: Column) -> Column:
    return F.coalesce(steps(F.coalesce(risk, F.lit(0.0)), TIERS, ("HIGH", "MEDIUM")), F.lit("LOW"))


def by_severity(severity: Column, values: dict) -> Column:
    return F.coalesce(*(F.when(severity == k, v) for k, v in values.items()))


def temporal_multiplier(days: Column) -> Column:
    """1.0 without common days, a quarter more for each, 2.0 at most."""
    return F.when(days <= 0, F.lit(1.0)).otherwise(F.least(F.lit(2.0), 1.0 + 0.25 * days))


def evidence_weight(counts: dict[str, Column], days: Column) -> Column:
    total = sum((F.lit(w) * F.sqrt(counts[k].cast("double")) for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.bround(total * temporal_multiplier(days), 6)


def hub_severity(degree: Column, p50: Column, p75: Column, p95: Column) -> Column:
    return F.when((degree >= p95) & (degree >= 10), "HIGH").when((degree >= p75) & (degree >= 5), "MEDIUM").when((degree >= p50) & (degree >= 3), "LOW")
