"""Column expressions for scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def decay(at: Column, now: str, half_life_hours: Column) -> Column:
    """0.5 ** (age in hours / half life); the future has age zero."""
    age = (F.lit(now).cast("timestamp").cast("double") - at.cast("timestamp").cast("double")) / 3600
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / half_life_hours)


def source_weight(w: Column) -> Column:
    """A weight of 0.1..2.0 scaled to 0..1."""
    return clamp((w - 0.1) / 1.9, 0.0, 1.0)


def cluster_size(n: Column) -> Column:
    """log2(n) / 3, clamped to 0..1: eight sources saturate."""
    return clamp(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 3, 0.0, 1.0)


def interest_multiplier(boost: Column, suppress: Column) -> Column:
    return clamp(1 + 0.5 * boost - 0.8 * suppress, 0.05, 3.0)


def log_odds_z(a: Column, n: Column, b: Column, m: Column) -> Column:
    """z of the half-count log-odds ratio of a of n against b of m."""
    top = F.log((a + 0.5) / (n - a + 0.5)) - F.log((b + 0.5) / (m - b + 0.5))
    return top / F.sqrt(1 / (a + 0.5) + 1 / (n - a + 0.5) + 1 / (b + 0.5) + 1 / (m - b + 0.5))


#: Weights of a profile (fixed values): cluster, source, velocity, discussion.
PROFILES = {"signal": (0.6, 0.4, 0.2, 0.1), "read": (0.3, 0.7, 0.1, 0.2)}


def velocity(stars_per_day: Column, coverage: Column) -> Column:
    """Growth on a signed log scale, by the share of the window that the readings cover; none counts 0."""
    return F.coalesce(F.signum(stars_per_day) * F.log2(1 + F.abs(stars_per_day)) * coverage, F.lit(0.0))


def mechanical(profile: str, cluster: Column, source: Column, repo: Column, growth: Column, discussed: Column, multiplier: Column) -> Column:
    """The whole score of an item in a profile: cluster and source, for repositories growth less the discussion that they had, times the interest multiplier."""
    c, s, v, h = PROFILES[profile]
    return F.round(10 * (c * cluster + s * source + F.when(repo, v * growth - h * discussed).otherwise(0.0)) * multiplier, 6)
