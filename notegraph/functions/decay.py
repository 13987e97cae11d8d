"""Decay and vitality as column expressions; ``as_of`` is always explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(a: Column, b: Column) -> Column:
    """Absolute difference in days as a double; null if either is null."""
    micros = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    return F.abs(micros) / F.lit(86_400e6)


def simple_decay(days: Column, base: float = 1.0, decay_days: float | Column = 30.0) -> Column:
    """``base * exp(-days / decay_days)`` within 0..base; ``base`` where decay_days is not positive; null for null."""
    span = decay_days if isinstance(decay_days, Column) else F.lit(float(decay_days))
    decayed = F.lit(float(base)) * F.exp(-days / F.when(span > 0, span))
    return F.when(span <= 0, F.lit(float(base))).when(days.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(float(base)), decayed)))


def decay_days_of(kind: Column, days: dict[str, float], default: float = 30.0) -> Column:
    """The decay of a note's type; types without one of their own, or with 0, have the default."""
    out = F.lit(float(default))
    for name, value in days.items():
        out = F.when(kind == name, float(value)).otherwise(out) if value else out
    return out


def access_base(count: Column, lifetime: Column, d: float = 0.5) -> Column:
    """Activation from use: 0.5 for never used, 1 for age 0, else the logistic of ``ln(n / (1 - d)) - d ln L``."""
    d = min(0.99, max(0.01, d))
    x = F.ln(count / F.lit(1.0 - d)) - F.lit(d) * F.ln(lifetime)
    return F.when(count <= 0, 0.5).when(lifetime <= 0, 1.0).otherwise(1.0 / (1.0 + F.exp(-x)))


def structural_boost(in_degree: Column) -> Column:
    return F.lit(1.0) + F.lit(0.1) * F.least(in_degree, F.lit(10))


def revival(days: Column) -> Column:
    """A spike after a new connection: ``exp(-0.2 d)`` below 14 days, 0 for null, negative or older."""
    return F.when(days.isNull() | (days < 0) | (days >= 14), 0.0).otherwise(F.exp(-0.2 * days))


def saturation(count: Column, k: float = 10.0) -> Column:
    return F.lit(1.0) - F.exp(-count / F.lit(float(k)))


def vitality(count: Column, lifetime: Column, in_degree: Column, is_bridge: Column, boost: Column, since_link: Column | None = None, rate: float = 1.0, d: float = 0.5, k: float = 10.0, floor: float = 0.5) -> Column:
    """Base x structure x saturation, plus revival and boost, floored for bridges, within 0..1.

    Null where the lifetime is unknown and the note was used: such a note is in no zone but the last.
    """
    v = access_base(count, lifetime, d * rate) * structural_boost(in_degree)
    v = v * (F.lit(0.5) + F.lit(0.5) * saturation(count, k))
    v = v + F.lit(0.2) * (revival(since_link) if since_link is not None else F.lit(0.0)) + F.coalesce(boost, F.lit(0.0))
    v = F.when(v.isNotNull() & is_bridge, F.greatest(v, F.lit(floor))).otherwise(v)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def zone(vitality: Column, status: Column, active: float = 0.6, stale: float = 0.3, fading: float = 0.1) -> Column:
    """The zone of a vitality; null vitality and status ``archived`` are archived."""
    return (
        F.when(status == "archived", "archived").when(vitality >= active, "active").when(vitality >= stale, "stale").when(vitality >= fading, "fading").otherwise("archived")
    )


def decayed_boost(boost: Column, days: Column, rate: float = 0.1) -> Column:
    return boost * F.exp(F.lit(-rate) * days)
