"""Bounded numeric kernels as Column expressions (K-1 to K-23)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp_unit(x: Column) -> Column:
    """K-1: x within [0, 1]; NaN and infinite values are errors, null stays null."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("value is not finite")).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def unit(x: Column) -> Column:
    """K-1 where x is known to be finite: stays in generated code without the guard."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def bounded_log(x: Column, saturation: float) -> Column:
    """K-2: log1p of a count, 1 at saturation and beyond."""
    return unit(F.log1p(F.greatest(x.cast("double"), F.lit(0.0))) / F.log1p(F.lit(float(saturation))))


def inverse_bounded(x: Column, scale: float) -> Column:
    """K-3: 1 at 0, one half at ``scale``."""
    return F.lit(float(scale)) / (F.lit(float(scale)) + F.greatest(x.cast("double"), F.lit(0.0)))


def recency(days: Column, half_life: float) -> Column:
    """K-4: halves every ``half_life`` days; a date ahead counts as today."""
    return F.pow(F.lit(0.5), F.greatest(days.cast("double"), F.lit(0.0)) / F.lit(float(half_life)))


def days_between(earlier: Column, later: Column) -> Column:
    """K-5: signed days."""
    return F.date_diff(later.cast("date"), earlier.cast("date"))


def mean_of(*xs: Column) -> Column:
    """K-6: mean of given columns."""
    total = xs[0]
    for x in xs[1:]:
        total = total + x
    return total / F.lit(float(len(xs)))


def mean_array(xs: Column) -> Column:
    """K-6 over an array; empty gives 0."""
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)).otherwise(F.lit(0.0))


def weighted_mean(values: Column, weights: Column) -> Column:
    """K-7 over two arrays of the same length: the plain mean where all weights are 0, 0 where there are none."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    weighted = F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, weighted / total).otherwise(mean_array(values))


def weighted_mean_agg(value: Column, weight: Column) -> Column:
    """K-7 as an aggregate over rows."""
    return F.when(F.sum(weight) > 0, F.sum(value * weight) / F.sum(weight)).otherwise(F.avg(value))


def noisy_or(xs: Column) -> Column:
    """K-8 over an array: 1 - prod(1 - x)."""
    return F.lit(1.0) - F.aggregate(xs, F.lit(1.0), lambda a, x: a * (F.lit(1.0) - x))


def noisy_or_agg(x: Column) -> Column:
    """K-8 as an aggregate; values of 1 are handled apart, as their logarithm is infinite."""
    left = F.sum(F.when(x < 1, F.log1p(-x)))
    return F.when(F.max(x) >= 1, F.lit(1.0)).otherwise(F.lit(1.0) - F.exp(F.coalesce(left, F.lit(0.0))))


def band_jaccard(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """K-9: overlap of two intervals over their union's hull; inverted intervals are turned round, two equal points give 1."""
    a1, b1, a2, b2 = F.least(lo1, hi1), F.greatest(lo1, hi1), F.least(lo2, hi2), F.greatest(lo2, hi2)
    hull = F.greatest(b1, b2) - F.least(a1, a2)
    inner = F.greatest(F.least(b1, b2) - F.greatest(a1, a2), F.lit(0.0))
    return F.when(hull > 0, inner / hull).otherwise(F.lit(1.0))


def ladder_rank(text: Column, ladder: Sequence[tuple[float, Sequence[str]]], default: float) -> Column:
    """K-10: the highest rank of which any cue is part of the text."""
    steps = [F.when(any_cue(text, cues), F.lit(float(rank))) for rank, cues in ladder]
    return F.coalesce(F.greatest(*steps) if len(steps) > 1 else steps[0], F.lit(float(default)))


def cue_array(cues: Sequence[str]) -> Column:
    return F.array(*map(F.lit, cues))


def cue_count(text: Column, cues: Sequence[str]) -> Column:
    """K-11: how many cues are part of the text."""
    return F.size(F.filter(cue_array(cues), lambda c: F.contains(text, c)))


def any_cue(text: Column, cues: Sequence[str]) -> Column:
    return F.exists(cue_array(cues), lambda c: F.contains(text, c))


def cue_presence(text: Column, cues: Sequence[str], saturation: float) -> Column:
    """K-12."""
    return bounded_log(cue_count(text, cues), saturation)


def affine(x: Column, low: float, high: float) -> Column:
    """K-13: the unit interval mapped onto [low, high]."""
    return F.lit(float(low)) + F.lit(float(high - low)) * unit(x)


def shrink(x: Column, confidence: Column, prior: float = 0.5) -> Column:
    """K-14: towards the prior as confidence falls."""
    return F.lit(float(prior)) + confidence * (x - F.lit(float(prior)))


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """K-15: piecewise linear through rising knots, flat outside."""
    if any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("knots must rise")
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(knots[-1][1])))


def net_fit(positive: Column, negative: Column) -> Column:
    """K-16."""
    return unit((positive - negative + F.lit(1.0)) / F.lit(2.0))


def hash_pick(text: Column, n: int) -> Column:
    """K-17: a number below n from the first 8 bytes of the text's SHA-256."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n)).cast("int")


#: K-18 levels and the least value of each.
INTENSITY = (("HIGH", 0.75), ("GOOD", 0.5), ("FAIR", 0.3))


def intensity(x: Column) -> Column:
    """K-18: the level of a value."""
    out = F.when(x >= INTENSITY[0][1], INTENSITY[0][0])
    for name, least in INTENSITY[1:]:
        out = out.when(x >= least, name)
    return out.otherwise("LOW")


def pick_word(level: Column, seed: Column, pools: Mapping[str, Sequence[str]]) -> Column:
    """K-18: a word of the level's pool, by the seed's hash."""
    out = None
    for name, pool in pools.items():
        word = F.element_at(cue_array(pool), hash_pick(seed, len(pool)) + 1)
        out = F.when(level == name, word) if out is None else out.when(level == name, word)
    return out


def evidence_intensity(hits: Column) -> Column:
    """K-19."""
    return F.least(F.lit(0.85), F.lit(0.35) + F.lit(0.15) * hits)


def article(word: Column) -> Column:
    """K-20: a or an, by the first letter."""
    return F.when(F.lower(F.substring(word, 1, 1)).isin(*"aeiou"), "an").otherwise("a")


def percent(x: Column) -> Column:
    """K-20: whole percent, halves to even."""
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def months_between_ym(start: Column, end: Column) -> Column:
    """K-21: by year and month alone."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def month_span(start: Column, end: Column, days_per_month: float = 30.4375) -> Column:
    """K-22: days over the mean month; overlaps use 30.0 instead."""
    return F.date_diff(end, start) / F.lit(days_per_month)


def duration_text(ms: Column) -> Column:
    """K-23: MM:SS.mmm."""
    whole = ms.cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(whole / 60000), F.floor((whole % 60000) / 1000), whole % 1000)
