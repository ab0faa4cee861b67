"""From features to a score: components, confidence, multipliers, floor and shrink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.kernels import affine, mean_of, shrink, unit

# Component weights, in the order they are summed.
COMPONENT_WEIGHTS = {"skill_match": 0.25, "semantic_fit": 0.30, "career_fit": 0.20, "experience_fit": 0.08, "education_fit": 0.04, "credibility": 0.10, "archetype_fit": 0.03}
# Weights of the behavioural families.
BEHAVIOUR_WEIGHTS = {"availability": 1.5, "responsiveness": 1.5, "engagement": 0.75, "reliability": 1.0, "verification": 0.5}


def component_mean(cells: Sequence[str | Column]) -> Column:
    """AGG-10."""
    return mean_of(*(F.col(c) if isinstance(c, str) else c for c in cells))


def top_breadth(cells: Sequence[str | Column], top: int = 3, least: float = 0.02, exponent: float = 1.0) -> Column:
    """AGG-9: mean of the best ``top`` cells times the share of those above ``least``, to a power."""
    xs = F.array(*(F.col(c) if isinstance(c, str) else c for c in cells))
    best = F.slice(F.sort_array(xs, False), 1, top)
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.lit(float(min(top, len(cells))))
    share = F.size(F.filter(best, lambda x: x > least)) / F.lit(float(min(top, len(cells))))
    return mean * (share if exponent == 1.0 else F.pow(share, F.lit(float(exponent))))


def group_confidence(cells: Sequence[str | Column]) -> Column:
    """AGG-7."""
    return component_mean(cells)


def weighted_confidence(groups: Mapping[str, float]) -> Column:
    """AGG-8: over columns, in the order given."""
    total = sum(groups.values())
    out = F.lit(0.0)
    for c, w in groups.items():
        out = out + F.col(c) * F.lit(float(w))
    return out / F.lit(float(total))


def weighted_sum(raw: Mapping[str, Column], weights: Mapping[str, float] = COMPONENT_WEIGHTS) -> Column:
    """AGG-11: summed in one fixed order, so equal inputs give equal bits."""
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + F.lit(float(w)) * raw[c]
    return out


def behaviour_multiplier(families: Mapping[str, Column], weights: Mapping[str, float] = BEHAVIOUR_WEIGHTS, low: float = 0.6, high: float = 1.0) -> Column:
    """E-3: weighted mean of the families that are known (not null), mapped onto [low, high]; high where none is."""
    value, weight = F.lit(0.0), F.lit(0.0)
    for c, w in weights.items():
        known = families[c].isNotNull()
        value = value + F.when(known, F.lit(float(w)) * families[c]).otherwise(F.lit(0.0))
        weight = weight + F.when(known, F.lit(float(w))).otherwise(F.lit(0.0))
    return F.when(weight > 0, affine(value / weight, low, high)).otherwise(F.lit(float(high)))


def logistics_multiplier(location: Column, notice_days: Column, inverted_salary: Column, low: float = 0.5) -> Column:
    """E-4: factors of location, notice and salary, within [low, 1]."""
    place = F.when(location.isin("hub", "relocatable"), 1.0).when(location == "non_relocatable", 0.8).otherwise(0.55)
    return F.least(F.lit(1.0), F.greatest(F.lit(float(low)), place * notice_fit(notice_days) * F.when(inverted_salary, 0.9).otherwise(1.0)))


def notice_fit(days: Column) -> Column:
    return F.when(days <= 30, 1.0).when(days <= 60, 0.6).otherwise(0.25)


def archetype_adjustment(is_target: Column, confidence: Column, most: float = 0.05) -> Column:
    """E-6."""
    return F.when(is_target, F.lit(float(most)) * confidence).otherwise(F.lit(0.0))


def final_score(base: Column, behaviour: Column, logistics: Column, adjustment: Column, confidence: Column, floored: Column) -> Column:
    """E-5: 0 for a floored row, else shrunk towards one half as confidence falls."""
    return F.when(floored, F.lit(0.0)).otherwise(shrink(unit(base) * behaviour * logistics + adjustment, confidence))
