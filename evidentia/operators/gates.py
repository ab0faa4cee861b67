"""Gates: rules whose outcome is data.  No row is dropped; codes tell what applied."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """``hard`` gates floor a row's score, soft ones are only told.  A null condition doesn't fire."""

    code: str
    fires: Column
    hard: bool
    weight: float = 1.0


def fired(gates: Sequence[Gate], hard: bool | None = None) -> Column:
    """G-EV: sorted codes of the gates that fire."""
    chosen = [g for g in gates if hard is None or g.hard == hard]
    if not chosen:
        return F.array().cast("array<string>")
    return F.array_sort(F.filter(F.array(*(F.when(F.coalesce(g.fires, F.lit(False)), g.code) for g in chosen)), lambda c: c.isNotNull()))


def verdict(gates: Sequence[Gate]) -> dict[str, Column]:
    """G-EV: hard, soft and passed codes, and whether the row is blocked."""
    hard, soft = fired(gates, True), fired(gates, False)
    every = F.array(*(F.lit(g.code) for g in gates))
    return {"hard_codes": hard, "soft_codes": soft, "passed_codes": F.array_sort(F.array_except(every, F.concat(hard, soft))), "blocked": F.size(hard) > 0}


def integrity_score(gates: Sequence[Gate]) -> Column:
    """Sum of the weights of what fired, within [0, 1]."""
    total = F.lit(0.0)
    for g in gates:
        total = total + F.when(F.coalesce(g.fires, F.lit(False)), F.lit(float(g.weight))).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def integrity_verdict(gates: Sequence[Gate], threshold: float = 0.7, hard_needed: int = 2) -> Column:
    """G-IV: impossible with two hard findings, or with weights that reach the threshold."""
    return (F.size(fired(gates, True)) >= hard_needed) | (integrity_score(gates) >= threshold)


def histogram(df: DataFrame, *codes: str) -> DataFrame:
    """AGG-12: how many rows have each code of some columns of codes; rows alike are counted first, so few arrays are taken apart."""
    alike = df.groupBy(*codes).agg(F.count("*").alias("__rows"))
    return alike.select(F.explode(F.concat(*codes)).alias("code"), "__rows").groupBy("code").agg(F.sum("__rows").alias("n"))


def prevalence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """AGG-6: part of the rows each flag fires on, one scan for all."""
    sums = df.agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags))
    return sums.select("rows", F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).alias("fired")) for f in flags))).alias("x")).select("x.flag", "x.fired", "rows", F.try_divide(F.col("x.fired"), F.col("rows")).alias("share"))


def verdicts(df: DataFrame, id_col: str, gates: Sequence[Gate]) -> DataFrame:
    """G-O8: (id, codes, hard_count, composite) of every row; the composite is the sum of the weights of what fired, within [0, 1]."""
    return df.select(id_col, fired(gates).alias("codes"), F.size(fired(gates, True)).alias("hard_count"), F.round(integrity_score(gates), 6).alias("composite"))


def calibrated_threshold(found: DataFrame) -> DataFrame:
    """G-O9: one row, ``threshold``: above what any row without a hard finding reaches, 0.7 at least."""
    return found.agg(soft_threshold(F.coalesce(F.max(F.when(F.col("hard_count") == 0, F.col("composite"))), F.lit(0.0))).alias("threshold"))


def suspects(found: DataFrame, hard_needed: int = 2) -> DataFrame:
    """G-O10: verdicts with enough hard findings or a composite that reaches the threshold, which is one row sent to all."""
    cut = found.crossJoin(F.broadcast(calibrated_threshold(found)))
    return cut.where((F.col("hard_count") >= hard_needed) | (F.col("composite") >= F.col("threshold")))


def rule_set(found: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """G-O11, G-O13: (code, severity, fired, rows) of each gate, also of those that never fire; one scan."""
    sums = found.agg(F.count("*").alias("rows"), *(F.count_if(F.array_contains("codes", g.code)).alias(g.code) for g in gates))
    cells = F.array(*(F.struct(F.lit(g.code).alias("code"), F.lit("HARD" if g.hard else "SOFT").alias("severity"), F.col(g.code).alias("fired")) for g in gates))
    return sums.select("rows", F.explode(cells).alias("x")).select("x.code", "x.severity", "x.fired", "rows")


def catalogue(found: DataFrame, id_col: str, cap: int = 200) -> DataFrame:
    """G-O12, T-4: the suspects by id; the first ``cap`` are exemplars with their codes, the others ids alone."""
    chosen = suspects(found)
    first = chosen.orderBy(id_col).limit(cap).select(F.col(id_col).alias("__id"))
    told = chosen.join(F.broadcast(first), F.col(id_col) == F.col("__id"), "left")
    shown = F.col("__id").isNotNull()
    return told.select(id_col, shown.alias("exemplar"), F.when(shown, F.col("codes")).alias("codes"), F.when(shown, F.col("hard_count")).alias("hard_count"), F.when(shown, F.col("composite")).alias("composite"))


def orphans(keys: Column, known: Column) -> Column:
    """G-I7: keys that are not known, sorted."""
    return F.array_sort(F.array_except(keys, known))


def soft_threshold(max_soft: Column) -> Column:
    """AGG-22: just above the most that soft findings alone can reach, 0.7 at least."""
    return F.least(F.lit(1.0), F.greatest(max_soft + F.lit(0.001), F.lit(0.7)))


def most_significant(codes: Column, priority: Sequence[str]) -> Column:
    """T-5: the first of the priority list that is among the codes."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, priority)), lambda p: F.array_contains(codes, p)), F.lit(1))


def contract_violations(df: DataFrame, id_col: str, at_most: Sequence[tuple[str, Sequence[str]]] = (), at_least: Sequence[tuple[str, Sequence[str]]] = (), tolerance: float = 1e-6) -> DataFrame:
    """G-C: (id, contract) where a feature is above, or below, the greatest of a group."""
    faults = [F.when(F.col(f) > (F.greatest(*group) if len(group) > 1 else F.col(group[0])) + tolerance, F.lit(f"{f}<=max({','.join(group)})")) for f, group in at_most]
    faults += [F.when(F.col(f) < (F.greatest(*group) if len(group) > 1 else F.col(group[0])) - tolerance, F.lit(f"{f}>=max({','.join(group)})")) for f, group in at_least]
    return df.select(id_col, F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("contract"))


def bound_violations(df: DataFrame, id_col: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """G-R: (id, feature, value) that is null, not finite or out of bounds."""
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for f, (lo, hi) in bounds.items()))
    bad = lambda c: c["value"].isNull() | F.isnan(c["value"]) | ~c["value"].between(c["lo"], c["hi"])
    return df.select(id_col, F.explode(F.filter(cells, bad)).alias("c")).select(id_col, "c.feature", "c.value")
