"""Census of a table: coverage, numeric profiles, frequencies, duplicates, rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-1: (field, present, rows, fraction), one scan for all fields."""
    counted = df.agg(F.count("*").alias("rows"), *(F.count(F.col(c)).alias(f"n_{k}") for k, c in enumerate(columns)))
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"n_{k}").alias("present")) for k, c in enumerate(columns)))
    return counted.select("rows", F.explode(cells).alias("x")).select("x.field", "x.present", "rows", F.try_divide(F.col("x.present"), F.col("rows")).alias("fraction"))


def numeric_profile(df: DataFrame, columns: Sequence[str], exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """AGG-2, AGG-3: (field, n, min, max, mean, p25, p50, p75, p95).

    Quantiles by a mergeable sketch, which partial aggregation keeps small;
    ``exact`` gathers distinct values and is for tables of moderate range.
    """
    points = [0.25, 0.5, 0.75, 0.95]
    quantile = (lambda c: F.percentile(c, points)) if exact else (lambda c: F.percentile_approx(c, points, accuracy))
    stats = [F.struct(F.count(c).alias("n"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"), F.avg(c).alias("mean"), quantile(F.col(c).cast("double")).alias("q")).alias(f"s_{k}") for k, c in enumerate(columns)]
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"s_{k}").alias("s")) for k, c in enumerate(columns)))
    out = df.agg(*stats).select(F.explode(cells).alias("x"))
    return out.select("x.field", "x.s.n", "x.s.min", "x.s.max", "x.s.mean", *(F.col("x.s.q")[k].alias(f"p{int(100 * p)}") for k, p in enumerate(points)))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """AGG-4: by falling count, then value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("value"))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """SET-5: (key, side) of keys on one side only; a null key is a key."""
    a, b = left.select(F.col(key).alias("key")), right.select(F.col(key).alias("key"))
    return a.subtract(b).withColumn("side", F.lit("left")).union(b.subtract(a).withColumn("side", F.lit("right")))


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """SET-5: keys on both sides; empty where a split is disjoint."""
    return left.select(F.col(key).alias("key")).intersect(right.select(F.col(key).alias("key")))


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """SRC-6: of rows with the same keys the first in order.

    ``min_by`` over a struct keeps one row per key and task before the shuffle,
    so a key with very many rows costs no more than others.
    """
    names = df.columns
    key = [k if isinstance(k, Column) else F.col(k) for k in keys]
    at = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    kept = df.groupBy(*(k.alias(f"__k{n}") for n, k in enumerate(key))).agg(F.min_by(F.struct(*names), at).alias("__row"))
    return kept.select(*(F.col("__row")[c].alias(c) for c in names))


def reject_report(df: DataFrame, reason: str, order: str, cap: int = 1000) -> tuple[DataFrame, DataFrame]:
    """AGG-5, T-4: counts by reason, and the first ``cap`` rejects in order (a report, not the data)."""
    rejected = df.where(F.col(reason).isNotNull())
    return df.groupBy(F.coalesce(F.col(reason), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n")), rejected.orderBy(order).limit(cap)


def within_reject_rate(df: DataFrame, reason: str, most: float = 0.01) -> DataFrame:
    """AGG-5: one row (rows, rejected, rate, ok)."""
    return df.agg(F.count("*").alias("rows"), F.count(reason).alias("rejected")).select("rows", "rejected", F.coalesce(F.try_divide(F.col("rejected"), F.col("rows")), F.lit(0.0)).alias("rate")).withColumn("ok", F.col("rate") <= most)


def stratified_split(df: DataFrame, id_col: str, stratum: str, seed: str = "split", share: float = 0.25) -> DataFrame:
    """W-9: ``is_val`` for a share of each stratum (one at least where it has two), in order of a seeded hash.

    A stratum's rows are ranked in one window, as labels are few; see ``hash_split`` for large inputs.
    """
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256), F.col(id_col))
    n = F.count("*").over(Window.partitionBy(stratum))
    want = F.when(n >= 2, F.greatest(F.floor(n * F.lit(share)), F.lit(1))).otherwise(F.lit(0))
    return df.withColumn("is_val", F.row_number().over(w) <= want)


def hash_split(df: DataFrame, id_col: str, seed: str = "split", share: float = 0.25) -> DataFrame:
    """The split for any size: each row decides by its own hash, no shuffle."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.withColumn("is_val", unit < share)
