"""Interval operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlap_pairs(df: DataFrame, key: str, index: str, start: str, end: str, grace: float = 0.0, keep_all: bool = False) -> DataFrame:
    """J-7: pairs (a before b by index) of one key whose intervals overlap by more than ``grace`` days.

    An equi-join on the key, so both sides are partitioned by it once; the range
    condition is part of the join and no pair outlives it.
    """
    a = df.select(F.col(key), F.col(index).alias("a_index"), F.col(start).alias("__as"), F.col(end).alias("__ae"))
    b = df.select(F.col(key).alias("__key"), F.col(index).alias("b_index"), F.col(start).alias("__bs"), F.col(end).alias("__be"))
    meets = (a[key] == b["__key"]) & (F.col("a_index") < F.col("b_index")) & (F.col("__as") < F.col("__be")) & (F.col("__bs") < F.col("__ae"))
    days = F.date_diff(F.least("__ae", "__be"), F.greatest("__as", "__bs"))
    out = a.join(b, meets).select(key, "a_index", "b_index", days.alias("overlap_days"))
    return out if keep_all else out.where(F.col("overlap_days") > grace)


def union_length(intervals: Column) -> Column:
    """AGG-18: total days that an array of (start, end) dates covers; one fold over the sorted array."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("date").alias("upto"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["upto"].isNull() | (x["start"] > acc["upto"])
        add = F.when(fresh, F.date_diff(x["end"], x["start"])).otherwise(F.greatest(F.date_diff(x["end"], acc["upto"]), F.lit(0)))
        return F.struct((acc["total"] + add.cast("long")).alias("total"), F.greatest(acc["upto"], x["end"]).alias("upto"))

    return F.aggregate(F.array_sort(intervals), zero, step, lambda acc: acc["total"])


def interval_type() -> T.DataType:
    return T.ArrayType(T.StructType([T.StructField("start", T.DateType()), T.StructField("end", T.DateType())]))
