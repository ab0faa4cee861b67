"""Running sums over a global order, in parallel.

Rows are range-partitioned and sorted; each partition sums its own rows, and
the totals of the partitions, a few short rows each, give where each starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored


def running_sums(rows: DataFrame, order: list[str], size: str, within: str | None = None, label: str = "sums") -> DataFrame:
    """``rows`` with ``before``: the sum of ``size`` over the rows that come earlier in ``order``.

    ``within`` (an int column, first in ``order``) restarts the sum with each of
    its values.  A value with many rows runs on over several partitions.  The
    order must be total, or reruns differ.  An empty table stays empty.
    """
    group = within or "__all"
    if not within:
        rows = rows.withColumn(group, F.lit(0))
    cols: list[Column] = [F.col(c) for c in order]
    sorted_rows = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    at_group, at_size = sorted_rows.columns.index(group), sorted_rows.columns.index(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, so_far = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(at_group).to_numpy(zero_copy_only=False)
            n = batch.column(at_size).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(n)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            base = np.repeat(total[starts] - n[starts], np.diff(np.r_[starts, len(g)]))
            local = total - n - base
            if g[0] == current:
                local[: starts[1] if len(starts) > 1 else len(g)] += so_far
            current, so_far = g[-1], int(local[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64()), pa.array(np.full(len(g), part, np.int32))], names=[*batch.schema.names, "__local", "__part"])

    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("__local", T.LongType()), T.StructField("__part", T.IntegerType())])
    laid = stored(sorted_rows.mapInArrow(sums, schema), label).df
    # As many rows as partitions and groups together.
    totals = laid.groupBy(group, "__part").agg(F.sum(size).alias("__total"))
    order_parts = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, "__part", F.coalesce(F.sum("__total").over(order_parts), F.lit(0)).alias("__start"))
    out = laid.join(F.broadcast(starts), [group, "__part"]).withColumn("before", F.col("__local") + F.col("__start")).drop("__local", "__part", "__start")
    return out if within else out.drop(group)
