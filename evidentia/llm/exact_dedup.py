"""Exact duplicates by content sort.

Rows are range-partitioned by sampled splitters over the normalised text, each
partition is sorted (Spark's external sort, which spills), so that equal texts
are adjacent, and one pass compares each text in full with its neighbour.

A splitter is bounded: the text's first PREFIX characters, its digest, its
rank within its group.  The last part lets a group of any size run on over as
many partitions as it needs, so no group lands in one task.  A group that
crosses a partition's edge is joined up afterwards from the first and last run
of each partition: at most two short rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, stored, whole, without_white

PREFIX = 64

_RUNS = "id long, text_sha256 string, n_chars int, keep_id long, group_size long, kept boolean, edge boolean, part int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to rows with their run's keeper and size; the first and last run of the partition are marked."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("id", pa.int64()), ("text_sha256", pa.string()), ("n_chars", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()), ("edge", pa.bool_()), ("part", pa.int32())])
    run: list = []
    text = sha = None
    first = True
    out: list[list] = [[] for _ in schema]

    def close(last: bool) -> None:
        nonlocal first
        n = len(run)
        for to, values in zip(out, ([r[0] for r in run], [sha] * n, [r[1] for r in run], [run[0][0]] * n, [n] * n, [True] + [False] * (n - 1), [first or last] * n, [part] * n), strict=True):
            to.extend(values)
        first = False

    for batch in batches:
        for i, t, s, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if run and t != text:
                close(False)
                run = []
            text, sha = t, s
            run.append((i, n))
        if len(out[0]) >= 20_000:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
            out = [[] for _ in schema]
    if run:
        close(True)
    if out[0]:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; of equal
    texts the longest original stays, then the smallest id.  A null text counts
    as empty, so empty, blank and null texts are one group.  A null id loses
    against any other.  Repeated rows are rows of their own: exactly one row of
    a group is kept, also if all have the same id.  An empty table gives an
    empty result.  Other columns are ignored, whatever their names.
    """
    text = whole(F.col(text_col))
    norm = without_white(text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"), F.char_length(text).alias("n_chars")).withColumn("sha", F.sha2("norm", 256))
    order = [F.substring("norm", 1, PREFIX), F.col("sha"), F.col("n_chars").desc(), F.col("id").asc_nulls_last()]
    laid_out = rows.repartitionByRange(*order).sortWithinPartitions(order[0], order[1], F.col("norm"), *order[2:])
    runs: Stored = stored(laid_out.select("id", F.col("norm").cast("binary"), "sha", "n_chars").mapInArrow(_runs, _RUNS), "exact-runs")
    heads = runs.df.where("edge and kept").select("text_sha256", "group_size", F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("none"), "id", "part").alias("head"))
    # Two rows a partition at most, whatever the input: small enough to send to all.
    joined = heads.groupBy("text_sha256").agg(F.min("head").alias("best"), F.sum("group_size").alias("total"), F.count("*").alias("n")).where("n > 1").select("text_sha256", F.col("best.id").alias("best_id"), F.col("best.part").alias("best_part"), "total")
    over_edge = F.col("total").isNotNull()
    return runs.df.join(F.broadcast(joined), "text_sha256", "left").select(
        F.col("id").alias(id_col),
        F.when(over_edge, F.col("best_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("total", "group_size").alias("group_size"),
        (F.col("kept") & (~over_edge | (F.col("part") == F.col("best_part")))).alias("kept"),
        "text_sha256",
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows whose text is the one kept of its group, with all their columns.

    A row is found again by its id and normalised text, so of rows that repeat
    both, one stays.  Null ids match null ids.
    """
    key, sha = "__dedup_id", "__dedup_sha"
    id_key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = whole(F.col(text_col))
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(id_key.alias(key), F.col("text_sha256").alias(sha))
    keyed = docs.withColumns({key: id_key, sha: F.sha2(without_white(text), 256)})
    # The semi-join leaves the rows by (key, sha), so the last step needs no further exchange.
    return keyed.join(kept, [key, sha], "left_semi").dropDuplicates([key, sha]).drop(key, sha)
