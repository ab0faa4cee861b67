"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (ordered by a seeded hash).  A document
that starts after ``before`` words of its source gets the virtual finish time

    (round * source_size + before + size) / target

where round counts the passes over the source, so a source whose target is
above its size is taken more than once.  All documents of all sources are then
range-sorted by finish time and taken until the budget, the size of the whole
input, is used up.  All sources finish their targets at time 1 together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored, whole
from .prefix_sums import running_sums

WEIGHTS = (1.0, 2.0, 3.0)
#: No source, and no document, is taken more often than this.
MAX_REPEATS = 3


def mix_targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """The words each source shall have: shares of all sizes by weight, none above ``max_repeats`` times its size.

    What a source can't take goes to the others by weight, until none is above its limit.
    """
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        weight = math.fsum(weights[k] for k in sorted(open_))
        share = {k: left * weights[k] / weight if weight else 0.0 for k in sorted(open_)}
        full = [k for k in sorted(open_) if share[k] > max_repeats * sizes[k]]
        if not full:
            for k, x in share.items():
                targets[k] = x
            break
        for k in full:
            targets[k] = float(max_repeats * sizes[k])
            left -= targets[k]
            open_.remove(k)
    return targets


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 42,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken.

    Ties in the queue end at the shuffle and the id; only rows that share both
    are told apart by where they were read.

    ``weights`` repeat over the sources in code-point order, the null source
    last.  A null text has size 0; documents of size 0 are taken 0 times.  Null
    ids and repeated rows are rows of their own.  An empty table gives an empty
    result.  The driver holds one number per source, as it does for weights.
    """
    sized = stored(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(whole(F.col(text_col)), F.lit(WORD)).cast("long").alias("size"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "mix-sized",
    ).df
    sources = sorted(((r.source, int(r.size)) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    targets = mix_targets([n for _, n in sources], [weights[k % len(weights)] for k in range(len(sources))], max_repeats)
    plan = docs.sparkSession.createDataFrame(
        [(k, s, n, t) for k, ((s, n), t) in enumerate(zip(sources, targets, strict=True))], "no int, source string, source_size long, target double"
    ).coalesce(1)
    planned = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select("row", "id", "size", "no", "source_size", "target")
    shuffled = planned.where("size > 0").select("no", F.xxhash64(F.lit(seed), F.col("id")).alias("shuffle"), "id", "row", "size", "source_size", "target")
    queued = running_sums(shuffled, ["no", "shuffle", "id", "row"], "size", within="no", label="mix-queue")
    turns = queued.select("row", "no", "shuffle", "id", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: (k * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target"))).alias("finish"))
    budget = sum(n for _, n in sources)
    taken = running_sums(turns, ["finish", "no", "shuffle", "id", "row"], "size", label="mix-turns").where(F.col("before") + F.col("size") <= budget).groupBy("row").agg(F.sum("size").alias("taken"))
    return planned.join(taken, "row", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each input row as often as it is taken, with all its columns.

    A row is found again by its id, which should be unique.  Rows that share an
    id, or have none, are each repeated as often as the most often taken of
    them.  Texts without words, null ones among them, have size 0 and are taken
    0 times, so they go.  An empty table stays empty.
    """
    times = mix_sources(docs, id_col, **options).where("taken > 0").groupBy(F.col(id_col).alias("__mix_id")).agg(F.expr("int(max(taken div size))").alias("__mix_times"))
    found = docs.where(F.regexp_like(whole(F.col(options.get("text_col", "text"))), F.lit(WORD))).join(times, F.col(id_col).cast("long").eqNullSafe(F.col("__mix_id")))
    return found.withColumn("__mix_turn", F.explode(F.sequence(F.lit(1), F.col("__mix_times")))).drop("__mix_id", "__mix_times", "__mix_turn")
