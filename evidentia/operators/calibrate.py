"""Ranking metrics, splits and the search for weights."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_metrics(df: DataFrame, group: str | None, score: str, tier: str, id_col: str, k: int = 10, relevant: int = 3, digits: int = 6) -> DataFrame:
    """AGG-25: NDCG@k, average precision and P@k of each group.

    Rank and ideal rank are windows within the group; for one group over all
    rows the labelled rows are what bounds it.
    """
    keys = [group] if group else []
    base = df if group else df.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    real = Window.partitionBy(*by).orderBy(F.desc(F.round(score, digits)), F.col(id_col))
    ideal = Window.partitionBy(*by).orderBy(F.desc(tier), F.col(id_col))
    r = base.withColumns({"r": F.row_number().over(real), "i": F.row_number().over(ideal)})
    hit = (F.col(tier) >= relevant).cast("long")
    r = r.withColumn("hits", F.sum(hit).over(real.rowsBetween(Window.unboundedPreceding, 0)))
    gain = F.pow(F.lit(2.0), F.col(tier).cast("double")) - 1
    dcg = lambda at: F.sum(F.when(F.col(at) <= k, gain / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    out = r.groupBy(*by).agg(
        F.round(F.when(dcg("i") > 0, dcg("r") / dcg("i")).otherwise(0.0), digits).alias("ndcg"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(hit == 1, F.col("hits") / F.col("r"))), F.sum(hit)), F.lit(0.0)), digits).alias("map"),
        F.round(F.avg(F.when(F.col("r") <= k, hit.cast("double"))), digits).alias("p_at_k"),
    )
    return out if group else out.drop("__all")


def _partitions(df: DataFrame) -> int:
    """A given number of range partitions is never coalesced, so each branch of a plan sees the same ones."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def composite_metric(ndcg10: Column, ndcg50: Column, map_: Column, p10: Column) -> Column:
    """WS-5."""
    return 0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map_ + 0.05 * p10


def _dcg(tiers: np.ndarray, k: int) -> float:
    t = tiers[:k].astype(float)
    return float(((2.0**t - 1) / np.log2(np.arange(len(t)) + 2)).sum())


def metric_of(scores: np.ndarray, tiers: np.ndarray, relevant: int = 3, ideal: np.ndarray | None = None) -> float:
    """WS-1 to WS-5 for one scoring of labelled rows, given in order of id; ``ideal`` are the tiers in falling order, if known."""
    t = tiers[np.argsort(-scores, kind="stable")]
    ideal = -np.sort(-tiers) if ideal is None else ideal
    ndcg = [_dcg(t, k) / d if (d := _dcg(ideal, k)) else 0.0 for k in (10, 50)]
    hit = t >= relevant
    ap = float((np.cumsum(hit)[hit] / (np.flatnonzero(hit) + 1)).mean()) if hit.any() else 0.0
    return 0.5 * ndcg[0] + 0.3 * ndcg[1] + 0.15 * ap + 0.05 * float(hit[:10].mean() if len(hit) else 0.0)


def floor_weights(w: np.ndarray, least: float = 0.12) -> np.ndarray:
    """WS-11: a point of the simplex with every weight at ``least`` or more (as far as they fit)."""
    least = min(least, 1.0 / len(w))
    return least + (1 - least * len(w)) * w / w.sum()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (held, values) in order as blocks (held, part, at, columns) of 8 bytes a value, column by column."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        held = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        values = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]]
        for side in (False, True):
            if (rows := held == side).any():
                yield pa.RecordBatch.from_pylist([{"held": side, "part": part, "at": at, "columns": [v[rows].tobytes() for v in values]}], _PACKED)
                at += 1


_PACKED = pa.schema([("held", pa.bool_()), ("part", pa.int32()), ("at", pa.int32()), ("columns", pa.list_(pa.binary()))])


def _metrics(packed: DataFrame, weights: np.ndarray, tasks: int) -> list[float]:
    """``metric_of`` for each row of ``weights``; every task takes its share of them over all rows, of which it holds the values alone."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, blocks = set(), {}
        for batch in batches:
            for task, part, at, columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine.add(task)
                blocks[part, at] = columns
        if mine:
            order = sorted(blocks)
            *x, tiers = (np.concatenate([np.frombuffer(blocks[k][c]) for k in order]) for c in range(weights.shape[1] + 1))
            blocks.clear()
            ideal = -np.sort(-tiers)
            for task in mine:
                share = range(task, len(weights), tasks)
                # Summed column by column, so that rows of equal values have equal scores wherever they stand.
                found = [metric_of(sum(w * c for w, c in zip(weights[k], x, strict=True)), tiers, ideal=ideal) for k in share]
                yield pa.RecordBatch.from_arrays([pa.array(share, pa.int32()), pa.array(found, pa.float64())], names=["k", "metric"])

    tasks = min(tasks, len(weights))
    each = packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "part", "at", "columns")
    found = {r.k: r.metric for r in each.repartitionById(tasks, F.col("task")).mapInArrow(measure, "k int, metric double").collect()}
    return [found.get(k, 0.0) for k in range(len(weights))]


def weight_search(labelled: DataFrame, components: Sequence[str], tier: str, id_col: str, is_val: str, draws: int = 2000, seed: int = 7, least: float = 0.12, ridge: float = 0.02) -> DataFrame:
    """E-11: Dirichlet draws over component weights, the best on the training rows, told with its metric on the others.

    The metric of a draw asks for the order of all rows, so the draws are dealt to at most 64 tasks and each task has all
    rows, as 8 bytes a component and tier; the driver has one number a draw.  Result: (component, weight, ablation, train,
    val, stability).
    """
    spark = labelled.sparkSession
    tasks = min(_partitions(labelled), 64)
    rows = labelled.orderBy(id_col).select(F.col(is_val), *(F.col(c).cast("double") for c in (*components, tier)))
    packed = rows.mapInArrow(_pack, "held boolean, part int, at int, columns array<binary>").persist()
    even = np.full(len(components), 1 / len(components))
    drawn = np.vstack([even, np.random.default_rng(seed).dirichlet(np.ones(len(components)), draws)])
    weights = np.array([floor_weights(d, least) for d in drawn])
    found = [(m - ridge * float(((w - even) ** 2).sum()), w) for m, w in zip(_metrics(packed.where(~F.col("held")), weights, tasks), weights, strict=True)]
    best = (-math.inf, even)
    for m, w in found:
        if m > best[0]:
            best = (m, w)
    top = np.mean([w for _, w in sorted(found, key=lambda f: -f[0])[:20]], axis=0)
    w = best[1]
    stability = float(w @ top / (np.linalg.norm(w) * np.linalg.norm(top)))
    rests = [np.where(np.arange(len(w)) == k, 0, w) for k in range(len(w))]
    held, *ablated = _metrics(packed.where("held"), np.array([w, *(r / r.sum() if r.sum() else w for r in rests)]), tasks)
    packed.unpersist()
    out = [(c, float(w[k]), float(held - ablated[k]), float(best[0]), float(held), stability) for k, c in enumerate(components)]
    return spark.createDataFrame(out, "component string, weight double, ablation double, train double, val double, stability double")


def permutation_importance(df: DataFrame, features: Sequence[str], weights: Sequence[float], tier: str, id_col: str, repeats: int = 5, seed: int = 7, held: int = 10_000_000) -> DataFrame:
    """E-12: how much the rank correlation with the tier falls when one feature's values change rows.

    Each (feature, repeat) moves all values by one permutation of the rows'
    places, place -> (a place + b) mod N with a prime to N, and other a and b for
    each repeat; places are those in the order of a hash of the id.  Up to ``held`` rows, columns are
    packed to 8 bytes a value and go to the tasks of their features, each of which moves its columns in memory; for
    more, values meet by a join on the place (``_moved_by_join``), where no task holds a whole feature.
    """
    score = sum((F.lit(float(w)) * F.col(f) for f, w in zip(features, weights, strict=True)), F.lit(0.0))
    at = F.xxhash64(F.lit(seed), F.col(id_col))
    n = df.count()
    if n > held:
        return _moved_by_join(df, features, weights, tier, id_col, repeats, seed, score, at, n)
    tasks = min(len(features), 24 if n <= 2_000_000 else 48)
    parts = _partitions(df)
    # Hashes are even, so their range is cut evenly: a range partitioning would compute the features once more to sample them.
    rows = df.select(at.alias("at"), F.col(id_col), F.col(tier).cast("double").alias("tier"), score.cast("double").alias("score"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
    rows = rows.withColumn("part", F.least(F.floor((F.col("at") / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1)).cast("int"))
    laid = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "at", id_col).select("part", "score", "tier", "x")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch in enumerate(batches):
            part = batch.column(0).to_numpy()
            score, tiers = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (1, 2))
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1).T
            for p in np.unique(part):
                here = part == p
                columns = [v[here].tobytes() for v in (score, tiers, *x)]
                for task in range(tasks):
                    yield pa.RecordBatch.from_pylist([{"task": task, "part": int(p), "at": at, "columns": [*columns[:2], *columns[2 + task :: tasks]]}], schema)

    schema = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("at", pa.int32()), ("columns", pa.list_(pa.binary()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, dict[tuple[int, int], list[bytes]]] = {}
        for batch in batches:
            for task, part, at, columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks.setdefault(task, {})[part, at] = columns
        for task in list(blocks):
            own = blocks.pop(task)
            order = sorted(own)
            column = lambda c: np.concatenate([np.frombuffer(own[k][c]) for k in order])  # noqa: B023, E731
            score, tiers = column(0), column(1)
            whole, out = _corr(score, tiers), []
            place = np.arange(len(score))
            for c, k in enumerate(range(task, len(features), tasks), 2):
                x, y, found = column(c), np.empty(len(score)), []
                for turn in range(repeats):
                    a, b = _permutation(len(x), seed, features[k], turn)
                    y[(a * place + b) % len(x)] = x
                    found.append(_corr(score + weights[k] * (y - x), tiers))
                known = [c for c in found if c is not None]
                out.append((whole or 0.0) - (sum(known) / len(known) if known else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(features[task::tasks], pa.string()), pa.array(out, pa.float64())], names=["feature", "importance"])

    packed = laid.mapInArrow(pack, "task int, part int, at int, columns array<binary>")
    return packed.repartitionById(tasks, F.col("task")).mapInArrow(measure, "feature string, importance double")


def _corr(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson's r over the rows where both are known; none where it is not defined."""
    both = ~(np.isnan(x) | np.isnan(y))
    if not both.all():
        x, y = x[both], y[both]
    if len(x) < 2:
        return None
    x, y = x - x.mean(), y - y.mean()
    size = math.sqrt(float(x @ x) * float(y @ y))
    return float(x @ y) / size if size else None


def _moved_by_join(df: DataFrame, features: Sequence[str], weights: Sequence[float], tier: str, id_col: str, repeats: int, seed: int, score: Column, at: Column, n: int) -> DataFrame:
    """``permutation_importance`` by a join of every value with the row that it moves to; places are given block by block."""
    laid = df.select(id_col, tier, score.alias("score"), *(F.col(f).cast("double").alias(f) for f in features)).repartitionByRange(_partitions(df), at, id_col).sortWithinPartitions(at, id_col)
    laid = laid.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    parts = laid.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    start = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one short row a partition
    base = laid.join(F.broadcast(parts.select("__part", "__first", start.alias("__start"))), "__part").withColumn("place", F.col("__start") + F.col("__at") - F.col("__first"))
    moves = [_permutation(n, seed, f, turn) for f in features for turn in range(repeats)]
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(float(w)).alias("w"), F.col(f).alias("x")) for f, w in zip(features, weights, strict=True)))
    long = base.select("place", tier, "score", F.explode(cells).alias("c")).select("place", tier, "score", "c.feature", "c.w", "c.x")
    plan = df.sparkSession.createDataFrame([(f, turn, a, b) for (f, turn), (a, b) in zip(((f, t) for f in features for t in range(repeats)), moves, strict=True)], "feature string, turn int, a long, b long")
    own = long.join(F.broadcast(plan.select("feature", "turn")), "feature")  # as many rows as features and repeats
    other = long.select("feature", "place", F.col("x").alias("y")).join(F.broadcast(plan), "feature").select("feature", "turn", F.pmod(F.col("a") * F.col("place") + F.col("b"), F.lit(max(n, 1))).alias("place"), "y")
    moved = own.join(other, ["feature", "turn", "place"]).groupBy("feature", "turn").agg(F.corr(F.col("score") + F.col("w") * (F.col("y") - F.col("x")), F.col(tier).cast("double")).alias("c"))
    whole = base.agg(F.corr("score", F.col(tier).cast("double")).alias("whole"))
    return moved.groupBy("feature").agg(F.avg("c").alias("c")).crossJoin(F.broadcast(whole)).select("feature", (F.coalesce("whole", F.lit(0.0)) - F.coalesce("c", F.lit(0.0))).alias("importance"))


def _permutation(n: int, seed: int, feature: str, turn: int) -> tuple[int, int]:
    """a and b of place -> (a place + b) mod n, which reaches every place once; a times n stays within a long."""
    rng = np.random.default_rng([seed, turn, *feature.encode()])
    if n < 3:
        return 1, int(rng.integers(0, max(n, 1)))
    while True:
        a = int(rng.integers(2, min(n, 1 << 31)))
        if math.gcd(a, n) == 1 or n <= 6:
            return (a if math.gcd(a, n) == 1 else 1), int(rng.integers(0, n))


def kmeans(df: DataFrame, vector: str, k: int = 10, seed: int = 7, runs: int = 1) -> tuple[DataFrame, DataFrame]:
    """E-10, W-10: rows with ``cluster``, and (id, vector, size, inertia) with unit centroids numbered in lexicographic order."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    points = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    models = [KMeans(featuresCol="__v", predictionCol="__c", k=k, seed=seed + r).fit(points) for r in range(runs)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda j: centres[j])
    number = {j: n for n, j in enumerate(order)}
    mapping = F.create_map(*[F.lit(x) for j, n in number.items() for x in (j, n)])
    rows = model.transform(points).withColumn("cluster", mapping[F.col("__c")]).drop("__v", "__c")
    unit = [[x / (math.sqrt(sum(y * y for y in centres[j])) or 1.0) for x in centres[j]] for j in order]
    sizes = [model.summary.clusterSizes[j] for j in order]
    return rows, spark.createDataFrame([(n, unit[n], int(sizes[n]), float(model.summary.trainingCost)) for n in range(len(order))], "id int, vector array<double>, size long, inertia double")


def fingerprint(df: DataFrame, cluster: str, features: Sequence[str], top: int = 12) -> DataFrame:
    """AGG-26: of each cluster the features that deviate most from the whole, and its size."""
    cells = df.select(cluster, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("c")).select(cluster, "c.feature", "c.x")
    each = cells.groupBy(cluster, "feature").agg(F.avg("x").alias("mean"), F.count("*").alias("size"))
    whole = cells.groupBy("feature").agg(F.avg("x").alias("whole"))
    dev = each.join(whole, "feature").withColumn("deviation", F.round(F.col("mean") - F.col("whole"), 6))
    return dev.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(F.abs("deviation")), "feature"))).where(F.col("rank") <= top)


def curve_knots(values: Sequence[float], low: float = 0.0, high: float = 1.0) -> list[tuple[float, float]]:
    """E-13: knots at the given rising values with bounded outputs that never fall."""
    xs = sorted({float(v) for v in values})
    n = max(len(xs) - 1, 1)
    return [(x, low + (high - low) * k / n) for k, x in enumerate(xs)]


def identity_curve(n: int = 17) -> list[tuple[float, float]]:
    """CAL-2."""
    return [(k / (n - 1), k / (n - 1)) for k in range(n)]


def is_monotone(knots: Sequence[tuple[float, float]]) -> bool:
    """CAL-3."""
    return all(a[1] <= b[1] for a, b in zip(knots, knots[1:], strict=False))


def inversions(df: DataFrame, before: str, after: str) -> DataFrame:
    """CAL-8: one row with how many values of ``before`` have a row below the highest ``after`` of all lower values.

    A curve that keeps neighbours in order keeps all pairs in order, so no pairs are made.  The values are range-partitioned;
    the highest of each partition, one short row each, tells what the partitions before it have reached.
    """
    least = df.groupBy(F.col(before).alias("x")).agg(F.min(after).alias("lo"), F.max(after).alias("hi"))
    laid = least.repartitionByRange(_partitions(df), "x").withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy("part").agg(F.max("hi").alias("top"))
    reached = parts.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    prev = F.greatest(F.max("hi").over(inner), F.col("earlier"))
    return laid.join(F.broadcast(reached), "part").withColumn("prev", prev).agg(F.count_if(F.col("lo") < F.col("prev")).alias("n"))


def recalibrate_risk(prevalence: DataFrame, budget: float = 0.02, hard: float = 3.0, soft: float = 1.0) -> DataFrame:
    """AGG-23: detector weights; a hard detector that fires on more than the budget is weighed as a soft one."""
    return prevalence.withColumn("weight", F.when((F.col("severity") == "HARD") & (F.col("share") <= budget), hard).otherwise(soft))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """AGG-24."""
    return df.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"), F.count("*").alias("n"))
