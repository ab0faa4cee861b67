"""Matching vectors to anchors and centroids.

Anchors and centroids are policy, not data: a few dozen rows, given by the
caller.  ``few`` checks that before anything is sent to every task; more than
LIMIT are an error, as they would be no policy any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.kernels import net_fit, unit
from evidentia.functions.vectors import cosine, normalise, squared_distance

#: Rows that may be put into one array and sent to every task.
LIMIT = 4096


def few(df: DataFrame, what: str) -> DataFrame:
    """The rows as one array of structs ``all``, in order; an error if there are more than LIMIT."""
    row = F.struct(*df.columns)
    return df.agg(F.array_sort(F.collect_list(row)).alias("all")).where(F.when(F.size("all") <= LIMIT, F.lit(True)).otherwise(F.raise_error(F.lit(f"too many {what} for one array")).cast("boolean")))


def anchor_similarities(df: DataFrame, vector: str, anchors: DataFrame) -> DataFrame:
    """J-10: ``similar``, an array of (id, polarity, cos) over all anchors (id, polarity, vector).

    One narrow pass: the anchors come as one row, no row is multiplied.
    """
    all_ = F.broadcast(few(anchors.select("id", "polarity", "vector"), "anchors"))
    out = df.crossJoin(all_)
    return out.withColumn("similar", F.transform("all", lambda a: F.struct(a["id"].alias("id"), a["polarity"].alias("polarity"), cosine(F.col(vector), a["vector"]).alias("cos")))).drop("all")


def semantic_fit(df: DataFrame, similar: str = "similar", digits: int = 6) -> DataFrame:
    """E-1: best positive and negative cosine, their net fit, and the best anchor (ties go to the lowest id)."""
    side = lambda p: F.filter(similar, lambda s: s["polarity"] == p)
    best = lambda xs: F.array_max(F.transform(xs, lambda s: s["cos"]))
    first = F.array_min(F.transform(side("positive"), lambda s: F.struct((-F.round(s["cos"], digits)).alias("c"), s["id"].alias("id"))))
    pos, neg = F.coalesce(best(side("positive")), F.lit(0.0)), F.coalesce(best(side("negative")), F.lit(0.0))
    return df.withColumns({"pos_max": pos, "neg_max": neg, "net_fit": net_fit(pos, neg), "best_anchor": first["id"]})


def nearest_centroids(df: DataFrame, vector: str, centroids: DataFrame, digits: int = 9) -> DataFrame:
    """J-11: nearest and second centroid (ties to the lowest id), squared distances, membership d2 / (d1 + d2)."""
    all_ = F.broadcast(few(centroids.select("id", "vector"), "centroids"))
    near = F.array_sort(F.transform("all", lambda c: F.struct(F.round(squared_distance(F.col(vector), c["vector"]), digits).alias("d"), c["id"].alias("id"))))
    out = df.crossJoin(all_).withColumn("near", near).drop("all")
    d1, d2 = F.col("near")[0]["d"], F.get("near", F.lit(1))["d"]
    membership = F.when(d2.isNull(), F.lit(1.0)).when(d1 + d2 > 0, d2 / (d1 + d2)).otherwise(F.lit(0.5))
    return out.withColumns({"centroid": F.col("near")[0]["id"], "d1": d1, "runner_up": F.get("near", F.lit(1))["id"], "d2": d2, "membership": unit(membership)}).drop("near")


def centroids_of(df: DataFrame, group: str, vector: str, unit_length: bool = True) -> DataFrame:
    """(id, vector): the mean vector of each group.

    Sums run over (group, dimension), so a large group is summed in every task first.
    """
    cells = df.select(group, F.posexplode(vector).alias("dim", "x"))
    means = cells.groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy(F.col(group).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda c: c["m"]).alias("vector"))
    return vectors.withColumn("vector", normalise(F.col("vector"))) if unit_length else vectors


def expand_vocabulary(terms: DataFrame, concepts: DataFrame, least: float = 0.55, cap: int = 25, digits: int = 6) -> DataFrame:
    """J-12, E-16: (concept, term, cos): terms near a concept's centroid, the nearest ``cap`` of each.

    Concepts come as one array; each term row keeps only the concepts it is near to.
    """
    all_ = F.broadcast(few(concepts.select("id", "vector"), "concepts"))
    near = F.filter(F.transform("all", lambda c: F.struct(c["id"].alias("concept"), F.round(cosine(F.col("vector"), c["vector"]), digits).alias("cos"))), lambda x: x["cos"] >= least)
    rows = terms.select(F.col("id").alias("term"), "vector").crossJoin(all_).select("term", F.explode(near).alias("x")).select("x.concept", "term", "x.cos")
    w = Window.partitionBy("concept").orderBy(F.desc("cos"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def merge_vocabulary(seeds: Column, found: Column, cap: int = 80) -> Column:
    """SET-4: sorted union, cut to ``cap``."""
    return F.slice(F.array_sort(F.array_union(seeds, found)), 1, cap)


def anchor_rows(anchors: DataFrame) -> DataFrame:
    """J-13: (id, row, vector): the place of each anchor in the order of ids, counted from 0, which is its row in a matrix; as few as anchors are."""
    all_ = few(anchors.select("id", "vector"), "anchors")
    return all_.select(F.posexplode("all").alias("row", "a")).select("a.id", "row", "a.vector")


def hash_encoder(text: Column, dim: int = 16) -> Column:
    """E-15: a unit vector of the text by hashing, for tests and for records that no encoder has seen; equal texts have equal vectors.

    Cell k comes of the first four bytes of the SHA-256 of the text and k, mapped onto [-1, 1).
    """
    cell = lambda k: F.conv(F.substring(F.sha2(F.concat(text, F.lit(":"), k.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 31)) - 1
    return normalise(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), cell))


def resolve_vectors(wanted: DataFrame, store: DataFrame, id_col: str, encode=None, vector: str = "vector") -> DataFrame:
    """J-1, J-2: each wanted row with its vector and ``source``: stored, encoded or missing.

    ``encode`` (a function from the missing rows to (id, vector)) is asked only about ids that the store lacks.
    """
    found = wanted.join(store.select(id_col, vector), id_col, "left")
    if encode is None:
        return found.withColumn("source", F.when(F.col(vector).isNotNull(), "stored").otherwise("missing"))
    hit = wanted.join(store.select(id_col, vector), id_col).withColumn("source", F.lit("stored"))
    missing = wanted.join(store.select(id_col), id_col, "left_anti")
    return hit.unionByName(missing.join(encode(missing), id_col, "left").withColumn("source", F.when(F.col(vector).isNotNull(), "encoded").otherwise("missing")))


def check_vectors(df: DataFrame, id_col: str, vector: str, dim: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """SRC-7, SNK-6: one row of fault counts: null, not finite, wrong length, not unit, repeated id."""
    v = F.col(vector)
    length = F.size(v) if dim is not None else None
    n2 = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = df.select(id_col, v.isNull().alias("null"), F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("odd"), (length != dim if dim is not None else F.lit(False)).alias("length"), (F.abs(F.sqrt(n2) - 1) > tolerance).alias("unit"))
    counts = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"n_{c}") for c in ("null", "odd", "length", "unit")]
    repeated = df.groupBy(id_col).count().where("count > 1").agg(F.count("*").alias("n_repeated"))
    return rows.agg(*counts).crossJoin(F.broadcast(repeated))  # one row each
