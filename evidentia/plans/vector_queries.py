"""Queries of vectors, labels and metrics, parity and closure (Q39 to Q46, Q50 to Q56)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import calibrate as C
from evidentia.operators import lineage as N
from evidentia.operators import profile as P
from evidentia.operators import vectors as V
from evidentia.session import load

from .numeric import _FEATURES_SQL, customer_features
from .registry import query

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_COS = f"({_DOT} / ({_NORM} * {_NORM.replace('{a}', '{b}')}))"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """The first vector of each of six labels: the even ones speak for, the odd ones against."""
    first = _vectors(spark, d).where("label < 6").groupBy("label").agg(F.min_by(F.struct("vec_id", "vector"), "vec_id").alias("a"))
    return first.select(F.col("label").alias("id"), F.when(F.col("label") % 2 == 0, "positive").otherwise("negative").alias("polarity"), F.col("a.vector").alias("vector"))


_ANCHORS = "a AS (SELECT label AS id, CASE WHEN label % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity, arg_min(embedding, vec_id) AS vector FROM embeddings WHERE label < 6 GROUP BY 1)"


@query(
    "q39_cosine_topk",
    f"WITH {_ANCHORS}, s AS (SELECT id AS anchor, vec_id, round({_COS.format(a='embedding', b='vector')}, 6) AS cos FROM embeddings, a), r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY cos DESC, vec_id) AS rank FROM s) SELECT CAST(anchor AS INTEGER) AS anchor, vec_id, cos, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10",
)
def q39(spark: SparkSession, d: str) -> DataFrame:
    s = V.anchor_similarities(_vectors(spark, d), "vector", _anchors(spark, d)).select("vec_id", F.explode("similar").alias("s"))
    pairs = s.select(F.col("s.id").alias("anchor"), "vec_id", F.round("s.cos", 6).alias("cos"))
    from pyspark.sql.window import Window

    # Spark keeps ten rows of an anchor in each task before the shuffle (WindowGroupLimit).
    w = Window.partitionBy("anchor").orderBy(F.desc("cos"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


_CENTROIDS = """m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) r(i) GROUP BY 1, 2), v AS (SELECT label AS id, list(m ORDER BY i) AS v FROM m GROUP BY 1),
    c AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS vector FROM v)"""
_DIST = "list_sum(list_transform(list_zip(embedding, vector), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))"


@query(
    "q40_nearest_centroid_membership",
    f"WITH {_CENTROIDS}, s AS (SELECT vec_id, id, round({_DIST}, 9) AS d FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, id) AS r FROM s) SELECT a.vec_id, CAST(a.id AS INTEGER) AS centroid, CAST(b.id AS INTEGER) AS runner_up, round(b.d / (a.d + b.d), 5) AS membership FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2",
)
def q40(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return V.nearest_centroids(v, "vector", V.centroids_of(v, "label", "vector")).select("vec_id", "centroid", "runner_up", F.round("membership", 5).alias("membership"))


@query(
    "q41_polarity_net_fit",
    f"WITH {_ANCHORS}, s AS (SELECT vec_id, id, polarity, {_COS.format(a='embedding', b='vector')} AS cos FROM embeddings, a) SELECT vec_id, round(least(1.0, greatest(0.0, (max(cos) FILTER (WHERE polarity = 'positive') - max(cos) FILTER (WHERE polarity = 'negative') + 1) / 2)), 6) AS net_fit, CAST(arg_min(id, (-round(cos, 6), id)) FILTER (WHERE polarity = 'positive') AS INTEGER) AS best_anchor FROM s GROUP BY 1",
)
def q41(spark: SparkSession, d: str) -> DataFrame:
    return V.semantic_fit(V.anchor_similarities(_vectors(spark, d), "vector", _anchors(spark, d))).select("vec_id", F.round("net_fit", 6).alias("net_fit"), "best_anchor")


@query(
    "q42_vocab_expansion",
    f"WITH {_CENTROIDS}, s AS (SELECT id AS concept, vec_id AS term, round({_COS.format(a='embedding', b='vector')}, 6) AS cos FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY cos DESC, term) AS rank FROM s WHERE cos >= 0.3) SELECT CAST(concept AS INTEGER) AS concept, term, cos, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 25",
)
def q42(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return V.expand_vocabulary(v.select(F.col("vec_id").alias("id"), "vector"), V.centroids_of(v, "label", "vector"), least=0.3).select("concept", "term", "cos", "rank")


@query("q43_vector_missing_antijoin", "SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'missing' ELSE 'stored' END AS source FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def q43(spark: SparkSession, d: str) -> DataFrame:
    store = _vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "vector")
    return V.resolve_vectors(load(spark, d, "documents").select("doc_id"), store, "doc_id").select("doc_id", "source")


@query("q43b_structural_semijoin", "SELECT d.doc_id FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id")
def q43b(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query(
    "q44_ndcg_map_p10",
    """WITH t AS (SELECT doc_id, lang, quality * 2 + (1 - toxic) * 2 AS tier, round(n_chars / 100.0, 6) AS score FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS r, row_number() OVER (PARTITION BY lang ORDER BY tier DESC, doc_id) AS i, sum(CASE WHEN tier >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS hits FROM t)
    SELECT lang, round(sum(CASE WHEN r <= 10 THEN (pow(2.0, tier) - 1) / log2(r + 1.0) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN (pow(2.0, tier) - 1) / log2(i + 1.0) ELSE 0 END), 6) AS ndcg,
        round(sum(CASE WHEN tier >= 3 THEN hits / r END) / sum(CASE WHEN tier >= 3 THEN 1 ELSE 0 END), 6) AS map, round(avg(CASE WHEN r <= 10 THEN CASE WHEN tier >= 3 THEN 1.0 ELSE 0.0 END END), 6) AS p_at_k FROM r GROUP BY 1""",
)
def q44(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") / 100.0).alias("score")).join(load(spark, d, "labels"), "doc_id")
    t = t.select("doc_id", "lang", "score", (F.col("quality") * 2 + (1 - F.col("toxic")) * 2).alias("tier"))
    return C.ranking_metrics(t, "lang", "score", "tier", "doc_id")


@query(
    "q45_stratified_split",
    """WITH s AS (SELECT doc_id, quality * 2 + toxic AS stratum FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('split:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s)
    SELECT doc_id, CAST(stratum AS INTEGER) AS stratum, r <= CASE WHEN n >= 2 THEN greatest(floor(n * 0.25), 1) ELSE 0 END AS is_val FROM r""",
)
def q45(spark: SparkSession, d: str) -> DataFrame:
    return P.stratified_split(load(spark, d, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("stratum")), "doc_id", "stratum")


@query("q46_pearson", "SELECT round(corr(CAST(n_chars AS DOUBLE), CAST(toxic AS DOUBLE)), 6) AS r, count(*) AS n FROM documents JOIN labels USING (doc_id)")
def q46(spark: SparkSession, d: str) -> DataFrame:
    return C.pearson(load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id"), "n_chars", "toxic").withColumn("r", F.round("r", 6))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("length"), F.regexp_count("text", F.lit("[*%&$|!]")).alias("marks"), F.regexp_count("text", F.lit(r"\n")).alias("lines"))
    rows = docs.join(load(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "length", (1.0 / (1.0 + F.col("marks"))).alias("plain"), (1.0 / (1.0 + F.col("lines"))).alias("compact"), (F.col("quality") * 3 + (1 - F.col("toxic"))).alias("tier"))


@query("q50_permutation_importance")
def q50(spark: SparkSession, d: str) -> DataFrame:
    """E-12: all 145 features, five repeats, against tiers that a third of the features have a part in."""
    from evidentia.features.layout import LAYOUT

    from .record_queries import _features

    tier = F.floor(4 * sum((F.col(f) for f in LAYOUT[::3] if f != "exp__years"), F.lit(0.0)) / len(LAYOUT[::3])).cast("int")
    return C.permutation_importance(_features(spark, d, int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("tier", tier), LAYOUT, [1 / len(LAYOUT)] * len(LAYOUT), "tier", "candidate_id")


@query("q51_kmeans_archetypes")
def q51(spark: SparkSession, d: str) -> DataFrame:
    return C.kmeans(_vectors(spark, d), "vector", 10, runs=10)[1]


@query("q52_weight_search")
def q52(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).withColumn("stratum", F.col("tier").cast("int"))
    return C.weight_search(P.stratified_split(rows, "doc_id", "stratum"), ["length", "plain", "compact"], "tier", "doc_id", "is_val")


@query(
    "q55_snapshot_parity",
    f"""WITH {_FEATURES_SQL}, b AS (SELECT c_custkey, f_spend + CASE WHEN c_custkey % 3 = 0 THEN 0.00005 ELSE 0.0 END AS f_spend, f_orders, f_recent FROM feats),
    j AS (SELECT feats.c_custkey AS ka, b.c_custkey AS kb, greatest(abs(feats.f_spend - b.f_spend), abs(feats.f_orders - b.f_orders), abs(feats.f_recent - b.f_recent)) AS diff FROM feats FULL JOIN b ON feats.c_custkey = b.c_custkey)
    SELECT count(*) FILTER (WHERE kb IS NULL) AS only_a, count(*) FILTER (WHERE ka IS NULL) AS only_b, round(max(diff), 6) AS max_diff, max(diff) <= 1e-4 AS ok FROM j""",
)
def q55(spark: SparkSession, d: str) -> DataFrame:
    f = customer_features(spark, d)
    drifted = f.withColumn("f_spend", F.col("f_spend") + F.when(F.col("c_custkey") % 3 == 0, 0.00005).otherwise(0.0))
    return N.parity(f, drifted, "c_custkey", ["f_spend", "f_orders", "f_recent"]).withColumn("max_diff", F.round("max_diff", 6))


_EDGES = "(VALUES ('census','lexicon'),('census','features'),('lexicon','concepts'),('features','labels'),('labels','weights'),('concepts','vectors'),('vectors','archetypes'),('archetypes','package'),('weights','package')) AS e(parent, child)"


@query("q56_stage_closure", f"WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), reach(ancestor, node) AS (SELECT parent, child FROM e UNION SELECT r.ancestor, e.child FROM reach r JOIN e ON e.parent = r.node) SELECT ancestor, node FROM reach")
def q56(spark: SparkSession, d: str) -> DataFrame:
    return N.closure(spark, spark.sql(f"SELECT * FROM {_EDGES}"))
