"""Queries of small operators with SQL for each: words for levels, keys, encoders, joins of a ranking, lineage of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.features.layout import FEATURE_NEEDS
from evidentia.functions import kernels as K
from evidentia.functions import text as T
from evidentia.operators import artifacts as A
from evidentia.operators import calibrate as C
from evidentia.operators import lineage as L
from evidentia.operators import profile as P
from evidentia.operators import ranking as R
from evidentia.operators import vectors as V
from evidentia.session import load

from .explain import WORDS
from .record_queries import _sql, records
from .registry import query

_LEVEL = "CASE WHEN x >= 0.75 THEN 'HIGH' WHEN x >= 0.5 THEN 'GOOD' WHEN x >= 0.3 THEN 'FAIR' ELSE 'LOW' END"
_PICK = lambda pool: f"[{', '.join(repr(w) for w in pool)}][CAST(CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS UBIGINT) % {len(pool)} AS INTEGER) + 1]"
_WORD = f"CASE {_LEVEL} " + " ".join(f"WHEN '{k}' THEN {_PICK(p)}" for k, p in WORDS.items()) + " END"


@query(
    "q61_words_for_levels",
    f"""WITH o AS (SELECT o_orderkey, (o_orderkey % 101) / 100::DOUBLE AS x, CAST(o_orderdate AS DATE) AS day, o_orderkey * 37 % 6000000 AS ms FROM orders), w AS (SELECT *, {_WORD} AS word FROM o)
    SELECT o_orderkey, {_LEVEL} AS level, word, CASE WHEN lower(left(word, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END AS article, round(least(0.85, 0.35 + 0.15 * (o_orderkey % 6))::DOUBLE, 9) AS intensity, CAST(round_even(x * 100, 0) AS INTEGER) || '%' AS percent,
    CAST((1999 - year(day)) * 12 + 1 - month(day) AS INTEGER) AS months, round((DATE '1999-01-31' - day) / 30.4375, 9) AS span, printf('%02d:%02d.%03d', CAST(floor(ms / 60000) AS BIGINT), CAST(floor((ms % 60000) / 1000) AS BIGINT), ms % 1000) AS clock FROM w""",
)
def q61(spark: SparkSession, d: str) -> DataFrame:
    """K-18 to K-23."""
    x, day, last = (F.col("o_orderkey") % 101) / F.lit(100.0), F.col("o_orderdate").cast("date"), F.to_date(F.lit("1999-01-31"))
    o = load(spark, d, "orders").select("o_orderkey", day.alias("day"), x.alias("x"), K.pick_word(K.intensity(x), F.col("o_orderkey").cast("string"), WORDS).alias("word"))
    return o.select(
        "o_orderkey", K.intensity(F.col("x")).alias("level"), "word", K.article(F.col("word")).alias("article"), F.round(K.evidence_intensity(F.col("o_orderkey") % 6), 9).alias("intensity"), K.percent(F.col("x")).alias("percent"),
        K.months_between_ym(F.col("day"), last).cast("int").alias("months"), F.round(K.month_span(F.col("day"), last), 9).alias("span"), K.duration_text(F.col("o_orderkey") * 37 % 6000000).alias("clock"),
    )


@query("q62_anchor_rows", "SELECT CAST(vec_id AS BIGINT) AS id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS row, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings QUALIFY row < 24")
def q62(spark: SparkSession, d: str) -> DataFrame:
    """J-13: the anchors are the first vectors by id, a policy's few rows."""
    first = load(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")).orderBy("id").limit(24)
    return V.anchor_rows(first).select("id", F.col("row").cast("int").alias("row"), F.round(F.col("vector")[0].cast("double"), 6).alias("x"))


@query(
    "q63_ranked_with_raw",
    """WITH spent AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS score, count(*) AS orders FROM orders GROUP BY 1), top AS (SELECT o_custkey AS id, score, CAST(row_number() OVER (ORDER BY score DESC, o_custkey) AS INTEGER) AS rank FROM spent QUALIFY rank <= 100)
    SELECT id, rank, top.score, c_name AS name, orders FROM top JOIN customer ON c_custkey = id JOIN spent ON o_custkey = id""",
)
def q63(spark: SparkSession, d: str) -> DataFrame:
    """J-14: ranked rows joined with the raw and the scored table."""
    spent = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("score"), F.count("*").alias("orders"))
    top = R.top_k(spent.withColumn("floored", F.lit(False)), 100, "score", "id", "floored", False).select("id", F.col("rank").cast("int").alias("rank"), "score")
    return R.ranked_with(top, "id", load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), spent.select("id", "orders"))


@query("q64_key_differences", "(SELECT o_custkey AS key, 'left' AS side FROM orders EXCEPT SELECT c_custkey, 'left' FROM customer WHERE c_acctbal > 0) UNION ALL (SELECT c_custkey, 'right' FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey, 'right' FROM orders)")
def q64(spark: SparkSession, d: str) -> DataFrame:
    """SET-5: keys on one side only."""
    return P.key_differences(load(spark, d, "orders").withColumnRenamed("o_custkey", "key"), load(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "key"), "key")


@query("q64b_shared_keys", "SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def q64b(spark: SparkSession, d: str) -> DataFrame:
    """SET-5: keys on both sides."""
    return P.shared_keys(load(spark, d, "orders").withColumnRenamed("o_custkey", "key"), load(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "key"), "key")


_CELLS = "list_transform(range(0, 8), lambda k: CAST(('0x' || substr(sha256(text || ':' || k), 1, 8))::UBIGINT AS DOUBLE) / 2147483648 - 1)"


@query(
    "q65_encode_missing",
    f"""WITH e AS (SELECT item_id, {_CELLS} AS v FROM benchmark), u AS (SELECT item_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)
    SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'stored' ELSE 'encoded' END AS source, round(CASE WHEN item_id % 3 = 0 THEN 1 ELSE v[1] END, 6) AS x, round(CASE WHEN item_id % 3 = 0 THEN 0 ELSE v[8] END, 6) AS y FROM u""",
)
def q65(spark: SparkSession, d: str) -> DataFrame:
    """E-15, J-1, J-2: a store has every third vector; the others are encoded from the text."""
    items = load(spark, d, "benchmark").select("item_id", "text")
    store = items.where("item_id % 3 = 0").select("item_id", F.expr("array(1D, 0D, 0D, 0D, 0D, 0D, 0D, 0D)").alias("vector"))
    got = V.resolve_vectors(items, store, "item_id", lambda missing: missing.select("item_id", V.hash_encoder(F.col("text"), 8).alias("vector")))
    return got.select("item_id", "source", F.round(F.col("vector")[0], 6).alias("x"), F.round(F.col("vector")[7], 6).alias("y"))


CANON = {"nlp": "natural language processing", "ml engineer": "machine learning engineer", "ndcg": "ranking metrics", "mlops": "ml operations", "tcs": "tata consultancy services"}
_canon = lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CANON.items()) + f" ELSE {x} END"
_low = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


@query(
    "q66_normalised_records",
    _sql(f"""SELECT candidate_id, {_low('headline')} AS headline, {_canon(_low('current_title'))} AS title, {_canon(_low('current_company'))} AS company, (SELECT string_agg({_canon(_low('name'))}, '|' ORDER BY k) FROM s0 WHERE s0.n = p.n) AS skills,
    (SELECT string_agg({_canon(_low('company'))} || '/' || {_low('description')}, '|' ORDER BY k) FROM r WHERE r.n = p.n) AS roles, coalesce((SELECT string_agg({_low('field_of_study')}, '|' ORDER BY k) FROM e WHERE e.n = p.n), '') AS fields FROM p"""),
)
def q66(spark: SparkSession, d: str) -> DataFrame:
    """E-18, J-6: the projection of records onto normal texts and canonical names."""
    from evidentia.operators.lexicon import normalised_records

    out = normalised_records(records(spark, d), CANON)
    return out.select(
        "candidate_id", "profile.headline", F.col("profile.current_title").alias("title"), F.col("profile.current_company").alias("company"), F.array_join(F.transform("skills", lambda s: s["name"]), "|").alias("skills"),
        F.array_join(F.transform("career_history", lambda r: F.concat(r["company"], F.lit("/"), r["description"])), "|").alias("roles"), F.array_join(F.transform("education", lambda e: e["field_of_study"]), "|").alias("fields"),
    )


_EDGES = ", ".join(f"('{p}', '{c}')" for c, ps in FEATURE_NEEDS.items() for p in ps)


@query("q67_feature_lineage", f"WITH RECURSIVE e(parent, child) AS (VALUES {_EDGES}), up AS (SELECT parent, child FROM e UNION SELECT e.parent, up.child FROM e JOIN up ON up.parent = e.child) SELECT child AS feature, CAST(count(*) AS BIGINT) AS sources FROM up GROUP BY 1")
def q67(spark: SparkSession, d: str) -> DataFrame:
    """L-3: how many features each is built of, directly or not."""
    graph = A.FeatureGraph(FEATURE_NEEDS)
    return L.closure(spark, graph.edges(spark)).groupBy(F.col("node").alias("feature")).agg(F.count("*").alias("sources"))


@query("q68_vocabulary_union", "WITH a AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS s, list_value('zeta', 'alpha', 'the') AS seeds, doc_id FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(seeds, s)))[1:80], ',') AS words FROM a WHERE s IS NOT NULL")
def q68(spark: SparkSession, d: str) -> DataFrame:
    """SET-4: sorted union of seeds and found terms, cut to 80, which is the feature."""
    w = T.words(F.col("text"))
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(V.merge_vocabulary(F.array(*map(F.lit, ("zeta", "alpha", "the"))), w), ",").alias("words"))


@query(
    "q69_fingerprints",
    """WITH c AS (SELECT o_orderpriority AS cluster, unnest([struct_pack(feature := 'price', x := o_totalprice / 1000), struct_pack(feature := 'key', x := (o_orderkey % 97)::DOUBLE), struct_pack(feature := 'cust', x := (o_custkey % 89)::DOUBLE)]) AS z FROM orders),
    e AS (SELECT cluster, z.feature AS feature, avg(z.x) AS m, count(*) AS size FROM c GROUP BY 1, 2), w AS (SELECT z.feature AS feature, avg(z.x) AS whole FROM c GROUP BY 1), v AS (SELECT cluster, feature, size, round(m - whole, 6) AS deviation FROM e JOIN w USING (feature))
    SELECT cluster, feature, size, round(deviation, 5) AS deviation FROM v QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY abs(deviation) DESC, feature) <= 2""",
)
def q69(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26: of each cluster its size and the two features that deviate most."""
    o = load(spark, d, "orders").select(F.col("o_orderpriority").alias("cluster"), (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_orderkey") % 97).alias("key"), (F.col("o_custkey") % 89).alias("cust"))
    return C.fingerprint(o, "cluster", ["price", "key", "cust"], top=2).select("cluster", "feature", "size", F.round("deviation", 5).alias("deviation"))


@query("q70_score_digest", "SELECT sha256(string_agg(s, ',' ORDER BY s)) AS digest FROM (SELECT printf('%.6f', c_acctbal) AS s FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100)")
def q70(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13: one digest of the shown scores of the top 100."""
    top = load(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)
    return top.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.format_string("%.6f", F.col("c_acctbal").cast("double")))), ","), 256).alias("digest"))
