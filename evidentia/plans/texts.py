"""Queries of text, mining, profiling and JSON (Q10 to Q12, Q26 to Q38)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import kernels as K
from evidentia.functions import text as T
from evidentia.operators import lexicon as L
from evidentia.operators import profile as P
from evidentia.session import load

from .registry import query

LADDER = [(1.0, ("tion", "ment")), (2.0, ("oning", "ción")), (3.0, ("thatth", "ungen", "auxan"))]
CUES = ("the", "ing", "tion", "ch", "eau", "ción", "ung")


@query(
    "q10_ladder_rank",
    "SELECT doc_id, CASE WHEN contains(lower(text), 'thatth') OR contains(lower(text), 'ungen') OR contains(lower(text), 'auxan') THEN 3.0 WHEN contains(lower(text), 'oning') OR contains(lower(text), 'ción') THEN 2.0 WHEN contains(lower(text), 'tion') OR contains(lower(text), 'ment') THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM documents",
)
def q10(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", K.ladder_rank(F.lower("text"), LADDER, 0.0).alias("v"))


@query("q11_cue_counts", f"SELECT doc_id, CAST({' + '.join(f'CASE WHEN contains(lower(text), {chr(39)}{c}{chr(39)}) THEN 1 ELSE 0 END' for c in CUES)} AS INTEGER) AS n, round(least(1.0, ln(1 + {' + '.join(f'CASE WHEN contains(lower(text), {chr(39)}{c}{chr(39)}) THEN 1 ELSE 0 END' for c in CUES)}) / ln(5.0)), 6) AS v FROM documents")
def q11(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return load(spark, d, "documents").select("doc_id", K.cue_count(low, CUES).alias("n"), F.round(K.cue_presence(low, CUES, 4), 6).alias("v"))


@query("q12_hash_pick", "SELECT doc_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % 7 AS INTEGER) AS pick FROM documents")
def q12(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", K.hash_pick(F.col("doc_id").cast("string"), 7).alias("pick"))


_TOKENS = "WITH t AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)"


@query("q26_token_counts", f"{_TOKENS} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY 1")
def q26(spark: SparkSession, d: str) -> DataFrame:
    return L.token_counts(load(spark, d, "documents"), "text")


@query(
    "q27_ctfidf_by_lang",
    f"""{_TOKENS}, tf AS (SELECT lang, token, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT token, count(DISTINCT doc_id) AS df FROM t GROUP BY 1),
    s AS (SELECT lang, token, round(tf * ln(1 + (SELECT count(*) FROM documents)::DOUBLE / df), 6) AS raw FROM tf JOIN df USING (token)),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY raw DESC, token) AS rank, max(raw) OVER (PARTITION BY lang) AS best FROM s)
    SELECT lang, token, CAST(rank AS INTEGER) AS rank, round(raw / best, 6) AS weight FROM r WHERE rank <= 50""",
)
def q27(spark: SparkSession, d: str) -> DataFrame:
    return L.class_tfidf(load(spark, d, "documents"), "lang", "text").select("lang", "token", "rank", "weight")


_PMI = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), u AS (SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM w) GROUP BY 1), n AS (SELECT sum(c) AS n FROM u),
    p AS (SELECT w[i] AS t1, w[i + 1] AS t2, count(*) AS n FROM w, unnest(range(1, len(w))) r(i) GROUP BY 1, 2 HAVING count(*) >= 3),
    b AS (SELECT t1, t2, p.n, round(log2(p.n * CAST(n.n AS DOUBLE) / (CAST(a.c AS DOUBLE) * c.c)), 6) AS pmi FROM p JOIN u a ON a.t = t1 JOIN u c ON c.t = t2, n), k AS (SELECT * FROM b WHERE pmi >= 2.0)"""


@query("q28_pmi_bigrams", f"{_PMI} SELECT t1, t2, n, pmi FROM k")
def q28(spark: SparkSession, d: str) -> DataFrame:
    return L.pmi_bigrams(load(spark, d, "documents"), "text")


@query("q29_trigrams_gated", f"{_PMI}, g AS (SELECT w[i] AS t1, w[i + 1] AS t2, w[i + 2] AS t3, count(*) AS n FROM w, unnest(range(1, len(w) - 1)) r(i) GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT g.t1, g.t2, g.t3, g.n, round((a.pmi + b.pmi) / 2, 7) AS pmi FROM g JOIN k a ON a.t1 = g.t1 AND a.t2 = g.t2 JOIN k b ON b.t1 = g.t2 AND b.t2 = g.t3")
def q29(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return L.gated_trigrams(docs, "text", L.pmi_bigrams(docs, "text"))


@query("q30_cooccurrence_top10")
def q30(spark: SparkSession, d: str) -> DataFrame:
    return L.cooccurrence_whole(load(spark, d, "documents"), "text")


@query(
    "q31_token_overlap",
    """WITH v AS (SELECT list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]+')))) AS v FROM benchmark), s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM documents)
    SELECT doc_id, round(CASE WHEN len(s) > 0 THEN len(list_intersect(s, v)) / len(s) ELSE 0 END, 6) AS v FROM s, v""",
)
def q31(spark: SparkSession, d: str) -> DataFrame:
    # The benchmark is a fixed list of test items; its words meet each document's by one broadcast row.
    known = load(spark, d, "benchmark").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("w")).agg(F.collect_set("w").alias("v"))
    return load(spark, d, "documents").crossJoin(F.broadcast(known)).select("doc_id", F.round(T.overlap_ratio(F.array_distinct(T.words(F.col("text"))), F.col("v")), 6).alias("v"))


@query("q32_normalise_nfc", "SELECT doc_id, sha256(lower(nfc_normalize(text))) AS h FROM documents")
def q32(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.sha2(F.lower(T.composed(F.col("text"))), 256).alias("h"))


@query("q33_skeleton_templates", "WITH s AS (SELECT role, regexp_replace(regexp_replace(text, '[A-Z]{2,}_[0-9]+', '<id>', 'g'), '[0-9]+(?:\\.[0-9]+)?', '<n>', 'g') AS s FROM conversations), c AS (SELECT role, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT role, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_skeletons, max(n) AS most, round(max(n) / sum(n), 6) AS share FROM c GROUP BY 1")
def q33(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations").groupBy("role", T.skeleton(F.col("text")).alias("s")).agg(F.count("*").alias("n"))
    return c.groupBy("role").agg(F.sum("n").alias("n"), F.count("*").alias("n_skeletons"), F.max("n").alias("most"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("q34_json_path_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q34(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("q35_compose_document", "SELECT doc_id, sha256(concat_ws(chr(10), CASE WHEN length(trim(coalesce(lang, ''))) > 0 THEN 'Language: ' || trim(lang) END, CASE WHEN length(trim(coalesce(source, ''))) > 0 THEN 'Source: ' || trim(source) END, CASE WHEN length(trim(coalesce(text, ''))) > 0 THEN 'Text: ' || trim(text) END)) AS h FROM documents")
def q35(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.sha2(T.compose([("Language", F.col("lang")), ("Source", F.col("source")), ("Text", F.col("text"))]), 256).alias("h"))


@query(
    "q36_census_profile",
    """SELECT 'o_totalprice' AS field, count(o_totalprice) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders
    UNION ALL SELECT 'o_custkey', count(o_custkey), min(o_custkey), max(o_custkey), round(avg(o_custkey), 4), round(quantile_cont(o_custkey, 0.25), 4), round(quantile_cont(o_custkey, 0.5), 4), round(quantile_cont(o_custkey, 0.75), 4), round(quantile_cont(o_custkey, 0.95), 4) FROM orders""",
)
def q36(spark: SparkSession, d: str) -> DataFrame:
    p = P.numeric_profile(load(spark, d, "orders"), ["o_totalprice", "o_custkey"], exact=True)
    return p.select("field", "n", "min", "max", *(F.round(c, 4).alias(c) for c in ("mean", "p25", "p50", "p75", "p95")))


@query("q36b_coverage", "SELECT 'text' AS field, count(text) AS present, count(*) AS rows, round(count(text) / count(*), 6) AS fraction FROM documents UNION ALL SELECT 'lang', count(lang), count(*), round(count(lang) / count(*), 6) FROM documents")
def q36b(spark: SparkSession, d: str) -> DataFrame:
    return P.coverage(load(spark, d, "documents"), ["text", "lang"]).withColumn("fraction", F.round("fraction", 6))


@query("q36c_frequencies", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1")
def q36c(spark: SparkSession, d: str) -> DataFrame:
    return P.frequencies(load(spark, d, "documents"), "lang")


@query("q37_duplicates_first_wins", "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY text")
def q37(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return P.first_wins(docs, ["h"], ["doc_id"]).select("doc_id", "h")


_TERMS, _PHRASES = ["the", "ing", "der", "tion", "la", "para"], ["of the", "in the", "en la", "de la"]


@query(
    "q58_lexicon_match",
    f"WITH h AS (SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), {_TERMS})) AS t, {' + '.join(f'CASE WHEN contains(lower(text), {chr(39)}{p}{chr(39)}) THEN 1 ELSE 0 END' for p in _PHRASES)} AS p FROM documents) SELECT doc_id, CAST(t AS INTEGER) AS terms, CAST(p AS INTEGER) AS phrases, round(least(1.0, ln(1 + t + p) / ln(5.0)), 6) AS score FROM h",
)
def q58(spark: SparkSession, d: str) -> DataFrame:
    hit = L.lexicon_match(load(spark, d, "documents"), "text", _TERMS, _PHRASES)
    return hit.select("doc_id", F.size("terms_hit").alias("terms"), F.size("phrases_hit").alias("phrases"), F.round("lexicon_score", 6).alias("score"))


@query("q59_canonicalise", "SELECT canonical, count(*) AS n FROM (SELECT coalesce(m.c, lower(trim(o_orderpriority))) AS canonical FROM orders LEFT JOIN (VALUES ('1-urgent', 'urgent'), ('2-high', 'urgent'), ('5-low', 'low')) m(s, c) ON lower(trim(o_orderpriority)) = m.s) GROUP BY 1")
def q59(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("1-urgent", "urgent"), ("2-high", "urgent"), ("5-low", "low")], "surface string, canonical string")
    return L.canonicalise(load(spark, d, "orders"), "o_orderpriority", mapping).groupBy(F.col("o_orderpriority_canonical").alias("canonical")).agg(F.count("*").alias("n"))


@query(
    "q60_template_priorities",
    """WITH t(template, feature) AS (VALUES ('a', 'f1'), ('a', 'f2'), ('b', 'f3'), ('c', 'f9')), i AS (SELECT 'f' || n_regionkey AS feature, round(avg(n_nationkey), 4) AS importance FROM nation GROUP BY 1)
    SELECT template, coalesce(max(importance), 0.0) AS priority, coalesce(bool_or(feature = 'f2'), false) AS gold_supported FROM t LEFT JOIN i USING (feature) GROUP BY 1""",
)
def q60(spark: SparkSession, d: str) -> DataFrame:
    templates = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("b", "f3"), ("c", "f9")], "template string, feature string")
    importances = load(spark, d, "nation").groupBy(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("feature")).agg(F.round(F.avg("n_nationkey"), 4).alias("importance"))
    return L.template_priorities(templates, importances, spark.createDataFrame([("f2",)], "feature string"))
