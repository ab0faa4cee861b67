"""Queries beyond the catalogue: relational forms that Spark has anyway, event windows, and the records.

The records are a seeded pool that Spark makes by expression, so the query runs
at any size without a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.session import load
from evidentia.streaming import events as E

from .registry import query


@query("x01_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def x01(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("qty"))


@query("x02_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def x02(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("x03_full_outer", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c_nationkey = s_nationkey")
def x03(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("cn"))
    s = load(spark, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("sn"))
    return c.join(s, c["c_nationkey"] == s["s_nationkey"], "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.coalesce("cn", F.lit(0)).alias("customers"), F.coalesce("sn", F.lit(0)).alias("suppliers"))


@query("x04_explicit_frame", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def x04(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return load(spark, d, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("moving"))


@query("x05_revenue_by_region", "SELECT r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def x05(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1997-01-01'").select("o_orderkey", "o_custkey")
    places = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = load(spark, d, "customer").select("c_custkey", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    lines = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice").cast("decimal(15,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).alias("m"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.sum("m").cast("double").alias("revenue"), F.count("*").alias("n"))


@query("x06_event_days", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def x06(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.tumbling(ev, "1 day", "1 hour", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query(
    "x07_event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
    SELECT user_id, CAST(count(DISTINCT no) AS BIGINT) AS sessions, count(*) AS events FROM s GROUP BY 1""",
)
def x07(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(ev, "6 hours", "1 hour", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def record_pool(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """n nested records by expression: every value comes of a hash of the row's number."""
    from evidentia.sources.records import SIZES

    h = lambda tag, m: F.pmod(F.xxhash64(F.lit(tag), F.col("id")), F.lit(m)).cast("int")
    pick = lambda tag, xs: F.element_at(F.array(*map(F.lit, xs)), h(tag, len(xs)) + 1)
    texts = (
        "Built and deployed a retrieval and ranking platform in production for millions of users.",
        "Implemented embeddings and faiss search, measured ndcg and mrr in offline eval.",
        "Developed nlp features in python and pytorch and shipped them to our users.",
        "Consulting engagement for a client: strategy, governance and budget.",
    )
    names = ("Python", "Retrieval", "Ranking", "NLP", "LLM", "PyTorch", "MLOps", "Embeddings", "FAISS", "SQL", "Recommendation", "NDCG")
    year = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    years = h("years", 11) + 2
    span = F.greatest(F.floor(years / 2).cast("int"), F.lit(1))

    def role(k: int):
        start = F.lit(2024) - span * (k + 1)
        return F.struct(
            pick(f"co{k}", ("Acme", "Globex", "TCS", "Initech", "Umbrella")).alias("company"), pick(f"ti{k}", ("ML Engineer", "Senior Engineer", "Data Scientist", "Principal Architect")).alias("title"), year(start).alias("start_date"), (F.lit(None).cast("date") if k == 0 else year(start + span)).alias("end_date"),
            (span * 12 + (5 if k == 0 else 0)).alias("duration_months"), F.lit(k == 0).alias("is_current"), pick(f"in{k}", ("Software", "Fintech", "IT Services")).alias("industry"), pick(f"si{k}", SIZES).alias("company_size"), pick(f"de{k}", texts).alias("description"),
        )

    def skill(k: int):
        return F.struct(F.element_at(F.array(*map(F.lit, names)), (h("sk", 12) + k * 5) % 12 + 1).alias("name"), pick(f"pr{k}", ("beginner", "intermediate", "advanced", "expert")).alias("proficiency"), h(f"en{k}", 60).alias("endorsements"), F.when(h(f"mo{k}", 7) > 0, h(f"mm{k}", 60)).alias("duration_months"))

    unit = lambda tag: h(tag, 1000) / 1000.0
    signals = F.struct(
        (40 + 60 * unit("pc")).alias("profile_completeness_score"), F.make_date(F.lit(2021), F.lit(6), F.lit(1)).alias("signup_date"), F.date_sub(F.lit("2024-06-18").cast("date"), h("la", 150)).alias("last_active_date"), (h("ow", 5) > 1).alias("open_to_work_flag"), h("pv", 200).alias("profile_views_received_30d"),
        h("ap", 30).alias("applications_submitted_30d"), unit("rr").alias("recruiter_response_rate"), (1 + 70 * unit("rt")).alias("avg_response_time_hours"), F.create_map(F.element_at(F.array(*map(F.lit, names)), h("sk", 12) + 1), 30 + 70 * unit("as")).alias("skill_assessment_scores"), h("cc", 1500).alias("connection_count"),
        h("er", 100).alias("endorsements_received"), pick("np", (0, 15, 30, 45, 60, 90, 120)).alias("notice_period_days"), F.struct(F.lit(20.0).alias("min"), pick("sa", (18.0, 35.0, 50.0)).alias("max")).alias("expected_salary_range_inr_lpa"), pick("wm", ("remote", "hybrid", "onsite")).alias("preferred_work_mode"),
        (h("wr", 2) == 0).alias("willing_to_relocate"), pick("gh", (-1.0, 10.0, 55.0, 90.0)).alias("github_activity_score"), h("sp", 100).alias("search_appearance_30d"), h("sv", 20).alias("saved_by_recruiters_30d"), unit("ic").alias("interview_completion_rate"), pick("oa", (-1.0, 0.5, 0.9)).alias("offer_acceptance_rate"),
        F.lit(True).alias("verified_email"), (h("vp", 2) == 0).alias("verified_phone"), F.lit(True).alias("linkedin_connected"),
    )
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return base.select(
        F.concat(F.lit("CAND_"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("candidate_id"),
        F.struct(F.concat(F.lit("Person "), "id").alias("anonymized_name"), F.lit("Engineer").alias("headline"), pick("de0", texts).alias("summary"), pick("lo", ("Pune, Maharashtra", "Bengaluru, Karnataka", "Noida, UP")).alias("location"), pick("cy", ("India", "India", "India", "Germany")).alias("country"), years.cast("double").alias("years_of_experience"), pick("ti0", ("ML Engineer", "Senior Engineer", "Data Scientist", "Principal Architect")).alias("current_title"), pick("co0", ("Acme", "Globex", "TCS", "Initech", "Umbrella")).alias("current_company"), pick("si0", SIZES).alias("current_company_size"), pick("in0", ("Software", "Fintech", "IT Services")).alias("current_industry")).alias("profile"),
        F.array(role(0), role(1)).alias("career_history"),
        F.array(F.struct(F.lit("Institute").alias("institution"), F.lit("B.Tech").alias("degree"), pick("fs", ("Computer Science", "Physics", "History")).alias("field_of_study"), (F.lit(2019) - years).alias("start_year"), (F.lit(2023) - years).alias("end_year"), F.lit(None).cast("string").alias("grade"), pick("et", ("tier_1", "tier_2", "tier_3", "unknown")).alias("tier"))).alias("education"),
        F.array(*(skill(k) for k in range(4))).alias("skills"),
        signals.alias("signals"),
    )


def _policy():
    from .ranking import Policy

    return Policy(as_of="2024-06-18")


@query("r01_rank_records")
def r01(spark: SparkSession, d: str) -> DataFrame:
    """The top 100 of a pool of nested records as many as there are customers, with reasons."""
    from .explain import explain, salted
    from .ranking import rank_records, score_records

    n = load(spark, d, "customer").count()
    policy = _policy()
    top = rank_records(score_records(record_pool(spark, n), policy), policy, exact=False)
    return salted(explain(top, policy)).select("candidate_id", "rank", F.round("score", 6).alias("score"), "reasoning", "evidence", "band")


@query("r02_features_and_gates")
def r02(spark: SparkSession, d: str) -> DataFrame:
    """How many records each integrity and eligibility code applies to."""
    from evidentia.operators import gates as G

    from .ranking import score_records

    scored = score_records(record_pool(spark, load(spark, d, "customer").count()), _policy())
    return G.histogram(scored, "hard_codes", "soft_codes", "integrity_codes")


@query("r03_feature_profile")
def r03(spark: SparkSession, d: str) -> DataFrame:
    """Mean and bounds of all 145 features over the pool."""
    from evidentia.features.extract import extract_features
    from evidentia.features.layout import LAYOUT

    f = extract_features(record_pool(spark, load(spark, d, "customer").count()), "2024-06-18")
    cells = f.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in LAYOUT))).alias("c"))
    return cells.groupBy("c.feature").agg(F.min("c.x").alias("min"), F.avg("c.x").alias("mean"), F.max("c.x").alias("max"))


@query("q38_reject_table")
def q38(spark: SparkSession, d: str) -> DataFrame:
    """Reject reasons of lines of which some are spoiled on purpose."""
    from evidentia.sources.records import parse_records

    n = load(spark, d, "customer").count()
    good = record_pool(spark, n).withColumns({"certifications": F.array().cast("array<struct<name:string,issuer:string,year:int>>"), "languages": F.array().cast("array<struct<language:string,proficiency:string>>")})
    good = good.select("candidate_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).repartition("candidate_id")
    line = F.col("line")
    k = F.col("candidate_id").substr(6, 7).cast("long")
    spoiled = F.when(k % 50 == 1, F.substring(line, 1, 40)).when(k % 50 == 2, F.lit("[1, 2]")).when(k % 50 == 3, F.regexp_replace(line, "^\\{", '{"extra":1,')).when(k % 50 == 4, F.replace(line, F.lit('"candidate_id":"CAND_'), F.lit('"candidate_id":"X_'))).when(k % 50 == 5, F.regexp_replace(line, '"years_of_experience":[0-9.]+', '"years_of_experience":77.0')).otherwise(line)
    lines = good.select(F.lit("pool").alias("file"), (k + 1).alias("line_no"), k.alias("source_index"), spoiled.alias("line"))
    # The exchange keeps the long expression of a line from being put in wherever the line is read.
    lines = lines.repartition("line_no")
    return parse_records(lines).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
