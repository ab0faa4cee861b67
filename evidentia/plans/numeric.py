"""Queries of numeric kernels, gates, windows and intervals (Q01 to Q25, Q47 to Q49)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as K
from evidentia.functions.vectors import dot
from evidentia.operators import gates as G
from evidentia.operators import intervals as I
from evidentia.operators import ranking as R
from evidentia.operators import scoring as S
from evidentia.session import load

from .registry import query

#: The last order date of the data; never the clock.
AS_OF = "2001-08-01"


def _as_of() -> Column:
    return F.to_date(F.lit(AS_OF))


def customer_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer: spend, orders, days since the last order, and features from them.

    Line items are summed by order before they meet orders, and orders by
    customer before they meet customers: both joins carry sums, not lines.
    """
    money = F.col("l_extendedprice").cast("decimal(15,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(money).alias("spend"))
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    per = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").groupBy("o_custkey").agg(F.sum("spend").alias("spend"), F.count("*").alias("n_orders"), F.max("day").alias("last_day"))
    customers = load(spark, d, "customer")
    base = customers.join(per, customers["c_custkey"] == per["o_custkey"], "left").select(
        "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal",
        F.coalesce(F.col("spend").cast("double"), F.lit(0.0)).alias("spend"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
        F.coalesce(K.days_between(F.col("last_day"), _as_of()), F.lit(3650)).alias("idle_days"),
    )
    return base.select(
        "*",
        K.bounded_log(F.col("spend"), 5e6).alias("f_spend"),
        K.bounded_log(F.col("n_orders"), 30).alias("f_orders"),
        K.recency(F.col("idle_days"), 180).alias("f_recent"),
        K.inverse_bounded(F.col("idle_days"), 90).alias("f_prompt"),
        K.unit(F.col("c_acctbal") / 10000).alias("f_balance"),
    )


_FEATURES_SQL = f"""
    lines AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS spend FROM lineitem GROUP BY 1),
    per AS (SELECT o_custkey, sum(spend) AS spend, count(*) AS n_orders, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY 1),
    base AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, coalesce(CAST(spend AS DOUBLE), 0.0) AS spend, coalesce(n_orders, 0) AS n_orders,
        coalesce(date_diff('day', last_day, DATE '{AS_OF}'), 3650) AS idle_days FROM customer LEFT JOIN per ON c_custkey = o_custkey),
    feats AS (SELECT *, least(1.0, greatest(0.0, ln(1 + greatest(spend, 0.0)) / ln(1 + 5e6))) AS f_spend,
        least(1.0, greatest(0.0, ln(1 + n_orders) / ln(1 + 30.0))) AS f_orders, pow(0.5, greatest(idle_days, 0) / 180.0) AS f_recent,
        90.0 / (90.0 + greatest(idle_days, 0)) AS f_prompt, least(1.0, greatest(0.0, c_acctbal / 10000)) AS f_balance FROM base)"""


def ranked_customers(spark: SparkSession, d: str) -> DataFrame:
    f = customer_features(spark, d)
    raw = F.col("f_spend") * 0.4 + F.col("f_orders") * 0.3 + F.col("f_recent") * 0.3
    confidence = 0.3 + 0.7 * K.bounded_log(F.col("n_orders"), 10)
    floored = F.col("c_acctbal") < 0
    score = F.round(F.when(floored, F.lit(0.0)).otherwise(K.shrink(raw * K.affine(F.col("f_balance"), 0.6, 1.0), confidence)), 6)
    return f.select("c_custkey", "c_mktsegment", "n_orders", floored.cast("int").alias("floored"), score.alias("score"))


_RANKED_SQL = f"""WITH {_FEATURES_SQL},
    scored AS (SELECT c_custkey, c_mktsegment, n_orders, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS floored,
        round(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE 0.5 + (0.3 + 0.7 * least(1.0, greatest(0.0, ln(1 + n_orders) / ln(11.0)))) *
        ((f_spend * 0.4 + f_orders * 0.3 + f_recent * 0.3) * (0.6 + 0.4 * f_balance) - 0.5) END, 6) AS score FROM feats)"""


@query("q01_rank_customers_top100", f"{_RANKED_SQL} SELECT c_custkey, score, floored, CAST(row_number() OVER (ORDER BY floored, score DESC, c_custkey) AS INTEGER) AS rank FROM scored ORDER BY floored, score DESC, c_custkey LIMIT 100")
def q01(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(ranked_customers(spark, d), 100, "score", "c_custkey", "floored").select("c_custkey", "score", "floored", "rank")


@query("q02_saturating_log", "SELECT c_custkey, round(least(1.0, greatest(0.0, ln(1 + greatest(c_acctbal, 0.0)) / ln(1 + 10000.0))), 6) AS v FROM customer")
def q02(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", F.round(K.bounded_log(F.col("c_acctbal"), 10000), 6).alias("v"))


@query("q03_recency_half_life", "SELECT event_id, round(pow(0.5, greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01'), 0) / 7.0), 6) AS v FROM events")
def q03(spark: SparkSession, d: str) -> DataFrame:
    days = K.days_between(F.col("ts"), F.to_date(F.lit("2024-02-01")))
    return load(spark, d, "events").select("event_id", F.round(K.recency(days, 7), 6).alias("v"))


@query("q04_inverse_bounded", "SELECT p_partkey, round(20.0 / (20.0 + greatest(p_size, 0)), 6) AS v FROM part")
def q04(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.round(K.inverse_bounded(F.col("p_size"), 20), 6).alias("v"))


@query("q05_affine_multiplier", "SELECT s_suppkey, round(0.6 + 0.4 * least(1.0, greatest(0.0, s_acctbal / 10000)), 6) AS v FROM supplier")
def q05(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select("s_suppkey", F.round(K.affine(F.col("s_acctbal") / 10000, 0.6, 1.0), 6).alias("v"))


@query("q06_shrink_to_prior", "SELECT p_partkey, round(0.5 + (20.0 / (20.0 + p_size)) * (least(1.0, greatest(0.0, p_retailprice / 2000)) - 0.5), 6) AS v FROM part")
def q06(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.round(K.shrink(K.unit(F.col("p_retailprice") / 2000), K.inverse_bounded(F.col("p_size"), 20)), 6).alias("v"))


# Products of two-digit discounts lie on a grid of 14 decimals, often half-way between two roundings; the offset is on no such grid.
@query("q07_noisy_or_by_order", "SELECT l_orderkey, round(CASE WHEN max(l_discount) >= 1 THEN 1.0 ELSE 1.0 - exp(sum(ln(1 - l_discount))) END + 1.23456789e-11, 9) AS v FROM lineitem GROUP BY l_orderkey")
def q07(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(K.noisy_or_agg(F.col("l_discount")) + 1.23456789e-11, 9).alias("v"))


@query("q08_weighted_mean_with_fallback", "SELECT l_orderkey, round(CASE WHEN sum(l_tax) > 0 THEN sum(l_quantity * l_tax) / sum(l_tax) ELSE avg(l_quantity) END, 6) AS v, sum(CASE WHEN l_tax > 0 THEN 0 ELSE 1 END)::BIGINT AS n_zero FROM lineitem GROUP BY l_orderkey")
def q08(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(K.weighted_mean_agg(F.col("l_quantity"), F.col("l_tax")), 6).alias("v"), F.sum(F.when(F.col("l_tax") > 0, 0).otherwise(1)).alias("n_zero"))


@query(
    "q09_band_jaccard",
    """WITH b AS (SELECT p_brand, p_type, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1, 2)
    SELECT a.p_brand, a.p_type AS type_a, b.p_type AS type_b, round(CASE WHEN greatest(a.hi, b.hi) > least(a.lo, b.lo)
        THEN greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0.0) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) ELSE 1.0 END, 6) AS v
    FROM b a JOIN b b ON a.p_brand = b.p_brand AND a.p_type < b.p_type""",
)
def q09(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    o = b.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type_b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return b.join(o, (b["p_brand"] == o["brand"]) & (b["p_type"] < o["type_b"])).select("p_brand", F.col("p_type").alias("type_a"), "type_b", F.round(K.band_jaccard(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2")), 6).alias("v"))


@query("q13_piecewise_interp", "SELECT o_orderkey, round(CASE WHEN o_totalprice <= 1000 THEN 0.0 WHEN o_totalprice <= 100000 THEN (o_totalprice - 1000) * (0.5 / 99000) WHEN o_totalprice <= 400000 THEN 0.5 + (o_totalprice - 100000) * (0.4 / 300000) ELSE 0.9 END, 6) AS v FROM orders")
def q13(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", F.round(K.interpolate(F.col("o_totalprice"), [(1000, 0.0), (100000, 0.5), (400000, 0.9)]), 6).alias("v"))


def customer_gates() -> list[G.Gate]:
    return [
        G.Gate("NEGATIVE_BALANCE", F.col("c_acctbal") < 0, True),
        G.Gate("NO_ORDERS", F.col("n_orders") == 0, True),
        G.Gate("IDLE", F.col("idle_days") > 180, False),
        G.Gate("SMALL_SPEND", F.col("spend") < 500000, False),
        G.Gate("MACHINERY_ONLY", F.col("c_mktsegment") == "MACHINERY", False),
    ]


_CODES_SQL = """list_sort(list_filter([CASE WHEN c_acctbal < 0 THEN 'NEGATIVE_BALANCE' END, CASE WHEN n_orders = 0 THEN 'NO_ORDERS' END], lambda x: x IS NOT NULL)) AS hard,
    list_sort(list_filter([CASE WHEN idle_days > 180 THEN 'IDLE' END, CASE WHEN spend < 500000 THEN 'SMALL_SPEND' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MACHINERY_ONLY' END], lambda x: x IS NOT NULL)) AS soft"""


@query("q14_gate_codes", f"WITH {_FEATURES_SQL}, c AS (SELECT c_custkey, {_CODES_SQL} FROM feats) SELECT c_custkey, array_to_string(hard, ',') AS hard_codes, array_to_string(soft, ',') AS soft_codes, CAST(5 - len(hard) - len(soft) AS INTEGER) AS n_passed, len(hard) > 0 AS blocked FROM c")
def q14(spark: SparkSession, d: str) -> DataFrame:
    v = G.verdict(customer_gates())
    return customer_features(spark, d).select("c_custkey", F.array_join(v["hard_codes"], ",").alias("hard_codes"), F.array_join(v["soft_codes"], ",").alias("soft_codes"), F.size(v["passed_codes"]).alias("n_passed"), v["blocked"].alias("blocked"))


@query(
    "q15_hard_soft_verdict",
    f"""WITH {_FEATURES_SQL}, c AS (SELECT *, {_CODES_SQL}, (CASE WHEN c_acctbal < 0 THEN 0.4 ELSE 0 END) + (CASE WHEN n_orders = 0 THEN 0.4 ELSE 0 END) + (CASE WHEN idle_days > 180 THEN 0.2 ELSE 0 END)
        + (CASE WHEN spend < 500000 THEN 0.2 ELSE 0 END) + (CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.2 ELSE 0 END) AS w FROM feats),
    v AS (SELECT len(hard) >= 2 OR round(least(1.0, w), 6) >= 0.6 AS impossible, unnest(list_concat(hard, soft)) AS code FROM c)
    SELECT code, count(*) AS n, CAST(count(*) FILTER (WHERE impossible) AS BIGINT) AS n_impossible FROM v GROUP BY code""",
)
def q15(spark: SparkSession, d: str) -> DataFrame:
    gates = [G.Gate(g.code, g.fires, g.hard, 0.4 if g.hard else 0.2) for g in customer_gates()]
    said = customer_features(spark, d).select(G.fired(gates).alias("codes"), ((F.size(G.fired(gates, True)) >= 2) | (F.round(G.integrity_score(gates), 6) >= 0.6)).alias("impossible"))
    return said.select("impossible", F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.count_if("impossible").alias("n_impossible"))


@query("q16_orphan_assessments", "SELECT l.doc_id FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id")
def q16(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "labels").select("doc_id").join(load(spark, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_anti")


@query(
    "q17_interval_overlap_pairs",
    """WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS n, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS e FROM lineitem)
    SELECT a.l_orderkey, CAST(a.n AS INTEGER) AS a_index, CAST(b.n AS INTEGER) AS b_index, CAST(date_diff('day', greatest(a.s, b.s), least(a.e, b.e)) AS INTEGER) AS overlap_days FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.n < b.n AND a.s < b.e AND b.s < a.e
    WHERE date_diff('day', greatest(a.s, b.s), least(a.e, b.e)) > 2""",
)
def q17(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = load(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).alias("n"), F.col("l_shipdate").cast("date").alias("s"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")).alias("e"))
    return I.overlap_pairs(lines, "l_orderkey", "n", "s", "e", grace=2)


def _covered_days(events: DataFrame) -> DataFrame:
    day = F.col("ts").cast("date")
    spans = events.select("user_id", day.alias("start"), F.date_add(day, (1 + F.col("event_id") % 4).cast("int")).alias("end"))
    # Ids below zero give intervals that end before they start; the SQL counts each of their copies, so these stay apart in the set.
    i = F.struct("start", "end", F.when(F.col("end") < F.col("start"), F.monotonically_increasing_id()).alias("copy"))
    # A user has few distinct intervals, however many events: the set is what is gathered. An event without a time or an id has none.
    some = F.collect_set("i")
    return spans.select("user_id", F.when(F.col("end").isNotNull(), i).alias("i")).groupBy("user_id").agg(F.when(F.size(some) > 0, I.union_length(some)).alias("days"))


@query(
    "q18_interval_union_length",
    """WITH i AS (SELECT user_id, CAST(ts AS DATE) AS s, CAST(ts AS DATE) + CAST(1 + event_id % 4 AS INTEGER) AS e FROM events),
    m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM i),
    g AS (SELECT *, sum(CASE WHEN upto IS NULL OR s > upto THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
    u AS (SELECT user_id, island, date_diff('day', min(s), max(e)) AS n FROM g GROUP BY 1, 2)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS days FROM u GROUP BY 1""",
)
def q18(spark: SparkSession, d: str) -> DataFrame:
    return _covered_days(load(spark, d, "events"))


@query(
    "q19_pair_deltas",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER w AS p, CAST(o_orderdate AS DATE) AS day, lag(CAST(o_orderdate AS DATE)) OVER w AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)),
    s AS (SELECT o_custkey, CASE WHEN o_totalprice > p THEN 1.0 WHEN o_totalprice = p THEN 0.6 ELSE 0.3 END AS step, date_diff('day', prev, day) + 1 AS w FROM o WHERE p IS NOT NULL)
    SELECT o_custkey, round(sum(step * w) / sum(w), 6) AS v FROM s GROUP BY 1""",
)
def q19(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    o = o.withColumns({"p": F.lag("o_totalprice").over(w), "prev": F.lag("day").over(w)}).where("p is not null")
    step = F.when(F.col("o_totalprice") > F.col("p"), 1.0).when(F.col("o_totalprice") == F.col("p"), 0.6).otherwise(0.3)
    return o.select("o_custkey", step.alias("step"), (F.date_diff("day", "prev") + 1).alias("w")).groupBy("o_custkey").agg(F.round(F.sum(F.col("step") * F.col("w")) / F.sum("w"), 6).alias("v"))


@query(
    "q20_first_last_velocity",
    """SELECT o_custkey, round(least(1.0, greatest(0.0, (arg_max(o_totalprice, (CAST(o_orderdate AS DATE), o_orderkey)) - arg_min(o_totalprice, (CAST(o_orderdate AS DATE), o_orderkey))) / 100000
        / greatest(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) / 365.25, 0.5) / 0.5)), 6) AS v FROM orders GROUP BY 1""",
)
def q20(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    at = F.struct(day.alias("day"), "o_orderkey")
    gain = (F.max_by("o_totalprice", at) - F.min_by("o_totalprice", at)) / 100000
    years = F.greatest(F.date_diff(F.max(day), F.min(day)) / 365.25, F.lit(0.5))
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.round(K.unit(gain / years / 0.5), 6).alias("v"))


@query(
    "q21_current_one_wins",
    """SELECT o_custkey, o_orderkey, o_orderstatus = 'O' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) = 1 AS current FROM orders""",
)
def q21(spark: SparkSession, d: str) -> DataFrame:
    claims = F.col("o_orderstatus") == "O"
    w = Window.partitionBy("o_custkey", "claims").orderBy(F.desc("day"), "o_orderkey")
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", claims.alias("claims"), F.col("o_orderdate").cast("date").alias("day"))
    return o.select("o_custkey", "o_orderkey", (F.col("claims") & (F.row_number().over(w) == 1)).alias("current"))


@query("q22_argmax_low_index", "SELECT l_orderkey, arg_min(l_linenumber, (-l_quantity, l_linenumber)) AS line, max(l_quantity) AS v FROM lineitem GROUP BY 1")
def q22(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("line"), F.max("l_quantity").alias("v"))


@query(
    "q23_rank_bands",
    """WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
    b AS (SELECT o_orderpriority, CASE WHEN r <= n * 0.1 THEN 'top' WHEN r <= n * 0.5 THEN 'mid' ELSE 'tail' END AS band, o_orderkey FROM r) SELECT o_orderpriority, band, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM b GROUP BY 1, 2""",
)
def q23(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority")
    r = load(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("r"), F.count("*").over(w).alias("n"))
    return r.select("o_orderpriority", "o_orderkey", R.rank_band(F.col("r"), F.col("n")).alias("band")).groupBy("o_orderpriority", "band").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "q24_tie_stabilised_display",
    """WITH t AS (SELECT o_orderkey, floor(o_totalprice / 10000) / 10 AS s FROM orders ORDER BY s DESC, o_orderkey LIMIT 500), m AS (SELECT o_orderkey, round(s, 0) AS shown FROM t)
    SELECT o_orderkey, shown, CAST(row_number() OVER (ORDER BY shown DESC, o_orderkey) AS INTEGER) AS rank FROM m""",
)
def q24(spark: SparkSession, d: str) -> DataFrame:
    top = R.top_k(load(spark, d, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice") / 10000) / 10).alias("s")), 500, "s", "o_orderkey")
    return R.display_ranks(top, "s", "o_orderkey", 0).select("o_orderkey", "shown", "rank")


@query(
    "q25_ranking_validator",
    """WITH t AS (SELECT o_orderkey AS id, o_totalprice AS score, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100),
    f AS (SELECT id, CASE WHEN rank = 40 THEN score + 1e6 ELSE score END AS score, CASE WHEN rank = 7 THEN 8 WHEN rank = 99 THEN 101 ELSE rank END AS rank FROM t),
    w AS (SELECT *, lag(score) OVER (ORDER BY rank, id) AS p, lag(id) OVER (ORDER BY rank, id) AS pid FROM f)
    SELECT code, n FROM (SELECT 'RANK_OUT_OF_RANGE' AS code, count(*) AS n FROM f WHERE rank NOT BETWEEN 1 AND 100
    UNION ALL SELECT 'DUPLICATE_RANK', count(*) FROM (SELECT rank FROM f GROUP BY rank HAVING count(*) > 1)
    UNION ALL SELECT 'MISSING_RANK', count(*) FROM (SELECT * FROM range(1, 101) r(x) ANTI JOIN f ON f.rank = r.x)
    UNION ALL SELECT 'DUPLICATE_ID', count(*) FROM (SELECT id FROM f GROUP BY id HAVING count(*) > 1)
    UNION ALL SELECT 'SCORE_INCREASING', count(*) FROM w WHERE score > p UNION ALL SELECT 'TIE_BREAK_VIOLATION', count(*) FROM w WHERE score = p AND id < pid) WHERE n > 0""",
)
def q25(spark: SparkSession, d: str) -> DataFrame:
    top = R.top_k(load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), 100, "score", "id")
    faulty = top.select("id", F.when(F.col("rank") == 40, F.col("score") + 1e6).otherwise(F.col("score")).alias("score"), F.when(F.col("rank") == 7, 8).when(F.col("rank") == 99, 101).otherwise(F.col("rank")).alias("rank"))
    return R.validate_ranking(faulty, 100)


@query(
    "q47_component_score_breakdown",
    f"""WITH {_FEATURES_SQL}, c AS (SELECT *, list_sort([f_spend, f_orders, f_recent, f_prompt, f_balance], 'DESC') AS s FROM feats)
    SELECT c_custkey, round((s[1] + s[2] + s[3]) / 3 * len(list_filter(s[1:3], lambda x: x > 0.02)) / 3.0, 6) AS breadth, round((f_recent + f_prompt) / 2, 6) AS timing,
        round(0.5 * ((s[1] + s[2] + s[3]) / 3 * len(list_filter(s[1:3], lambda x: x > 0.02)) / 3.0) + 0.3 * ((f_recent + f_prompt) / 2) + 0.2 * f_balance, 6) AS base FROM c""",
)
def q47(spark: SparkSession, d: str) -> DataFrame:
    cells = ["f_spend", "f_orders", "f_recent", "f_prompt", "f_balance"]
    raw = {"breadth": S.top_breadth(cells), "timing": S.component_mean(["f_recent", "f_prompt"]), "balance": F.col("f_balance")}
    return customer_features(spark, d).select("c_custkey", F.round(raw["breadth"], 6).alias("breadth"), F.round(raw["timing"], 6).alias("timing"), F.round(S.weighted_sum(raw, {"breadth": 0.5, "timing": 0.3, "balance": 0.2}), 6).alias("base"))


@query("q48_confidence_weighted", f"WITH {_FEATURES_SQL} SELECT c_custkey, round(((f_spend + f_orders) / 2 * 3.0 + (f_recent + f_prompt) / 2 * 1.5 + f_balance * 0.2) / 4.7, 6) AS confidence FROM feats")
def q48(spark: SparkSession, d: str) -> DataFrame:
    f = customer_features(spark, d).withColumns({"g_volume": S.group_confidence(["f_spend", "f_orders"]), "g_time": S.group_confidence(["f_recent", "f_prompt"]), "g_balance": F.col("f_balance")})
    return f.select("c_custkey", F.round(S.weighted_confidence({"g_volume": 3.0, "g_time": 1.5, "g_balance": 0.2}), 6).alias("confidence"))


@query(
    "q49_feature_contracts",
    f"""WITH {_FEATURES_SQL}, p AS (SELECT c_custkey, f_recent, f_prompt, CASE WHEN c_custkey = 7 THEN 1.5 ELSE f_balance END AS f_balance FROM feats)
    SELECT c_custkey, 'f_balance' AS fault FROM p WHERE f_balance NOT BETWEEN 0 AND 1 UNION ALL SELECT c_custkey, 'f_recent<=max(f_prompt)' FROM p WHERE f_recent > f_prompt + 1e-6""",
)
def q49(spark: SparkSession, d: str) -> DataFrame:
    f = customer_features(spark, d).withColumn("f_balance", F.when(F.col("c_custkey") == 7, 1.5).otherwise(F.col("f_balance")))
    bounds = G.bound_violations(f, "c_custkey", {c: (0.0, 1.0) for c in ("f_spend", "f_orders", "f_recent", "f_prompt", "f_balance")})
    return bounds.select("c_custkey", F.col("feature").alias("fault")).union(G.contract_violations(f, "c_custkey", at_most=[("f_recent", ["f_prompt"])]))


@query("q54_kpi_dashboard", f"{_RANKED_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY floored, score DESC, c_custkey) AS rank FROM scored) SELECT CAST(count(*) FILTER (WHERE floored = 1) AS BIGINT) AS n_floored, round(avg(n_orders) FILTER (WHERE rank <= 10), 6) AS top10_orders, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS segments, round(max(score), 6) AS best, round(min(score), 6) AS last FROM t WHERE rank <= 100")
def q54(spark: SparkSession, d: str) -> DataFrame:
    top = R.top_k(ranked_customers(spark, d), 100, "score", "c_custkey", "floored")
    return top.agg(F.count_if(F.col("floored") == 1).alias("n_floored"), F.round(F.avg(F.when(F.col("rank") <= 10, F.col("n_orders"))), 6).alias("top10_orders"), F.count_distinct("c_mktsegment").alias("segments"), F.round(F.max("score"), 6).alias("best"), F.round(F.min("score"), 6).alias("last"))


@query("q57_dot_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS n FROM embeddings")
def q57(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 5).alias("n"))
