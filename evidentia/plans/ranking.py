"""The ranking of nested records: features, vectors, gates, score, top rows, text.

One lazy plan from the lines to the top rows.  The only exchanges are the join
with the vector store by id and the rows that each task sends for the top;
structurally blocked records never reach that join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.features import cues as Q
from evidentia.features.extract import ANCHORS, extract_features
from evidentia.features.layout import CONFIDENCE_WEIGHTS, column
from evidentia.functions import kernels as K
from evidentia.operators import gates as G
from evidentia.operators import ranking as R
from evidentia.operators import scoring as S
from evidentia.operators import vectors as V
from evidentia.sources.records import PROFICIENCIES, SIGNALS

# The rank of the degrees that have one, by their whole name.
DEGREES = {"B.Tech": 1, "B.E.": 1, "B.Sc": 1, "M.E.": 2, "M.S.": 2, "M.Sc": 2, "M.Tech": 2, "Ph.D": 3}
#: Competency groups that tell of language or retrieval work.
EXPOSURE = ("retr", "rank", "recsys", "ir", "nlp", "eval")


@dataclass(frozen=True)
class Policy:
    """Thresholds and names; the defaults are the locked ones."""

    as_of: str
    rows: int = 100
    signals: str = SIGNALS
    anchors: dict[str, str] = field(default_factory=lambda: dict(ANCHORS))
    tenure_tolerance: float = 2.0
    span_tolerance: float = 1.0
    unused_least: int = 5
    career_before_study: int = 3
    hard_weight: float = 3.0
    soft_weight: float = 1.0
    honeypot_threshold: float = 0.7
    exposure_least: float = 0.05
    experience_band: tuple[float, float] = (2.0, 15.0)
    target_clusters: tuple[int, ...] = ()


def career_slice(df: DataFrame, policy: Policy) -> DataFrame:
    """``facts`` (roles, latest first, one current at most) and what gates ask about them."""
    day = F.to_date(F.lit(policy.as_of))

    def fact(r: Column, i: Column) -> Column:
        company, industry, text = F.lower(r["company"]), F.lower(r["industry"]), F.lower(r["description"])
        return F.struct(
            (-F.unix_date(r["start_date"])).alias("order"), i.alias("index"), r["is_current"].alias("claims"), r["company"].alias("company"), r["title"].alias("title"), r["start_date"].alias("start"), r["end_date"].alias("end"),
            r["duration_months"].alias("months"), industry.isin(*Q.PRODUCT_INDUSTRIES).alias("product"), (K.any_cue(company, Q.SLICE_FIRMS) | F.contains(industry, F.lit("consulting")) | F.contains(text, F.lit("consulting"))).alias("consulting"),
        )

    df = df.withColumn("facts", F.array_sort(F.transform("career_history", fact)))
    first = F.array_min(F.transform(F.filter("facts", lambda f: f["claims"]), lambda f: F.struct(f["order"], f["index"])))
    df = df.withColumn("current", F.get(F.filter("facts", lambda f: f["claims"] & (F.struct(f["order"], f["index"]) == first)), F.lit(0)))
    months = lambda keep: F.aggregate(F.transform(F.filter("facts", keep), lambda f: f["months"].cast("double")), F.lit(0.0), lambda a, x: a + x)
    total, product = months(lambda f: F.lit(True)), months(lambda f: f["product"])
    services = total - product
    positive = F.filter(F.transform("facts", lambda f: f["months"].cast("double")), lambda m: m > 0)
    last = F.col("facts")[0]
    names = F.transform("skill_rows", lambda x: x["name"])
    last_named = F.filter("skill_rows", lambda s, i: ~F.array_contains(F.slice(names, i + 2, F.size("skill_rows")), s["name"]))
    return df.withColumns(
        {
            "total_months": total,
            "derived_years": F.least(total / 12, F.lit(50.0)),
            "track": F.when(total == 0, "unknown").when(product >= 2 * services, "product").when(services >= 2 * product, "services").otherwise("mixed"),
            "mean_tenure": K.mean_array(positive),
            "hop_rate": F.size(F.filter(positive, lambda m: m < 18)) / F.size("facts"),
            "months_since_last": F.when(F.col("current").isNotNull(), 0).otherwise(F.greatest(F.bround(F.date_diff(day, F.coalesce(last["end"], day)) / 30.4375, 0), F.lit(0.0))),
            "product_role": F.exists("facts", lambda f: f["product"]),
            "product_current": F.coalesce(F.col("current")["product"], F.lit(False)),
            "all_consulting": F.forall("facts", lambda f: f["consulting"]),
            # Of skills that are named twice the last counts, in a share of all.
            "n_credible": F.size(F.filter(last_named, lambda s: s["trust"] >= 0.5)),
            "stuffing": K.mean_array(F.transform("skill_rows", lambda s: F.when(s["advanced"] & s["unused"] & s["unendorsed"], 1.0).otherwise(0.0))),
        }
    ).withColumn("gap", F.when(F.size("skill_rows") > 0, 1 - F.col("n_credible") / F.size("skill_rows")).otherwise(0.0))


def integrity_gates(policy: Policy) -> list[G.Gate]:
    """G-I1 to G-I7; those of single roles and studies fire once a record here, ``integrity_findings`` tells which they are."""
    edu, p, s = F.col("education"), F.col("profile"), F.col(policy.signals)
    backwards = F.exists(edu, lambda a: F.exists(edu, lambda b: _backwards(a, b)))
    unused = F.size(F.filter("skill_rows", lambda x: x["advanced"] & x["unused"]))
    first_role, first_study = F.array_min(F.transform("facts", lambda f: F.year(f["start"]))), F.array_min(F.transform(edu, lambda e: e["start_year"]))
    hard, soft = policy.hard_weight, policy.soft_weight
    return [
        G.Gate("tenure_exceeds_experience", F.col("total_months") / 12 > p["years_of_experience"] + policy.tenure_tolerance, True, hard),
        G.Gate("role_duration_date_mismatch", F.size(_mismatched(policy)) > 0, False, soft),
        G.Gate("current_role_has_end_date", F.size(_ended_current()) > 0, True, hard),
        G.Gate("expert_skill_zero_usage", unused >= policy.unused_least, True, hard),
        G.Gate("education_timeline_impossible", F.exists(edu, lambda e: e["end_year"] < e["start_year"]) | backwards, True, hard),
        G.Gate("career_before_education", first_role < first_study - policy.career_before_study, True, hard),
        G.Gate("assessment_for_absent_skill", F.size(G.orphans(F.map_keys(s["skill_assessment_scores"]), F.transform("skills", lambda x: x["name"]))) > 0, True, hard),
    ]


def _degree(d: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in DEGREES.items() for x in (k, v)])[d]


def _backwards(a: Column, b: Column) -> Column:
    """J-8: a degree that begins after a higher one has ended; degrees without a rank compare with none."""
    return F.coalesce((_degree(a["degree"]) < _degree(b["degree"])) & (a["start_year"] > b["end_year"]), F.lit(False))


def _mismatched(policy: Policy) -> Column:
    """Roles that have ended and whose dates do not give their duration."""
    return F.filter("facts", lambda f: f["end"].isNotNull() & (F.abs(K.month_span(f["start"], f["end"]) - f["months"]) > policy.span_tolerance))


def _ended_current() -> Column:
    return F.filter("facts", lambda f: f["claims"] & f["end"].isNotNull() & (f["index"] == F.col("current")["index"]))


def integrity_findings(df: DataFrame, policy: Policy) -> DataFrame:
    """G-I2, G-I3, G-I5, G-I5b role by role and degree by degree: (candidate_id, code, path), the path into the record as it came.

    ``df`` is a career slice.  A degree is told once, against the first higher one that it follows.
    """
    at = lambda xs, code, field: F.transform(xs, lambda f: F.struct(F.lit(code).alias("code"), F.concat(F.lit("career_history["), f["index"], F.lit(f"].{field}")).alias("path")))
    edu = F.transform("education", lambda e, i: F.struct(i.alias("index"), e["degree"].alias("degree"), e["start_year"].alias("start_year"), e["end_year"].alias("end_year")))
    studies = lambda keep, field: F.transform(F.filter(edu, keep), lambda e: F.struct(F.lit("education_timeline_impossible").alias("code"), F.concat(F.lit("education["), e["index"], F.lit(f"].{field}")).alias("path")))
    found = F.concat(
        at(_mismatched(policy), "role_duration_date_mismatch", "duration_months"),
        at(_ended_current(), "current_role_has_end_date", "end_date"),
        studies(lambda e: e["end_year"] < e["start_year"], "end_year"),
        studies(lambda e: F.exists("education", lambda b: _backwards(e, b)), "degree"),
    )
    return df.select("candidate_id", F.explode(found).alias("f")).select("candidate_id", "f.code", "f.path")


def finding_counts(policy: Policy) -> dict[str, Column]:
    return {"role_duration_date_mismatch": F.size(_mismatched(policy)), "current_role_has_end_date": F.size(_ended_current())}


def offline_gates(policy: Policy) -> list[G.Gate]:
    """G-O1 to G-O7: the detectors of the profiling run, with their own constants."""
    edu, p, s = F.col("education"), F.col("profile"), F.col(policy.signals)
    names = F.transform("skills", lambda x: F.lower(x["name"]))
    years = p["years_of_experience"]
    stuffed = F.size(F.filter("skill_rows", lambda x: x["advanced"] & x["unused"] & x["unendorsed"]))
    return [
        G.Gate("current_role_has_end_date", F.exists("facts", lambda f: f["claims"] & f["end"].isNotNull()), True),
        G.Gate("role_duration_date_mismatch", F.exists("facts", lambda f: f["end"].isNotNull() & (F.abs(K.months_between_ym(f["start"], f["end"]) - f["months"]) > 6)), False, 0.35),
        G.Gate("tenure_exceeds_experience", (years > 0) & (F.col("total_months") / 12 > 1.5 * years), True),
        G.Gate("expert_skill_zero_usage", F.size(F.filter("skills", lambda x: (x["proficiency"] == PROFICIENCIES[-1]) & (F.coalesce(x["duration_months"], F.lit(0)) == 0))) >= 5, True),
        G.Gate("education_timeline_impossible", F.exists(edu, lambda e: e["end_year"] < e["start_year"]), True),
        G.Gate("keyword_stuffing", stuffed >= 8, False, 0.35),
        G.Gate("assessment_for_absent_skill", F.size(G.orphans(F.transform(F.map_keys(s["skill_assessment_scores"]), F.lower), names)) > 0, True),
    ]


def structural_gates(policy: Policy) -> list[G.Gate]:
    """G-ES: hard gates that need no vector."""
    return [
        G.Gate("langchain_openai_only_recent", (F.col("stuffing") >= 0.6) & (F.col("gap") >= 0.3), True),
        G.Gate("no_production_code_18m", ~F.col("product_current") & (F.col("months_since_last") > 18), True),
        G.Gate("consulting_firms_only_career", F.col("all_consulting"), True),
    ]


def eligibility_gates(policy: Policy) -> list[G.Gate]:
    """G-E1 to G-E10."""
    lo, hi = policy.experience_band
    return [
        G.Gate("pure_research_no_production", ~F.col("product_role") & (F.col("net_fit") >= 0.5) & F.col("track").isin("services", "unknown"), True),
        *structural_gates(policy),
        G.Gate("primary_cv_speech_robotics_no_nlp", S.top_breadth([column(g, "competency") for g in EXPOSURE], exponent=2.0) < policy.exposure_least, True),
        G.Gate("closed_source_5y_no_validation", (F.col("derived_years") >= 5) & (F.col("n_credible") <= 0), True),
        G.Gate("title_chaser_sub_18m_hops", F.col("hop_rate") >= 0.5, False),
        G.Gate("notice_over_30", F.col(policy.signals)["notice_period_days"] > 60, False),
        G.Gate("outside_india_no_sponsor", F.col("location_fit") == "outside", False),
        G.Gate("outside_experience_band", ~F.col("derived_years").between(lo, hi), False),
    ]


SOFT_PRIORITY = ("outside_india_no_sponsor", "title_chaser_sub_18m_hops", "outside_experience_band", "notice_over_30")


def score_records(records: DataFrame, policy: Policy, vectors: DataFrame | None = None, anchors: DataFrame | None = None, centroids: DataFrame | None = None) -> DataFrame:
    """Every record with features, gate codes and score; none is dropped.

    ``vectors`` (id, vector) is asked only about records that no structural gate
    blocks.  A record whose vector is missing is scored without similarities.
    """
    day = policy.as_of
    if vectors is not None and anchors is not None:
        base = extract_features(records, day, None, policy.anchors, policy.signals)
        early = career_slice(base, policy).select("candidate_id", (F.size(G.fired(structural_gates(policy))) > 0).alias("settled"))
        wanted = early.where(~F.col("settled")).select(F.col("candidate_id").alias("id"))
        met = vectors.join(wanted, "id", "left_semi")
        fit = V.semantic_fit(V.anchor_similarities(met, "vector", anchors))
        cells = [F.col("id").alias("candidate_id"), F.map_from_arrays(F.transform("similar", lambda x: x["id"]), F.transform("similar", lambda x: x["cos"])).alias("similarities"), "net_fit", "best_anchor"]
        if centroids is not None:
            fit = V.nearest_centroids(fit, "vector", centroids)
            cells += ["centroid", "membership"]
        records = records.join(fit.select(*cells), "candidate_id", "left")
    for c, kind in (("similarities", "map<string,double>"), ("net_fit", "double"), ("best_anchor", "string"), ("centroid", "int"), ("membership", "double")):
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast(kind))
    records = records.withColumn("net_fit", F.coalesce("net_fit", F.lit(0.5)))
    f = career_slice(extract_features(records, day, "similarities", policy.anchors, policy.signals, keep=("net_fit", "best_anchor", "centroid", "membership")), policy)

    integrity = integrity_gates(policy)
    f = f.withColumns({"integrity_codes": G.fired(integrity), "is_honeypot": G.integrity_verdict(integrity, policy.honeypot_threshold)})
    settled = G.fired(structural_gates(policy))
    f = f.withColumn("settled_codes", settled)
    every = G.verdict(eligibility_gates(policy))
    # What is settled early reports its structural codes only; nothing else of it was evaluated.
    f = f.withColumns({"hard_codes": F.when(F.size("settled_codes") > 0, F.col("settled_codes")).otherwise(every["hard_codes"]), "soft_codes": F.when(F.size("settled_codes") > 0, F.array().cast("array<string>")).otherwise(every["soft_codes"])})

    s = F.col(policy.signals)
    target = F.coalesce(F.col("centroid").isin(*policy.target_clusters), F.lit(False)) if policy.target_clusters else F.lit(False)
    raw = {
        "skill_match": S.top_breadth([column(g, "competency") for g in Q.CONCEPTS]),
        "semantic_fit": F.col("net_fit"),
        "career_fit": S.component_mean(["career__progression_quality", "pvs__product_density"]),
        "experience_fit": S.component_mean([F.lit(0.5), "career__experience_authenticity"]),
        "education_fit": S.component_mean(["edu__tier_score", "edu__field_relevance", "edu__timeline_valid"]),
        "credibility": S.component_mean(["cons__skill_role_coherence", "cons__title_role_coherence", "cons__summary_coherence"]),
        "archetype_fit": F.when(target, F.coalesce("membership", F.lit(0.0))).otherwise(0.0),
    }
    f = f.withColumns({f"raw_{k}": v for k, v in raw.items()})
    offered = s["offer_acceptance_rate"]
    idle = F.greatest(F.date_diff(F.to_date(F.lit(day)), s["last_active_date"]), F.lit(0))
    families = {
        "availability": F.when(s["open_to_work_flag"], 1.0).otherwise(0.4),
        "responsiveness": K.unit(s["recruiter_response_rate"]),
        "engagement": K.recency(idle, 90),
        "reliability": K.unit(s["interview_completion_rate"]),
        "verification": F.when(offered >= 0, K.unit(offered)),
    }
    f = f.withColumns(
        {
            "base": S.weighted_sum({k: F.col(f"raw_{k}") for k in raw}),
            "behaviour": S.behaviour_multiplier(families),
            "logistics": S.logistics_multiplier(F.col("location_fit"), s["notice_period_days"], F.col("sal__is_inverted") == 1),
            "adjustment": S.archetype_adjustment(target, F.coalesce("membership", F.lit(0.0))),
            "confidence": S.weighted_confidence(CONFIDENCE_WEIGHTS),
            "floored": F.col("is_honeypot") | (F.size("hard_codes") > 0),
        }
    )
    return f.withColumn("score", S.final_score(F.col("base"), F.col("behaviour"), F.col("logistics"), F.col("adjustment"), F.col("confidence"), F.col("floored")))


def rank_records(scored: DataFrame, policy: Policy, exact: bool = True) -> DataFrame:
    """The top rows; floored ones come after all others."""
    return R.top_k(scored, policy.rows, "score", "candidate_id", "floored", exact)


def gate_histogram(scored: DataFrame) -> DataFrame:
    return G.histogram(scored, "hard_codes", "soft_codes")


def report(scored: DataFrame, ranked: DataFrame, policy: Policy) -> dict[str, object]:
    """SNK-5: counts over all records and a digest of the shown scores."""
    sums = scored.agg(F.count("*").alias("records"), F.count_if("is_honeypot").alias("honeypots"), F.count_if("floored").alias("floored"), F.count_if(F.size("settled_codes") > 0).alias("settled_early")).first().asDict()
    digest = ranked.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.format_string("%.6f", F.bround("score", 6)))), ","), 256).alias("d")).first().d
    return {"reproducible": {"as_of": policy.as_of, "counts": sums, "codes": {r.code: r.n for r in gate_histogram(scored).orderBy("code").collect()}, "score_digest": digest}}
