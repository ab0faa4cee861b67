"""All features of a record in one narrow pass: projections over its own arrays, no join, no shuffle.

The work is cut into a few projections.  What later ones use more than once is a
column of an earlier one, so it is computed once, and no projection's generated
code grows too large.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import kernels as K
from evidentia.functions import text as T
from evidentia.operators.intervals import union_length
from evidentia.sources.records import PROFICIENCIES, SIGNALS, SIZES

from . import cues as Q
from .layout import CONFIDENCES, GROUPS, LAYOUT, column

#: Anchors of the competency concepts; a concept whose anchor is not among the similarities has semantic 0.
ANCHORS = {g: f"jd.{g}" for g in Q.CONCEPTS}
ADVANCED = PROFICIENCIES.index("advanced") + 1


def _flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


def _array_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _no_use(s: Column) -> Column:
    return F.coalesce(s["duration_months"], F.lit(0)) == 0


def _advanced(s: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PROFICIENCIES)), s["proficiency"]) >= ADVANCED


def _tokens(text: Column) -> Column:
    return T.token_set(text, stopwords=Q.STOPWORDS)


def _roles(df: DataFrame, as_of: Column) -> DataFrame:
    """``roles``: each role with its texts, dates and weights; then with its cue counts as scores."""

    def texts(r: Column, i: Column) -> Column:
        desc, company, industry = (T.collapse(F.lower(r[c])) for c in ("description", "company", "industry"))
        end = F.when(r["is_current"] | r["end_date"].isNull(), as_of).otherwise(r["end_date"])
        tenure = F.greatest(r["duration_months"].cast("double"), F.lit(0.0))
        return F.struct(
            r["start_date"].alias("start"), i.alias("index"), end.alias("end"), r["end_date"].alias("end_date"), r["is_current"].alias("is_current"), r["duration_months"].cast("double").alias("months"),
            T.collapse(F.lower(r["title"])).alias("title"), desc.alias("desc"), company.alias("company"), industry.alias("industry"), F.concat_ws(" ", desc, industry, company).alias("blob"), r["description"].alias("description"),
            F.array_position(F.array(*map(F.lit, SIZES)), r["company_size"]).cast("double").alias("size"), tenure.alias("wt"), K.recency(F.date_diff(as_of, end), 180).alias("wr"),
        )

    def scores(r: Column) -> Column:
        title = K.ladder_rank(r["title"], Q.TITLE_LADDER, Q.TITLE_DEFAULT)
        # A title without any cue counts as the default; one whose best cue is below it, too.
        title = F.greatest(title, F.lit(Q.TITLE_DEFAULT))
        described = r["desc"] != ""
        scope = F.when(described, F.greatest(K.ladder_rank(r["desc"], Q.SCOPE_LADDER, Q.SCOPE_DEFAULT), F.lit(Q.SCOPE_DEFAULT))).otherwise(Q.SCOPE_DEFAULT)
        firm = K.any_cue(r["company"], Q.CONSULTING_FIRMS)
        consulting = F.greatest(K.cue_presence(r["blob"], Q.CONSULTING_CUES, 2), _flag(firm))
        named = [(r[c]).alias(c) for c in ("start", "index", "end", "end_date", "is_current", "months", "title", "desc", "company", "industry", "blob", "description", "size", "wt", "wr")]
        return F.struct(
            *named, (r["wt"] * r["wr"]).alias("wc"), title.alias("title_rank"), scope.alias("scope_rank"), described.alias("described"), F.when(described, 0.6 * scope + 0.4 * title).otherwise(0.5 * title).alias("level"), consulting.alias("consulting"),
            K.cue_presence(r["blob"], Q.PRODUCT_CUES, 2).alias("product_cues"), K.cue_presence(r["blob"], Q.CODING_CUES, 3).alias("coding"), K.cue_presence(r["blob"], Q.ARCHITECTURE_CUES, 2).alias("arch"),
            K.cue_presence(r["blob"], Q.RESEARCH_CUES, 2).alias("research"), K.cue_presence(r["blob"], Q.MANAGEMENT_CUES, 2).alias("mgmt"), K.cue_presence(r["blob"], Q.PRODUCTION_CUES, 2).alias("production"),
            F.filter(K.cue_array(Q.TECH_NAMES), lambda c: F.contains(r["blob"], c)).alias("tech"),
        )

    def derived(r: Column) -> Column:
        return F.struct(*(r[c].alias(c) for c in _ROLE), K.unit(r["product_cues"] * (1 - 0.5 * r["consulting"])).alias("product"), K.unit(r["coding"] - 0.5 * r["arch"]).alias("hands_on"))

    out = df.withColumn("__t", F.transform("career_history", texts))
    out = out.withColumn("__s", F.transform("__t", scores))
    out = out.withColumn("roles", F.transform("__s", derived)).drop("__t", "__s")
    return out.withColumn("chron", F.array_sort(F.col("roles")))


_ROLE = (
    "start", "index", "end", "end_date", "is_current", "months", "title", "desc", "company", "industry", "blob", "description", "size", "wt", "wr", "wc",
    "title_rank", "scope_rank", "described", "level", "consulting", "coding", "arch", "research", "mgmt", "production", "tech",
)


def _over(score: str, weight: str, roles: str = "roles") -> Column:
    return K.weighted_mean(F.transform(roles, lambda r: r[score]), F.transform(roles, lambda r: r[weight]))


def _steps(of: str, judge) -> Column:
    """W-2: neighbours in order of time, each step weighted by both tenures."""
    n = F.size("chron")
    first, second = F.slice("chron", F.lit(1), n - 1), F.slice("chron", F.lit(2), n - 1)
    values = F.zip_with(first, second, lambda a, b: judge(b[of] - a[of]))
    weights = F.zip_with(first, second, lambda a, b: a["wt"] + b["wt"])
    return K.weighted_mean(values, weights)


def _career(n: Column) -> dict[str, Column]:
    positive = F.filter(F.transform("roles", lambda r: r["months"]), lambda m: m > 0)
    level = lambda d: F.when(d > 0.25, 1.0).when(d >= -0.25, 0.6).otherwise(0.2)
    size = lambda d: F.when(d > 0, 1.0).when(d == 0, 0.6).otherwise(0.3)
    one = n == 1
    first, last = F.col("chron")[0], F.element_at("chron", -1)
    years = F.greatest(F.greatest(F.date_diff(last["start"], first["start"]), F.lit(0)) / 365.25, F.lit(0.5))
    levels = F.transform("roles", lambda r: r["level"])
    product = F.size(F.filter("roles", lambda r: r["product"] >= 0.5))
    consulting = F.size(F.filter("roles", lambda r: r["consulting"] >= 0.5))
    union = union_length(F.transform(F.filter("chron", lambda r: r["end"] > r["start"]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))))
    union_years = F.least(union / 365.25, F.lit(50.0))
    stated = F.col("profile")["years_of_experience"]
    inflation = F.transform("roles", lambda r: F.when(r["described"], K.unit(F.greatest(r["title_rank"] - r["scope_rank"], F.lit(0.0)) / 3)).otherwise(0.6 * r["title_rank"] / 5))
    return {
        "progression_quality": F.when(one, 0.5).otherwise(_steps("level", level)),
        "stability": K.unit(0.5 * K.bounded_log(K.mean_array(positive), 36) + 0.5 * (1 - F.size(F.filter(positive, lambda m: m < 18)) / n)),
        "promotion_velocity": F.when(one, 0.3).otherwise(K.unit((last["level"] - first["level"]) / years / 0.5)),
        "title_inflation": K.unit(K.weighted_mean(inflation, F.transform("roles", lambda r: r["wt"]))),
        "role_consistency": F.when(one, 0.7).otherwise(K.unit(0.6 * (1 - (F.array_max(levels) - F.array_min(levels)) / 5) + 0.4 * F.greatest(product, consulting, n - product - consulting) / n)),
        "experience_authenticity": K.unit(1 - F.abs(stated - union_years) / F.greatest(stated, union_years, F.lit(1.0))),
        "company_progression": F.when(one, 0.5).otherwise(_steps("size", size)),
        "product_company_density": K.unit(_over("product", "wc")),
        "consulting_density": K.unit(_over("consulting", "wc")),
        "technical_depth": K.unit(0.6 * _over("coding", "wt") + 0.4 * K.bounded_log(F.size(F.array_distinct(F.flatten(F.transform("roles", lambda r: r["tech"])))), 8)),
        "hands_on_engineering": K.unit(_over("hands_on", "wr")),
        "production_exposure": K.unit(_over("production", "wc")),
    }


def _competencies(similarities: Column | None, anchors: Mapping[str, str]) -> list[Column]:
    """The cells of each concept that its competency and the latents are built of."""
    out: dict[str, Column] = {}
    for g, tokens in Q.CONCEPTS.items():
        known = F.array(*map(F.lit, tokens))
        matched = _matched(known)
        trusts = F.transform(matched, lambda s: s["trust"])
        sim = F.try_element_at(similarities, F.lit(anchors[g])) if similarities is not None else F.lit(None).cast("double")
        out[column(g, "claimed")] = K.bounded_log(F.size(matched), 4)
        out[column(g, "trust")] = K.unit(K.noisy_or(trusts))
        out[column(g, "in_career")] = F.size(F.array_intersect(known, F.col("career_tokens"))) / F.lit(float(len(tokens)))
        out[column(g, "semantic")] = F.coalesce(K.unit((sim.cast("double") + 1) / 2), F.lit(0.0))
        out[f"{g}__known"] = sim.isNotNull()
    return [c.alias(n) for n, c in out.items()]


def _matched(known: Column) -> Column:
    return F.filter("skill_rows", lambda s: F.arrays_overlap(s["tokens"], known))


def extract_features(records: DataFrame, as_of: str, similarities: str | None = None, anchors: Mapping[str, str] = ANCHORS, signals: str = SIGNALS, keep: tuple[str, ...] = ()) -> DataFrame:
    """candidate_id, the record's fields, 145 features, 32 confidences.

    ``records`` has the fields of a record as columns; ``similarities`` names a
    map column from anchor to cosine.
    """
    day = F.to_date(F.lit(as_of))
    s, p = F.col(signals), F.col("profile")
    df = _roles(records, day)
    scores = s["skill_assessment_scores"]

    def skill(x: Column) -> Column:
        assessed = F.coalesce(K.unit(F.try_element_at(scores, x["name"]) / 100), F.lit(0.0))
        used = F.coalesce(K.bounded_log(x["duration_months"], 36), F.lit(0.0))
        trust = K.unit(0.4 * K.bounded_log(x["endorsements"], 50) + 0.3 * used + 0.3 * assessed)
        return F.struct(x["name"].alias("name"), _tokens(x["name"]).alias("tokens"), F.split(F.lower(x["name"]), r"\s+").alias("words"), trust.alias("trust"), _advanced(x).alias("advanced"), _no_use(x).alias("unused"), (x["endorsements"] == 0).alias("unendorsed"), x["duration_months"].isNull().alias("no_months"))

    unhedged = F.transform("roles", lambda r: _tokens(T.without_hedges(r["description"], Q.HEDGES)))
    df = df.withColumns(
        {
            "skill_rows": F.transform("skills", skill),
            "career_tokens": T.union_sets(unhedged),
            "role_words": F.array_distinct(F.flatten(F.transform("roles", lambda r: F.split(F.lower(r["description"]), r"\s+")))),
            "n_roles": F.size("roles").cast("double"),
        }
    )

    n = F.col("n_roles")
    cells = {column("career", k): c for k, c in _career(n).items()}
    competency = _competencies(F.col(similarities) if similarities else None, anchors)
    kept = ["candidate_id", "profile", "career_history", "education", "skills", signals, "roles", "skill_rows", "role_words", "career_tokens", "n_roles", *keep]
    df = df.select(*kept, *([similarities] if similarities and similarities not in kept else []), *(c.alias(k) for k, c in cells.items()), *competency)

    # Signals, places, studies: from the record alone.
    idle = F.date_diff(day, s["last_active_date"])
    views, found, saves = K.bounded_log(s["profile_views_received_30d"], 200), K.bounded_log(s["search_appearance_30d"], 100), K.bounded_log(s["saved_by_recruiters_30d"], 40)
    is_open = _flag(s["open_to_work_flag"])
    recency = K.recency(idle, 180)
    city, country = T.collapse(F.lower(p["location"])), F.lower(F.trim(p["country"]))
    in_hub = city.isin(*Q.HUBS) | T.before_comma(city).isin(*Q.HUBS)
    india = country.isin("india", "in")
    fit = F.when(~india, "outside").when(in_hub, "hub").when(s["willing_to_relocate"], "relocatable").otherwise("non_relocatable")
    salary = s["expected_salary_range_inr_lpa"]
    interview = K.unit(s["interview_completion_rate"])
    offered = s["offer_acceptance_rate"]
    github = s["github_activity_score"]
    cited = F.size(F.filter("roles", lambda r: K.any_cue(F.lower(r["description"]), Q.OPEN_SOURCE_CUES)))
    coherent = K.unit(1 - 0.5 * (_flag((s["saved_by_recruiters_30d"] > 0) & (s["profile_views_received_30d"] == 0)) + _flag((s["connection_count"] == 0) & (s["profile_views_received_30d"] > 50))))
    edu = F.col("education")
    good_years = lambda e: (e["end_year"] >= e["start_year"]) & (e["start_year"] >= 1950) & (e["end_year"] <= F.year(day)) & (e["end_year"] - e["start_year"] <= 15)
    tier = F.create_map(*[F.lit(x) for k, v in Q.TIER_SCORES.items() for x in (k, v)])
    df = df.withColumns(
        {
            "location_fit": fit,
            "geo__hub_match": _flag((fit == "hub") | in_hub),
            "geo__india_relocatable": _flag(fit.isin("hub", "relocatable")),
            "geo__outside_india_no_sponsor": _flag(fit == "outside"),
            "exp__years": p["years_of_experience"],
            "edu__tier_score": F.coalesce(F.array_max(F.transform(edu, lambda e: tier[e["tier"]])), F.lit(0.0)),
            "edu__field_relevance": F.coalesce(F.array_max(F.transform(edu, lambda e: K.ladder_rank(T.collapse(F.lower(e["field_of_study"])), Q.FIELD_RELEVANCE, 0.0))), F.lit(0.0)),
            "edu__timeline_valid": _flag(F.forall(edu, good_years)),
            "oss__activity": F.when(github != -1, K.unit(github / 100)).otherwise(0.0),
            "oss__has_external_validation": K.unit(0.6 * _flag((github != -1) & (github > 20)) + 0.6 * K.bounded_log(cited, 3)),
            "startup__small_co_experience": _flag(F.exists("career_history", lambda r: r["company_size"].isin("1-10", "11-50"))),
            "found__ownership": _flag(F.exists("roles", lambda r: K.any_cue(r["title"], Q.FOUNDER_TITLES))),
            "avail__open": is_open,
            "avail__recency": recency,
            "avail__available": K.unit(recency * (0.5 + 0.5 * is_open)),
            "eng__passive": K.mean_of(views, found, saves),
            "eng__active": K.bounded_log(s["applications_submitted_30d"], 30),
            "eng__network": K.bounded_log(s["connection_count"], 1500),
            "resp__rate": K.unit(s["recruiter_response_rate"]),
            "resp__speed": K.inverse_bounded(s["avg_response_time_hours"], 24),
            "sal__fit": F.lit(0.5),
            "sal__is_inverted": _flag(salary["min"] > salary["max"]),
            "reloc__willing": _flag(s["willing_to_relocate"]),
            "reloc__needed": _flag(~((fit == "hub") | in_hub)),
            "notice__fit": F.when(s["notice_period_days"] <= 30, 1.0).when(s["notice_period_days"] <= 60, 0.6).otherwise(0.25),
            "notice__over_30": _flag(s["notice_period_days"] > 30),
            "saves": saves,
            "github_known": github != -1,
            "offer_known": offered != -1,
            "reliability": F.when(offered != -1, K.mean_of(interview, K.unit(offered))).otherwise(interview),
            "unknowns": K.mean_of(_flag(github == -1), _flag(offered == -1), _flag(F.size(scores) == 0)),
            "bhv__interview_reliability": interview,
            "bhv__freshness": K.unit(0.7 * K.recency(idle, 90) + 0.3 * K.recency(F.date_diff(day, s["signup_date"]), 365)),
            "bhv__trust": K.unit(0.4 * K.unit(s["profile_completeness_score"] / 100) + 0.6 * K.mean_of(_flag(s["verified_email"]), _flag(s["verified_phone"]), _flag(s["linkedin_connected"]))),
            "bhv__signal_consistency": coherent,
            "active_recency": K.recency(idle, 90),
        }
    )
    df = _detectors(df, day, s, p)
    title_tokens = _tokens(p["current_title"])
    current = F.coalesce(F.get(F.filter("roles", lambda r: r["is_current"]), F.lit(0))["description"], F.get(F.col("roles"), F.lit(0))["description"])
    competencies = {}
    for g in Q.CONCEPTS:
        t, c, m = (F.col(column(g, k)) for k in ("trust", "in_career", "semantic"))
        both = (t + c + m) / 3
        competencies[column(g, "competency")] = K.unit(F.least(0.25 * t + 0.5 * c + 0.25 * m, both) - 0.5 * K.unit(F.col(column(g, "claimed")) - both))
    c = F.col
    df = df.withColumns(
        competencies
        | {
            "career__research_only": K.unit(_over("research", "wt") * (1 - c("career__production_exposure"))),
            "career__management_only": K.unit(_over("mgmt", "wt") * (1 - F.greatest(_over("coding", "wt"), c("career__hands_on_engineering")))),
            "pvs__product_recent": K.unit(_over("product", "wr")),
            "resp__reliable": K.mean_of(c("resp__rate"), c("resp__speed")),
            "eng__velocity": K.unit(0.5 * c("eng__active") + 0.5 * c("eng__passive")),
            "cons__title_role_coherence": T.overlap_ratio(title_tokens, _tokens(F.coalesce(current, F.lit("")))),
            "cons__skill_role_coherence": T.overlap_ratio(T.union_sets(F.transform("skill_rows", lambda x: x["tokens"])), c("career_tokens")),
            "cons__summary_coherence": T.overlap_ratio(F.array_union(_tokens(p["summary"]), _tokens(p["headline"])), F.array_union(c("career_tokens"), title_tokens)),
            "bhv__market_demand": K.mean_of(c("eng__passive"), c("saves")),
            "bhv__recruitability": K.mean_of(c("avail__open"), c("resp__reliable"), c("saves")),
        }
    )
    df = df.withColumns(
        {
            "id__is_valid_id": F.lit(1.0),
            "exp__in_band": F.lit(0.5),
            "exp__derived_vs_stated_gap": 1 - c("career__experience_authenticity"),
            "sen__level": c("career__progression_quality"),
            "sen__title_vs_scope_gap": c("career__title_inflation"),
            "co__scale_progression": c("career__company_progression"),
            "co__industry_relevance": c("career__product_company_density"),
            "pvs__product_density": c("career__product_company_density"),
            "pvs__consulting_density": c("career__consulting_density"),
            "lead__scope": 1 - c("career__management_only"),
            "lead__management_only": c("career__management_only"),
            "startup__shipping_signal": c("career__production_exposure"),
            "found__breadth": F.lit(0.5),
            "bhv__availability": c("avail__available"),
            "bhv__response_reliability": c("resp__reliable"),
            "bhv__recruiter_attractiveness": c("bhv__market_demand"),
            "bhv__market_momentum": K.unit(c("bhv__market_demand") * c("active_recency")),
            "bhv__engagement_velocity": K.unit(0.6 * c("eng__active") + 0.4 * c("eng__passive")),
            "bhv__candidate_temperature": K.unit(c("avail__available") * c("active_recency") * (0.5 + 0.5 * c("eng__active"))),
            "bhv__hiring_probability_proxy": K.unit(c("avail__available") * c("resp__reliable") * c("reliability")),
            "bhv__behavioral_confidence": K.unit(0.5 * (1 - c("unknowns")) + 0.5 * c("bhv__signal_consistency")),
            "bhv__behavioral_risk": K.mean_of(1 - c("avail__available"), 1 - c("reliability"), 1 - c("bhv__signal_consistency")),
        }
        | _latents()
    )
    df = df.withColumns(_confidences())
    extra = [x for x in ("location_fit",) if x not in keep]
    return df.select("candidate_id", "profile", "career_history", "education", "skills", signals, *keep, *([similarities] if similarities and similarities not in keep else []), "roles", "skill_rows", "n_roles", *extra, *LAYOUT, *CONFIDENCES)


def _detectors(df: DataFrame, day: Column, s: Column, p: Column) -> DataFrame:
    """G-H1 to G-H13."""
    years = p["years_of_experience"]
    end = lambda r: F.coalesce(r["end_date"], day)
    overlap = lambda a, b: F.greatest(F.date_diff(F.least(end(a), end(b)), F.greatest(a["start"], b["start"])) / 30.0 - 2, F.lit(0.0))
    # A record has ten roles at most, so pairs within it are few.
    overlaps = F.aggregate(F.flatten(F.transform("roles", lambda a: F.transform(F.filter("roles", lambda b: b["index"] > a["index"]), lambda b: overlap(a, b)))), F.lit(0.0), lambda x, y: x + y)
    edu = F.col("education")
    unused = F.size(F.filter("skill_rows", lambda x: x["advanced"] & x["unused"])).cast("double")
    stuffed = F.size(F.filter("skill_rows", lambda x: x["advanced"] & x["unused"] & x["unendorsed"] & ~F.arrays_overlap(x["words"], F.col("role_words")))).cast("double")
    first_role = F.array_min(F.transform("roles", lambda r: F.year(r["start"])))
    first_study = F.array_min(F.transform(edu, lambda e: e["start_year"]))
    gap = _array_sum(F.transform("roles", lambda r: r["months"])) / 12 - years
    hidden = (s["saved_by_recruiters_30d"] > 0) & (s["profile_views_received_30d"] == 0)
    odd = _flag(hidden) + _flag(hidden & (s["search_appearance_30d"] > 0))
    current = F.get(F.filter("career_history", lambda r: r["is_current"]), F.lit(0))
    impossible = F.exists("roles", lambda r: F.coalesce(r["end_date"] < r["start"], F.lit(False)) | (r["is_current"] & r["end_date"].isNotNull())) | F.exists(edu, lambda e: e["end_year"] < e["start_year"])
    df = df.withColumns(
        {
            "hp__timeline_impossible": _flag(impossible),
            "n_unused": unused,
            "n_stuffed": stuffed,
            "inflation_gap": gap,
            "hp__employment_overlap": K.bounded_log(overlaps, 24),
            "hp__title_seniority_anomaly": F.when(K.any_cue(F.lower(p["current_title"]), Q.SENIORITY_CUES) & (years < 4), K.unit((4 - years) / 4)).otherwise(0.0),
            "hp__education_career_anomaly": F.when(F.coalesce(first_role < first_study - 1, F.lit(False)), 1.0).when(F.exists(edu, lambda e: e["end_year"] - e["start_year"] > 15), 0.8).otherwise(0.0),
            "hp__salary_anomaly": 0.25 * F.col("sal__is_inverted"),
            "hp__experience_inflation": F.when(gap > 1.5, K.bounded_log(gap - 1.5, 8)).otherwise(0.0),
            "hp__behavioral_inconsistency": K.bounded_log(odd, 2),
            "hp__signal_impossibility": _flag((s["last_active_date"] < s["signup_date"]) | (s["last_active_date"] > day) | (s["signup_date"] > day)),
            "hp__identity_anomaly": 0.4 * _flag(F.lower(F.trim(current["company"])) != F.lower(F.trim(p["current_company"]))),
        }
    )
    df = df.withColumns({"hp__skill_time_contradiction": F.when(F.col("n_unused") >= 2, K.bounded_log(F.col("n_unused"), 6)).otherwise(0.0), "hp__keyword_stuffing": F.when(F.col("n_stuffed") >= 4, K.bounded_log(F.col("n_stuffed"), 12)).otherwise(0.0)})
    names = [column("hp", n) for n in GROUPS["hp"] if n != "composite"]
    hard = ("hp__timeline_impossible", "hp__education_career_anomaly", "hp__signal_impossibility", "hp__identity_anomaly")
    count = lambda cols, least: sum((_flag(F.col(x) >= least) for x in cols), F.lit(0.0))
    most = F.greatest(*names)
    n_skills = F.greatest(F.size("skill_rows"), F.lit(1))
    return df.withColumns(
        {
            "hp__composite": K.unit(most + (1 - most) * K.unit(0.15 * count(hard, 0.5) + 0.05 * count(names, 0.3))),
            "risk__uncertainty": (3 * F.col("unknowns") + F.size(F.filter("skill_rows", lambda x: x["no_months"])) / n_skills) / 4,
            "risk__contradiction": K.mean_of(F.col("hp__salary_anomaly"), 0.5 * F.col("hp__title_seniority_anomaly"), 0.5 * F.col("hp__behavioral_inconsistency")),
        }
    ).withColumn("risk__confidence", K.unit(1 - F.col("risk__uncertainty")))


def _latents() -> dict[str, Column]:
    """The twelve jd cells; every part they are built of is there, so none is shrunk."""
    c = F.col
    comp = lambda *gs: [c(column(g, "competency")) for g in gs]
    claimed = [c(column(g, "claimed")) for g in Q.CONCEPTS]
    backed = [c(column(g, "trust")) * c(column(g, "in_career")) * c(column(g, "semantic")) for g in Q.CONCEPTS]
    product, consulting = c("career__product_company_density"), c("career__consulting_density")
    return {
        "jd__retrieval_ranking": K.mean_of(*comp("retr", "rank", "ir")),
        "jd__production_ml": K.mean_of(*comp("mle", "mlops"), product),
        "jd__product_company": K.mean_of(product, c("pvs__product_recent")),
        "jd__hybrid_retrieval": comp("ir")[0],
        "jd__eval_framework": comp("eval")[0],
        "jd__shipping_mentality": K.mean_of(c("career__production_exposure"), c("found__ownership")),
        "jd__keyword_only": K.unit(K.mean_of(*claimed) - K.mean_of(*backed)),
        "jd__consulting_only": K.mean_of(consulting, consulting),
        "jd__title_chaser": K.mean_of(c("career__title_inflation"), 1 - c("career__stability")),
        "jd__pure_researcher": K.mean_of(c("career__research_only"), 1 - c("career__production_exposure")),
        "jd__framework_enthusiast": K.mean_of(c("llm__claimed"), 1 - c("llm__trust")),
        "jd__inactive": K.mean_of(1 - c("avail__available"), 1 - c("resp__reliable"), 1 - c("avail__available")),
    }


def _confidences() -> dict[str, Column]:
    """AGG-7: each group's confidence is the mean of its cells' confidences."""
    c = F.col
    share = F.size(F.filter("roles", lambda r: r["described"])) / c("n_roles")
    factor = K.bounded_log(c("n_roles"), 4)
    struct = K.unit(0.55 + 0.40 * factor)
    text = K.unit(0.30 + 0.55 * share + 0.10 * factor)
    mixed = K.unit(F.greatest(text, 0.5 * struct))
    trajectory = K.unit(0.5 * (struct + text))
    place = F.when(c("location_fit") == "hub", 0.95).when(c("location_fit") == "non_relocatable", 0.5).otherwise(0.85)
    field = F.when(c("edu__field_relevance") > 0, 0.9).otherwise(0.5)
    # Of the detectors in their order, and the composite, which is as sure as the surest.
    detectors = [
        F.when(c("hp__timeline_impossible") > 0, 0.97).otherwise(0.9), K.unit(0.4 + 0.1 * c("n_unused")), F.lit(0.6), F.lit(0.55), F.when(c("hp__education_career_anomaly") >= 0.8, 0.95).otherwise(0.85), F.lit(0.4),
        K.unit(0.5 + 0.1 * c("inflation_gap")), K.unit(0.4 + 0.05 * c("n_stuffed")), F.lit(0.6), F.lit(0.95), F.lit(0.7),
    ]
    out = {
        "id": F.lit(1.0), "geo": place, "exp": (F.lit(1.2) + struct) / 3, "sen": (trajectory + text) / 2, "edu": F.when(F.size("education") > 0, (F.lit(0.95 + 0.98) + field) / 3).otherwise(0.3), "co": (struct + mixed) / 2, "pvs": mixed,
        "oss": F.when(c("github_known"), (0.95 + 0.6) / 2).otherwise((0.15 + 0.4) / 2), "lead": text, "startup": (0.5 + mixed) / 2, "found": F.lit(0.4), "avail": F.lit(0.95), "eng": F.lit(0.95), "resp": F.lit(0.95),
        "sal": F.lit((0.3 + 0.9) / 2), "reloc": (F.lit(0.95) + place) / 2, "notice": F.lit(0.95),
        # Fourteen cells of fixed confidence, and the hiring proxy, which is less sure without an offer rate.
        "bhv": (F.lit(6 * 0.95 + 2 * 0.9 + 4 * 0.8 + 0.85 + 0.7) + F.when(c("offer_known"), 0.9).otherwise(0.5)) / 15,
        "career": (trajectory + 4 * struct + 5 * text + 4 * mixed) / 14, "cons": F.lit((0.7 + 0.7 + 0.6) / 3), "risk": F.lit((0.7 + 0.7 + 0.8) / 3), "hp": K.mean_of(*detectors, F.greatest(*detectors)), "jd": F.lit(1.0),
    }
    for g in Q.CONCEPTS:
        sources = _flag(c(column(g, "trust")) > 0) + _flag(c(column(g, "in_career")) > 0) + _flag(c(f"{g}__known"))
        both = K.unit(0.25 + 0.75 * sources / 3)
        out[g] = (0.6 + 3 * both + F.when(c(f"{g}__known"), 0.85).otherwise(0.2)) / 5
    return {f"conf__{g}": out[g] for g in GROUPS}
