"""Names, order, groups, bounds and contracts of the features."""

from __future__ import annotations

import hashlib

from .cues import CONCEPTS

# The layout, group by group, in order.
_BEFORE = {
    "id": ("is_valid_id",),
    "geo": ("hub_match", "india_relocatable", "outside_india_no_sponsor"),
    "exp": ("years", "in_band", "derived_vs_stated_gap"),
    "sen": ("level", "title_vs_scope_gap"),
    "edu": ("tier_score", "field_relevance", "timeline_valid"),
    "co": ("scale_progression", "industry_relevance"),
    "pvs": ("product_density", "consulting_density", "product_recent"),
}
_COMPETENCY = ("claimed", "trust", "in_career", "semantic", "competency")
_AFTER = {
    "oss": ("activity", "has_external_validation"),
    "lead": ("scope", "management_only"),
    "startup": ("small_co_experience", "shipping_signal"),
    "found": ("ownership", "breadth"),
    "avail": ("open", "recency", "available"),
    "eng": ("passive", "active", "network", "velocity"),
    "resp": ("rate", "speed", "reliable"),
    "sal": ("fit", "is_inverted"),
    "reloc": ("willing", "needed"),
    "notice": ("fit", "over_30"),
    "bhv": (
        "availability", "recruitability", "response_reliability", "interview_reliability", "market_demand", "market_momentum", "engagement_velocity", "candidate_temperature",
        "recruiter_attractiveness", "hiring_probability_proxy", "freshness", "trust", "signal_consistency", "behavioral_confidence", "behavioral_risk",
    ),
    "career": (
        "progression_quality", "stability", "promotion_velocity", "title_inflation", "role_consistency", "experience_authenticity", "company_progression",
        "product_company_density", "consulting_density", "technical_depth", "hands_on_engineering", "research_only", "management_only", "production_exposure",
    ),
    "cons": ("title_role_coherence", "skill_role_coherence", "summary_coherence"),
    "risk": ("uncertainty", "contradiction", "confidence"),
    "hp": (
        "timeline_impossible", "skill_time_contradiction", "employment_overlap", "title_seniority_anomaly", "education_career_anomaly", "salary_anomaly",
        "experience_inflation", "keyword_stuffing", "behavioral_inconsistency", "signal_impossibility", "identity_anomaly", "composite",
    ),
    "jd": (
        "retrieval_ranking", "production_ml", "product_company", "shipping_mentality", "eval_framework", "hybrid_retrieval",
        "keyword_only", "consulting_only", "title_chaser", "pure_researcher", "framework_enthusiast", "inactive",
    ),
}

GROUPS: dict[str, tuple[str, ...]] = _BEFORE | {g: _COMPETENCY for g in CONCEPTS} | _AFTER


def column(group: str, name: str) -> str:
    """A feature's column: group and name joined by two underscores, as dots would ask for quotes."""
    return f"{group}__{name}"


LAYOUT: list[str] = [column(g, n) for g, names in GROUPS.items() for n in names]
CONFIDENCES: list[str] = [f"conf__{g}" for g in GROUPS]
BOUNDS: dict[str, tuple[float, float]] = {f: (0.0, 50.0) if f == "exp__years" else (0.0, 1.0) for f in LAYOUT}

#: AGG-8: weights of the groups' confidences.
CONFIDENCE_WEIGHTS = {f"conf__{g}": 3.0 if g in CONCEPTS else 1.5 if g in ("career", "pvs", "cons") else 1.0 if g in ("edu", "exp") else 0.2 for g in GROUPS}

#: G-C: what must hold between features.
AT_MOST = [(column(g, "competency"), [column(g, "trust"), column(g, "in_career"), column(g, "semantic")]) for g in CONCEPTS]
AT_LEAST = [("hp__composite", [c for c in LAYOUT if c.startswith("hp__") and c != "hp__composite"])]


#: L-3: what features are built of, where that is other features.
FEATURE_NEEDS: dict[str, tuple[str, ...]] = {
    **{f: () for f in LAYOUT},
    **{column(g, "competency"): tuple(column(g, x) for x in ("claimed", "trust", "in_career", "semantic")) for g in CONCEPTS},
    **{"exp__derived_vs_stated_gap": ("career__experience_authenticity",), "sen__level": ("career__progression_quality",), "sen__title_vs_scope_gap": ("career__title_inflation",), "co__scale_progression": ("career__company_progression",)},
    **{"co__industry_relevance": ("career__product_company_density",), "pvs__product_density": ("career__product_company_density",), "pvs__consulting_density": ("career__consulting_density",)},
    **{"lead__scope": ("career__management_only",), "lead__management_only": ("career__management_only",), "startup__shipping_signal": ("career__production_exposure",)},
    **{"career__research_only": ("career__production_exposure",), "career__management_only": ("career__hands_on_engineering",)},
    **{"avail__available": ("avail__open", "avail__recency"), "eng__velocity": ("eng__active", "eng__passive"), "resp__reliable": ("resp__rate", "resp__speed")},
    **{"bhv__availability": ("avail__available",), "bhv__response_reliability": ("resp__reliable",), "bhv__market_demand": ("eng__passive",), "bhv__recruiter_attractiveness": ("bhv__market_demand",), "bhv__market_momentum": ("bhv__market_demand",)},
    **{"bhv__recruitability": ("avail__open", "resp__reliable"), "bhv__engagement_velocity": ("eng__active", "eng__passive"), "bhv__candidate_temperature": ("avail__available", "eng__active")},
    **{"bhv__hiring_probability_proxy": ("avail__available", "resp__reliable", "bhv__interview_reliability"), "bhv__behavioral_confidence": ("bhv__signal_consistency",), "bhv__behavioral_risk": ("avail__available", "bhv__interview_reliability", "bhv__signal_consistency")},
    **{"hp__composite": tuple(column("hp", x) for x in GROUPS["hp"] if x != "composite"), "hp__salary_anomaly": ("sal__is_inverted",)},
    **{"risk__contradiction": ("hp__salary_anomaly", "hp__title_seniority_anomaly", "hp__behavioral_inconsistency"), "risk__confidence": ("risk__uncertainty",)},
    **{"jd__retrieval_ranking": ("retr__competency", "rank__competency", "ir__competency"), "jd__production_ml": ("mle__competency", "mlops__competency", "pvs__product_density"), "jd__product_company": ("pvs__product_density", "pvs__product_recent")},
    **{"jd__shipping_mentality": ("startup__shipping_signal", "found__ownership"), "jd__eval_framework": ("eval__competency",), "jd__hybrid_retrieval": ("ir__competency",)},
    **{"jd__keyword_only": tuple(column(g, x) for g in CONCEPTS for x in ("claimed", "trust", "in_career", "semantic")), "jd__consulting_only": ("pvs__consulting_density", "career__consulting_density")},
    **{"jd__title_chaser": ("career__title_inflation", "career__stability"), "jd__pure_researcher": ("career__research_only", "career__production_exposure"), "jd__framework_enthusiast": ("llm__claimed", "llm__trust")},
    **{"jd__inactive": ("avail__available", "resp__reliable", "bhv__availability")},
}


def layout_hash() -> str:
    return hashlib.sha256("\n".join([*LAYOUT, *CONFIDENCES]).encode()).hexdigest()
