"""Why a record stands where it stands: a strength with evidence, and a concern.

Texts are made for the ranked rows only, as expressions over their own arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.features import cues as Q
from evidentia.functions import kernels as K
from evidentia.operators import gates as G
from evidentia.operators.ranking import rank_band

from .ranking import SOFT_PRIORITY, Policy

# Cues of the evidence for each positive latent, and of what speaks against.
EVIDENCE = {
    "jd__production_ml": ("production", "in prod", "deployed", "serving", "live traffic", "at scale", "latency", "throughput", "uptime", "sla", "ci/cd", "monitoring", "on-call", "rollout", "millions of", "qps", "p99", "real users", "live system"),
    "jd__product_company": ("product", "saas", "platform", "our app", "our users", "feature flag", "a/b test", "user base", "mau", "dau", "consumer", "in-house", "proprietary"),
    "jd__retrieval_ranking": ("retrieval", "ranking", "search engine", "recommendation", "recsys", "information retrieval", "faiss", "elasticsearch", "solr", "lucene", "bm25", "colbert", "dense retrieval", "sparse retrieval", "vector search", "semantic search", "ann"),
    "jd__shipping_mentality": ("built", "implemented", "shipped", "deployed", "wrote", "coded", "developed", "refactored", "delivered", "pull request", "commit", "open source", "github"),
    "jd__eval_framework": ("ndcg", "mrr", "map", "p@", "precision@", "recall@", "auc", "offline eval", "online eval", "a/b test", "evaluation framework", "benchmark", "offline metrics"),
    "jd__hybrid_retrieval": ("hybrid", "dense", "sparse", "bm25", "faiss", "colbert", "dpr", "bi-encoder", "cross-encoder", "reranker", "two-stage", "dense+sparse"),
}
RESEARCH_ONLY = ("research", "published", "publication", "paper", "phd", "thesis", "neurips", "icml", "acl", "prototype only", "proof of concept")
CONSULTING_SIGNALS = ("consulting", "client", "consultancy", "system integrat", "outsourc", "managed services", "staff augment", "billable")
# Words for each level of intensity.
WORDS = {
    "HIGH": ("top-tier", "standout", "best-in-class", "outstanding", "exceptional", "elite", "marquee", "blue-chip", "top-decile", "gold-standard", "premier", "top-shelf", "first-rate", "top-bracket", "high-conviction", "flagship", "best-of-pool", "top-percentile", "superlative", "A-grade"),
    "GOOD": ("strong", "solid", "well-rounded", "dependable", "credible", "above-average", "competitive", "capable", "sound", "robust", "well-grounded", "respectable"),
    "FAIR": ("reasonable", "moderate", "workable", "adequate", "passable", "middling", "fair", "acceptable", "even-keeled", "serviceable", "middle-of-the-road", "tolerable"),
    "LOW": ("thin", "modest", "limited", "light", "sparse", "slim", "underdeveloped", "nascent", "marginal", "soft", "shallow", "embryonic"),
}
#: The least cosine with a latent's anchor that is cited where no role backs it.
LEAST_COSINE = 0.12
#: Texts that a row may have before its title and id are added to tell it from others.
SALTS = 8
LABELS = {
    "jd__retrieval_ranking": "retrieval and ranking work",
    "jd__production_ml": "running systems in production",
    "jd__product_company": "building a product",
    "jd__hybrid_retrieval": "hybrid retrieval",
    "jd__eval_framework": "evaluation",
    "jd__shipping_mentality": "shipping what was built",
}
CONCERNS = {
    "outside_india_no_sponsor": "the location asks for a sponsor",
    "title_chaser_sub_18m_hops": "roles were often shorter than 18 months",
    "outside_experience_band": "the years of experience lie outside the band",
    "notice_over_30": "the notice period is long",
}


def best_role(cues: tuple[str, ...]) -> Column:
    """E-8b.3: the role with the most cues (the first of equals) as (hits, index, role); null without any."""
    scored = F.transform("career_history", lambda r, i: F.struct((-K.cue_count(F.lower(r["description"]), cues)).alias("hits"), i.alias("index"), r["company"].alias("company"), r["title"].alias("title")))
    best = F.array_min(scored)
    return F.when(best["hits"] < 0, best)


def _clause(turn, latent, level, rest, path, company) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct((turn if isinstance(turn, Column) else F.lit(turn)).alias("turn"), text(latent).alias("latent"), text(level).alias("level"), rest.alias("rest"), text(path).alias("path"), text(company).alias("company"))


def strengths(df: DataFrame, policy: Policy) -> DataFrame:
    """E-8: ``strength``: the latents in an order turned by the id's hash; the first that a role backs is cited, else the nearest
    anchor of cosine LEAST_COSINE or more, else activity that speaks for the record, else the highest component."""
    clauses = []
    for k, (latent, cues) in enumerate(EVIDENCE.items()):
        role = best_role(cues)
        level = K.intensity(K.evidence_intensity(-role["hits"]))
        turn = F.pmod(F.lit(k) - K.hash_pick(F.col("candidate_id"), len(EVIDENCE)), F.lit(len(EVIDENCE)))
        clauses.append(F.when(role.isNotNull(), _clause(turn, latent, level, F.concat(F.lit(", shown as "), role["title"], F.lit(" at "), role["company"]), F.concat(F.lit("career_history["), role["index"], F.lit("].description")), role["company"])))
    found = F.array_sort(F.filter(F.array(*clauses), lambda c: c.isNotNull()))
    parts = ["skill_match", "career_fit", "experience_fit", "education_fit", "credibility"]
    top = F.array_max(F.array(*(F.struct(F.round(F.col(f"raw_{c}"), 6).alias("v"), F.lit(c).alias("c")) for c in parts)))
    general = _clause(0, top["c"], None, F.concat(F.lit("Best on "), F.replace(top["c"], F.lit("_"), F.lit(" ")), F.lit(" at "), K.percent(top["v"])), F.concat(F.lit("raw_"), top["c"]), "")
    sim = F.col("similarities") if "similarities" in df.columns else F.lit(None).cast("map<string,double>")
    near = []
    for latent in EVIDENCE:
        anchor = latent.replace("__", ".")
        cosine = F.try_element_at(sim, F.lit(anchor))
        rest = F.concat(F.lit(", by nearness of the whole profile ("), F.format_string("%.2f", cosine), F.lit(")"))
        near.append(F.when(cosine >= LEAST_COSINE, F.struct((-cosine).alias("order"), _clause(0, latent, K.intensity(cosine), rest, f"semantic.{anchor}", "").alias("s"))))
    nearest = F.get(F.array_sort(F.filter(F.array(*near), lambda c: c.isNotNull())), F.lit(0))["s"]
    return df.withColumn("strength", F.coalesce(F.get(found, F.lit(0)), nearest, _active(policy), general))


def strength_text(salt: int) -> Column:
    """E-9: the clause of ``strength``; the word for its level is picked by id, latent and salt, so another salt tells the same in other words."""
    s = F.col("strength")
    word = K.pick_word(s["level"], F.concat("candidate_id", F.lit(f"#{salt}" if salt else ""), s["latent"]), WORDS)
    label = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v)])[s["latent"]]
    return F.when(s["level"].isNull(), s["rest"]).otherwise(F.concat(F.initcap(K.article(word)), F.lit(" "), word, F.lit(" fit for "), label, s["rest"]))


def _active(policy: Policy) -> Column:
    """E-8b.1: what the activity signals say for a record; null where they say nothing."""
    s = F.col(policy.signals)
    idle = F.date_diff(F.to_date(F.lit(policy.as_of)), s["last_active_date"])
    open_, recent, answers = s["open_to_work_flag"], idle <= 50, s["recruiter_response_rate"] >= 0.65
    rate = K.percent(s["recruiter_response_rate"])
    cases = [
        (open_ & recent & answers, F.concat(F.lit("Open to work, active "), idle, F.lit(" days ago and answering "), rate, F.lit(" of messages")), "open_to_work_flag"),
        (open_ & answers, F.concat(F.lit("Open to work and answering "), rate, F.lit(" of messages")), "open_to_work_flag"),
        (open_ & recent, F.concat(F.lit("Open to work and active "), idle, F.lit(" days ago")), "open_to_work_flag"),
        (answers, F.concat(F.lit("Answers "), rate, F.lit(" of messages")), "recruiter_response_rate"),
        (s["github_activity_score"] >= 40, F.concat(F.lit("Public code with an activity of "), F.format_string("%.0f", s["github_activity_score"])), "github_activity_score"),
        (s["saved_by_recruiters_30d"] >= 4, F.concat(F.lit("Saved by "), s["saved_by_recruiters_30d"], F.lit(" recruiters in a month")), "saved_by_recruiters_30d"),
        (open_, F.lit("Open to work"), "open_to_work_flag"),
    ]
    out = None
    for when, text, name in cases:
        cell = _clause(0, "behaviour", None, text, f"signals.{name}", "")
        out = F.when(when, cell) if out is None else out.when(when, cell)
    return out


def concerns(df: DataFrame, policy: Policy) -> DataFrame:
    """T-5 and E-8b.21: the most significant soft penalty, else a role that speaks against and isn't praised already, else behaviour."""
    penalty = G.most_significant(F.col("soft_codes"), SOFT_PRIORITY)
    told = F.create_map(*[F.lit(x) for k, v in CONCERNS.items() for x in (k, v)])[penalty]
    against = []
    for latent, cues, what in (("jd__pure_researcher", RESEARCH_ONLY, "research"), ("jd__consulting_only", CONSULTING_SIGNALS, "client work")):
        role = best_role(cues)
        against.append(F.when(role.isNotNull() & (F.col(latent) >= 0.10) & (role["company"] != F.col("strength.company")), F.concat(F.lit("the time at "), role["company"], F.lit(f" leans to {what}"))))
    s = F.col(policy.signals)
    idle = F.date_diff(F.to_date(F.lit(policy.as_of)), s["last_active_date"])
    quiet = F.when((idle > 90) & ~s["open_to_work_flag"], F.concat(F.lit("not active for "), idle, F.lit(" days"))).when(s["recruiter_response_rate"] < 0.22, F.concat(F.lit("answers only "), K.percent(s["recruiter_response_rate"]), F.lit(" of messages")))
    return df.withColumn("concern", F.coalesce(told, *against, quiet))


def explain(ranked: DataFrame, policy: Policy, rows: int | None = None) -> DataFrame:
    """E-9: ``reasoning``, one or two sentences; ``evidence``, the path that the strength cites; ``band``."""
    base = concerns(strengths(ranked, policy), policy)
    band = rank_band(F.col("rank"), rows or policy.rows)
    years = F.col("profile")["years_of_experience"]
    # A qualifier by confidence, and a lead-in to the concern that grows with how far down the row stands.
    sure = F.when(F.col("confidence") >= 0.75, "").when(F.col("confidence") >= 0.5, " on the evidence at hand").otherwise(" on thin evidence")
    lead = F.when(F.col("band") == "top", " One thing to check: ").when(F.col("band") == "mid", " However, ").otherwise(" What weighs against: ")
    out = base.withColumns({"band": band, "evidence": F.col("strength.path")})
    # A concern that only says again what the strength cites is left out.
    echo = F.contains(F.col("concern"), F.col("strength.company")) & (F.col("strength.company") != "")
    second = F.when(F.col("concern").isNotNull() & ~F.coalesce(echo, F.lit(False)), F.concat(lead, F.col("concern"), F.lit("."))).otherwise("")
    text = lambda salt: F.concat(strength_text(salt), sure, F.lit(", with "), F.format_string("%.1f", years), F.lit(" years of experience."), second)
    return out.withColumn("texts", F.array(*map(text, range(SALTS)))).withColumn("reasoning", F.col("texts")[0])


def salted(ranked: DataFrame) -> DataFrame:
    """W-8: the k-th of equal texts takes the words of salt k, and once salts are used up, or where they give an equal text again,
    its title and id too, so that all differ; over the ranked rows alone."""
    from pyspark.sql.window import Window

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("__k", F.row_number().over(Window.partitionBy("reasoning").orderBy("rank")))

    picked = numbered(ranked).withColumn("reasoning", F.coalesce(F.get("texts", F.col("__k") - 1), F.col("reasoning")))
    more = F.concat("reasoning", F.lit(" Current title: "), F.col("profile")["current_title"], F.lit(" ("), F.col("candidate_id"), F.lit(")."))
    return numbered(picked).withColumn("reasoning", F.when(F.col("__k") > 1, more).otherwise(F.col("reasoning"))).drop("__k", "texts")
