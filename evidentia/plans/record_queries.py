"""Queries over nested records with SQL for each: features, confidences, gates, score, ranking.

The records come from ``customer``: one for each, every field an expression over
its number (and the number of the role, skill or study), the same text for Spark
and for the SQL.  Spark nests them and works on their arrays; the SQL works on
flat tables of roles, skills and studies.  The pool has impossible dates, several
current roles, consulting careers, empty descriptions, disclaimers, masked and
missing signals, inverted salaries and orphaned assessments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.features import cues as Q
from evidentia.features.extract import extract_features
from evidentia.features.layout import CONFIDENCE_WEIGHTS, CONFIDENCES, GROUPS, LAYOUT, column
from evidentia.operators import gates as G
from evidentia.operators.scoring import BEHAVIOUR_WEIGHTS, COMPONENT_WEIGHTS
from evidentia.session import load
from evidentia.sources.records import PROFICIENCIES, SIZES

from .ranking import DEGREES, EXPOSURE, Policy, career_slice, integrity_findings, offline_gates, rank_records, score_records
from .registry import query

AS_OF = "2024-06-18"
POLICY = Policy(as_of=AS_OF)

# Expressions in what Spark and DuckDB share.  n is the record's number, k that of the row within it.


def _h(a: int, m: int, by_row: bool = True) -> str:
    """A number below m."""
    return f"((n * {a} + {f'k * {3 * a + 101} + ' if by_row else ''}{a + 17}) % 10007 % {m})"


def _one(a: int, values: tuple, by_row: bool = True) -> str:
    quoted = ["'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values]
    return f"CASE {_h(a, len(values), by_row)} " + " ".join(f"WHEN {j} THEN {v}" for j, v in enumerate(quoted)) + " END"


def _double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


TEXTS = (
    "Built and deployed a retrieval and ranking platform in production for millions of users. Led the team and owned the roadmap.",
    "Implemented embeddings and faiss search,  measured ndcg and mrr in offline eval. Wrote Python and sql for our users.",
    "Developed nlp features in python and pytorch; shipped them with ci/cd, on-call and monitoring of latency.",
    "Consulting engagement for a client: strategy, governance and budget. Managed a team, hiring and headcount.",
    "Research on transformer models, published a paper. My professional experience there is limited. Prototype only!",
    "",
    "Interested in transitioning into llm and gpt work. Contributor to open source on GitHub, maintainer of an indexing tool.",
    "Recommendation and personalization for a consumer product; a/b test and growth of the user base. Java, spark, kafka.",
    "Mlops with mlflow and kubeflow at scale, serving live traffic with low latency; kubernetes and tensorflow.",
    "Taught classes",
)
TITLES = ("ML Engineer", "Senior Engineer", "Data Scientist", "Principal Architect", "Junior Analyst", "Founder", "Intern", "Teacher", "Vice President of Search", "Software Engineer II")
COMPANIES = ("Acme", "Globex", "TCS", "Initech", "Infosys Ltd", "Umbrella", "Deloitte")
INDUSTRIES = ("Software", "Fintech", "IT Services", "Management Consulting", "SaaS", "Education")
SKILLS = ("Python", "Retrieval", "Ranking", "NLP", "LLM", "PyTorch", "MLOps", "Embeddings", "FAISS", "SQL", "Recommendation Systems", "NDCG", "Prompt Engineering", "Elasticsearch")
PLACES = ("Pune, Maharashtra", "Noida", "Bengaluru, Karnataka", "Berlin", "  New Delhi , India", "Chennai, Tamil Nadu")

_SPAN = f"(1 + {_h(31, 3, False)})"
_START_YEAR = f"(2023 - k * {_SPAN} - {_h(37, 2)})"
_START_MONTH, _DAY = f"(1 + {_h(41, 12)})", f"(1 + {_h(43, 28)})"
_CURRENT = f"(k = 0 AND {_h(47, 5, False)} <> 0 OR {_h(53, 19)} = 0)"
_START = f"make_date(CAST({_START_YEAR} AS INT), CAST({_START_MONTH} AS INT), CAST({_DAY} AS INT))"
_END_YEAR = f"CASE WHEN {_h(59, 23)} = 0 THEN {_START_YEAR} - 1 WHEN {_h(61, 4)} = 0 THEN {_START_YEAR} + 4 ELSE {_START_YEAR} + {_SPAN} END"
_ENDED = f"make_date(CAST({_END_YEAR} AS INT), CAST({_START_MONTH} AS INT), CAST({_DAY} AS INT))"
_MONTHS = f"CASE WHEN {_h(67, 5)} = 0 THEN {_h(71, 50)} WHEN {_CURRENT} THEN 12 * (2024 - {_START_YEAR}) + 6 - {_START_MONTH} ELSE 12 * abs(({_END_YEAR}) - {_START_YEAR}) END"
ROLE = {
    "company": _one(73, COMPANIES),
    "title": _one(79, TITLES),
    "start_date": _START,
    "end_date": f"CASE WHEN {_CURRENT} AND {_h(83, 11)} <> 0 THEN NULL ELSE {_ENDED} END",
    "duration_months": f"CAST({_MONTHS} AS INT)",
    "is_current": _CURRENT,
    "industry": _one(89, INDUSTRIES),
    "company_size": _one(97, SIZES),
    "description": _one(101, TEXTS),
}
SKILL = {
    "name": "CASE (n * 5 + k * 3) % 14 " + " ".join(f"WHEN {j} THEN '{s}'" for j, s in enumerate(SKILLS)) + " END",
    "proficiency": _one(103, PROFICIENCIES),
    "endorsements": f"CAST(CASE WHEN {_h(107, 3)} = 0 THEN 0 ELSE {_h(109, 60)} END AS INT)",
    "duration_months": f"CAST(CASE {_h(113, 4)} WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE {_h(127, 60)} END AS INT)",
}
_STUDY_YEAR = f"(2002 + {_h(131, 18)})"
STUDY = {
    "institution": "'Institute'",
    "degree": _one(137, ("B.Tech", "M.Tech", "Ph.D", "Diploma", "B.Sc", "M.S.")),
    "field_of_study": _one(139, ("Computer Science", "Physics", "History", "Machine Learning", "Electrical  Engineering", "Applied Mathematics")),
    "start_year": f"CAST({_STUDY_YEAR} AS INT)",
    "end_year": f"CAST({_STUDY_YEAR} + CASE {_h(149, 17)} WHEN 0 THEN -1 WHEN 1 THEN 17 ELSE {_h(151, 6)} END AS INT)",
    "grade": "CAST(NULL AS {text})",
    "tier": _one(157, ("tier_1", "tier_2", "tier_3", "tier_4", "unknown")),
}
N_ROLES, N_SKILLS, N_STUDIES = f"(1 + {_h(163, 4, False)})", f"(1 + {_h(167, 7, False)})", f"({_h(173, 4, False)})"
_UNIT = lambda a: f"{_double(_h(a, 1000, False))} / 1000"
PROFILE = {
    "anonymized_name": "'Person'",
    "headline": _one(179, ("Engineer", "ML and retrieval", ""), False),
    "summary": _one(181, TEXTS, False),
    "location": _one(191, PLACES, False),
    "country": _one(193, ("India", " india", "IN", "Germany", "India"), False),
    "years_of_experience": f"{_double(_h(197, 160, False))} / 10",
    "current_title": _one(199, TITLES, False),
    "current_company": _one(211, COMPANIES[:3], False),
    "current_company_size": _one(223, SIZES, False),
    "current_industry": _one(227, INDUSTRIES, False),
}
SIGNAL = {
    "profile_completeness_score": f"40 + 60 * {_UNIT(229)}",
    "signup_date": f"make_date(CAST(2019 + {_h(233, 6, False)} AS INT), CAST(1 + {_h(239, 12, False)} AS INT), 5)",
    "last_active_date": f"make_date(2024, CAST(1 + {_h(241, 7, False)} AS INT), CAST(1 + {_h(251, 28, False)} AS INT))",
    "open_to_work_flag": f"({_h(257, 5, False)} > 1)",
    "profile_views_received_30d": f"CAST(CASE WHEN {_h(263, 4, False)} = 0 THEN 0 ELSE {_h(269, 250, False)} END AS INT)",
    "applications_submitted_30d": f"CAST({_h(271, 40, False)} AS INT)",
    "recruiter_response_rate": _UNIT(277),
    "avg_response_time_hours": f"1 + 70 * {_UNIT(281)}",
    "connection_count": f"CAST(CASE WHEN {_h(283, 6, False)} = 0 THEN 0 ELSE {_h(293, 1800, False)} END AS INT)",
    "endorsements_received": f"CAST({_h(307, 100, False)} AS INT)",
    "notice_period_days": f"CAST({_one(311, (0, 15, 30, 45, 60, 90, 120), False)} AS INT)",
    "salary_min": _double("20"),
    "salary_max": _double(_one(313, (18, 20, 35, 50), False)),
    "preferred_work_mode": "'remote'",
    "willing_to_relocate": f"({_h(317, 2, False)} = 0)",
    "github_activity_score": _double(_one(331, (-1, 10, 20, 55, 90), False)),
    "search_appearance_30d": f"CAST({_h(337, 120, False)} AS INT)",
    "saved_by_recruiters_30d": f"CAST(CASE WHEN {_h(347, 3, False)} = 0 THEN 0 ELSE {_h(349, 50, False)} END AS INT)",
    "interview_completion_rate": _UNIT(353),
    "offer_acceptance_rate": f"CASE WHEN {_h(359, 3, False)} = 0 THEN {_double('-1')} ELSE {_UNIT(367)} END",
    "verified_email": f"({_h(373, 4, False)} > 0)",
    "verified_phone": f"({_h(379, 2, False)} = 0)",
    "linkedin_connected": f"({_h(383, 3, False)} > 0)",
}
#: Scores of the first skill, of the third (which a record may lack), and of one that no record has.
ASSESSED = {"name": "CASE k WHEN 2 THEN 'Cobol' ELSE CASE (n * 5 + k * 6) % 14 " + " ".join(f"WHEN {j} THEN '{s}'" for j, s in enumerate(SKILLS)) + " END END", "score": f"30 + 80 * {_double(_h(389, 1000))} / 1000", "kept": f"({_h(397, 3)} = 0 OR k = 0 AND {_h(401, 4)} > 0)"}
#: Cosines with the anchors of three concepts; a third of the records has no vector.
ANCHORED = ("retr", "nlp", "eval")
COSINE = f"CASE WHEN {_h(409, 3, False)} = 0 THEN NULL ELSE {_double(_h(419, 2000))} / 1000 - 1 END"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v.replace('{text}', 'STRING')}" for k, v in fields.items()) + ")"


def _rows(fields: dict[str, str], size: str) -> str:
    return f"transform(filter(sequence(0, 6), k -> k < {size}), k -> {_struct(fields)})"


def records(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """The pool, nested, with ``similarities``; a file of many narrow rows is one task's, so ``parts`` deals the rows out before they grow."""
    salary = {"expected_salary_range_inr_lpa": _struct({"min": SIGNAL["salary_min"], "max": SIGNAL["salary_max"]})}
    scores = f"map_from_entries(transform(filter(sequence(0, 2), k -> {ASSESSED['kept']}), k -> struct({ASSESSED['name']}, {ASSESSED['score']})))"
    signals = {k: v for k, v in SIGNAL.items() if not k.startswith("salary_")} | salary | {"skill_assessment_scores": scores}
    cosines = ", ".join(f"'jd.{g}', {COSINE.replace('k * ', f'{j} * ')}" for j, g in enumerate(ANCHORED))
    base = load(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("n"))
    return (base.repartition(parts, "n") if parts else base).select(
        F.expr("concat('CAND_', lpad(cast(n AS STRING), 7, '0'))").alias("candidate_id"), F.expr(_struct(PROFILE)).alias("profile"), F.expr(_rows(ROLE, N_ROLES)).alias("career_history"), F.expr(_rows(STUDY, N_STUDIES)).alias("education"),
        F.expr(_rows(SKILL, N_SKILLS)).alias("skills"), F.expr(_struct(signals)).alias("signals"), F.expr(f"map_filter(map({cosines}), (g, x) -> x IS NOT NULL)").alias("similarities"),
    )


# The same in SQL over flat tables, and what is built of them.


def _flat(fields: dict[str, str], rows: str | None = None, where: str = "true", skip: tuple[str, ...] = ()) -> str:
    said = ", ".join(f"{v.replace('{text}', 'VARCHAR')} AS {k}" for k, v in fields.items() if k not in skip)
    return f"SELECT n, {'k, ' if rows else ''}{said} FROM base" + (f", (SELECT unnest(range({rows})) AS k) WHERE {where}" if rows else "")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _k2(x: str, saturation: float) -> str:
    return f"least(1.0, ln(1 + greatest({x}, 0)) / ln(1 + {saturation}::DOUBLE))"


def _unit(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


def _hits(text: str, cues) -> str:
    return f"len(list_filter({_list(cues)}, lambda cue_: contains({text}, cue_)))"


def _any(text: str, cues) -> str:
    return f"({_hits(text, cues)} > 0)"


def _ladder(text: str, ladder, default: float) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN {_any(text, cues)} THEN {rank} ELSE {default} END" for rank, cues in ladder) + ")"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9+#.]+'), lambda t: len(t) >= 2 AND NOT list_contains({_list(Q.STOPWORDS)}, t)))"


def _wmean(v: str, w: str) -> str:
    return f"(CASE WHEN sum({w}) > 0 THEN sum(({v}) * {w}) / sum({w}) ELSE avg({v}) END)"


_DAY0 = f"DATE '{AS_OF}'"
_HEDGED = f"list_aggregate(list_filter(string_split_regex(regexp_replace(description, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter({_list(Q.HEDGES)}, lambda m: contains(lower(s), m))) = 0), 'string_agg', ' ')"

WITH = f"""base AS (SELECT CAST(c_custkey AS BIGINT) AS n FROM customer),
p AS (SELECT n, 'CAND_' || lpad(CAST(n AS VARCHAR), 7, '0') AS candidate_id, {', '.join(f"{v} AS {k}" for k, v in (PROFILE | SIGNAL).items())} FROM base),
r AS ({_flat(ROLE, '0, 7', f'k < {N_ROLES}')}),
s0 AS ({_flat(SKILL, '0, 7', f'k < {N_SKILLS}')}),
e AS ({_flat(STUDY, '0, 7', f'k < {N_STUDIES}')}),
a AS ({_flat(ASSESSED, '0, 3', ASSESSED['kept'], ('kept',))}),
cosine AS (SELECT n, k, {COSINE} AS x FROM base, (SELECT unnest(range(0, {len(ANCHORED)})) AS k)),
s AS (SELECT s0.*, {_tokens('s0.name')} AS tokens, proficiency IN ('advanced', 'expert') AS advanced, coalesce(duration_months, 0) = 0 AS unused, string_split_regex(lower(s0.name), '\\s+') AS words,
  {_unit(f"0.4 * {_k2('endorsements', 50)} + 0.3 * coalesce({_k2('duration_months', 36)} * CASE WHEN duration_months IS NULL THEN 0 ELSE 1 END, 0) + 0.3 * coalesce({_unit('a.score / 100')}, 0)")} AS trust
  FROM s0 LEFT JOIN a ON a.n = s0.n AND a.name = s0.name),
r1 AS (SELECT *, {_clean('title')} AS t, {_clean('description')} AS d, {_clean('company')} AS c, concat_ws(' ', {_clean('description')}, {_clean('industry')}, {_clean('company')}) AS blob,
  CASE WHEN is_current OR end_date IS NULL THEN {_DAY0} ELSE end_date END AS ending, greatest(duration_months, 0)::DOUBLE AS wt, list_position({_list(SIZES)}, company_size)::DOUBLE AS size FROM r),
r2 AS (SELECT *, pow(0.5, greatest({_DAY0} - ending, 0) / 180.0) AS wr, {_ladder('t', Q.TITLE_LADDER, Q.TITLE_DEFAULT)} AS title_rank, CASE WHEN d <> '' THEN {_ladder('d', Q.SCOPE_LADDER, Q.SCOPE_DEFAULT)} ELSE {Q.SCOPE_DEFAULT} END AS scope_rank,
  greatest({_k2(_hits('blob', Q.CONSULTING_CUES), 2)}, CASE WHEN {_any('c', Q.CONSULTING_FIRMS)} THEN 1.0 ELSE 0.0 END) AS consulting, {_k2(_hits('blob', Q.PRODUCT_CUES), 2)} AS product_cues, {_k2(_hits('blob', Q.CODING_CUES), 3)} AS coding,
  {_k2(_hits('blob', Q.ARCHITECTURE_CUES), 2)} AS arch, {_k2(_hits('blob', Q.RESEARCH_CUES), 2)} AS research, {_k2(_hits('blob', Q.MANAGEMENT_CUES), 2)} AS mgmt, {_k2(_hits('blob', Q.PRODUCTION_CUES), 2)} AS production,
  list_filter({_list(Q.TECH_NAMES)}, lambda x: contains(blob, x)) AS tech, {_tokens('description')} AS tokens, {_tokens(f'coalesce({_HEDGED}, chr(32))')} AS kept_tokens, string_split_regex(lower(description), '\\s+') AS words FROM r1),
rs AS (SELECT *, wt * wr AS wc, CASE WHEN d <> '' THEN 0.6 * scope_rank + 0.4 * title_rank ELSE 0.5 * title_rank END AS level, product_cues * (1 - 0.5 * consulting) AS product, {_unit('coding - 0.5 * arch')} AS hands_on FROM r2),
steps AS (SELECT n, wt + lag(wt) OVER w AS w2, level - lag(level) OVER w AS dl, size - lag(size) OVER w AS ds FROM rs WINDOW w AS (PARTITION BY n ORDER BY start_date, k)),
prog AS (SELECT n, {_wmean('CASE WHEN dl > 0.25 THEN 1.0 WHEN dl >= -0.25 THEN 0.6 ELSE 0.2 END', 'w2')} AS up, {_wmean('CASE WHEN ds > 0 THEN 1.0 WHEN ds = 0 THEN 0.6 ELSE 0.3 END', 'w2')} AS bigger FROM steps WHERE w2 IS NOT NULL GROUP BY n),
islands AS (SELECT n, start_date AS x, ending AS y, CASE WHEN start_date <= max(ending) OVER (PARTITION BY n ORDER BY start_date, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh, k FROM rs WHERE ending > start_date),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY n ORDER BY x, k) AS island FROM islands),
worked AS (SELECT n, least(sum(days) / 365.25, 50.0) AS years FROM (SELECT n, island, max(y) - min(x) AS days FROM numbered GROUP BY n, island) GROUP BY n),
ca AS (SELECT n, count(*) AS roles, avg(CASE WHEN d <> '' THEN 1.0 ELSE 0.0 END) AS described, coalesce(avg(CASE WHEN wt > 0 THEN wt END), 0) AS mean_tenure, count(*) FILTER (wt > 0 AND wt < 18) AS hops,
  greatest(max(start_date) - min(start_date), 0) / 365.25 AS years, arg_max(level, (start_date, k)) - arg_min(level, (start_date, k)) AS gained, max(level) - min(level) AS spread, count(*) FILTER (product >= 0.5) AS np, count(*) FILTER (consulting >= 0.5) AS nc,
  {_wmean("CASE WHEN d <> '' THEN least(1.0, greatest(title_rank - scope_rank, 0) / 3.0) ELSE 0.6 * title_rank / 5 END", 'wt')} AS inflation, {_wmean('product', 'wc')} AS product, {_wmean('consulting', 'wc')} AS consulting, {_wmean('product', 'wr')} AS product_recent,
  {_wmean('coding', 'wt')} AS coding, {_wmean('hands_on', 'wr')} AS hands_on, {_wmean('production', 'wc')} AS production, {_wmean('research', 'wt')} AS research, {_wmean('mgmt', 'wt')} AS mgmt, len(list_distinct(flatten(list(tech)))) AS tech,
  list_distinct(flatten(list(kept_tokens))) AS career_tokens, list_distinct(flatten(list(words))) AS role_words, count(*) FILTER ({_any('lower(description)', Q.OPEN_SOURCE_CUES)}) AS cited,
  max(CASE WHEN company_size IN ('1-10', '11-50') THEN 1.0 ELSE 0.0 END) AS small, max(CASE WHEN {_any('t', Q.FOUNDER_TITLES)} THEN 1.0 ELSE 0.0 END) AS founder,
  coalesce(arg_min(tokens, k) FILTER (is_current), arg_min(tokens, k)) AS current_tokens, arg_min(company, k) FILTER (is_current) AS current_name, sum(duration_months) AS months FROM rs GROUP BY n),
cf AS (SELECT ca.n, roles, described, CASE WHEN roles = 1 THEN 0.5 ELSE up END AS progression_quality, {_unit(f'0.5 * {_k2("mean_tenure", 36)} + 0.5 * (1 - hops / roles)')} AS stability, CASE WHEN roles = 1 THEN 0.3 ELSE {_unit('gained / greatest(ca.years, 0.5) / 0.5')} END AS promotion_velocity,
  {_unit('inflation')} AS title_inflation, CASE WHEN roles = 1 THEN 0.7 ELSE {_unit('0.6 * (1 - spread / 5) + 0.4 * greatest(np, nc, roles - np - nc) / roles')} END AS role_consistency,
  {_unit('1 - abs(years_of_experience - coalesce(worked.years, 0)) / greatest(years_of_experience, coalesce(worked.years, 0), 1.0)')} AS experience_authenticity, CASE WHEN roles = 1 THEN 0.5 ELSE bigger END AS company_progression, product AS product_company_density, consulting AS consulting_density,
  {_unit(f'0.6 * coding + 0.4 * {_k2("tech", 8)}')} AS technical_depth, hands_on AS hands_on_engineering, {_unit('research * (1 - production)')} AS research_only, {_unit('mgmt * (1 - greatest(coding, hands_on))')} AS management_only, production AS production_exposure,
  product_recent, career_tokens, role_words, cited, small, founder, current_tokens, current_name, months FROM ca JOIN p ON p.n = ca.n LEFT JOIN prog ON prog.n = ca.n LEFT JOIN worked ON worked.n = ca.n),
ef AS (SELECT p.n, count(e.n) AS studies, coalesce(max(CASE tier WHEN 'tier_1' THEN 1.0 WHEN 'tier_2' THEN 0.75 WHEN 'tier_3' THEN 0.5 WHEN 'tier_4' THEN 0.25 WHEN 'unknown' THEN 0.4 END), 0) AS tier_score, coalesce(max({_ladder(_clean('field_of_study'), Q.FIELD_RELEVANCE, 0.0)}), 0) AS field_relevance,
  coalesce(min(CASE WHEN end_year >= start_year AND start_year >= 1950 AND end_year <= 2024 AND end_year - start_year <= 15 THEN 1.0 ELSE 0.0 END) FILTER (e.n IS NOT NULL), 1) AS timeline_valid, min(start_year) AS first_study, coalesce(bool_or(end_year < start_year), false) AS inverted, coalesce(bool_or(end_year - start_year > 15), false) AS endless FROM p LEFT JOIN e ON e.n = p.n GROUP BY p.n),
sf0 AS (SELECT *, {_DAY0} - last_active_date AS idle, {_k2('profile_views_received_30d', 200)} AS v, {_k2('search_appearance_30d', 100)} AS f, {_k2('saved_by_recruiters_30d', 40)} AS saves, CASE WHEN open_to_work_flag THEN 1.0 ELSE 0.0 END AS is_open,
  {_clean('location')} AS city, lower(trim(country)) IN ('india', 'in') AS india FROM p),
sf1 AS (SELECT *, city IN {tuple(Q.HUBS)} OR trim(split_part(city, ',', 1)) IN {tuple(Q.HUBS)} AS in_hub, pow(0.5, greatest(idle, 0) / 180.0) AS recency, pow(0.5, greatest(idle, 0) / 90.0) AS recency90, (v + f + saves) / 3 AS passive, {_k2('applications_submitted_30d', 30)} AS active,
  (recruiter_response_rate + 24.0 / (24.0 + avg_response_time_hours)) / 2 AS reliable, CASE WHEN offer_acceptance_rate <> -1 THEN (interview_completion_rate + offer_acceptance_rate) / 2 ELSE interview_completion_rate END AS reliability,
  1 - 0.5 * (CASE WHEN saved_by_recruiters_30d > 0 AND profile_views_received_30d = 0 THEN 1 ELSE 0 END + CASE WHEN connection_count = 0 AND profile_views_received_30d > 50 THEN 1 ELSE 0 END) AS consistent,
  (CASE WHEN github_activity_score = -1 THEN 1.0 ELSE 0.0 END + CASE WHEN offer_acceptance_rate = -1 THEN 1.0 ELSE 0.0 END + CASE WHEN (SELECT count(*) FROM a WHERE a.n = sf0.n) = 0 THEN 1.0 ELSE 0.0 END) / 3 AS unknowns FROM sf0),
sf AS (SELECT *, CASE WHEN NOT india THEN 'outside' WHEN in_hub THEN 'hub' WHEN willing_to_relocate THEN 'relocatable' ELSE 'non_relocatable' END AS fit, recency * (0.5 + 0.5 * is_open) AS available, (passive + saves) / 2 AS demand FROM sf1),
sk AS (SELECT p.n, count(s.n) AS skills, count(*) FILTER (advanced AND unused) AS unused, count(*) FILTER (advanced AND unused AND endorsements = 0) AS bare, count(*) FILTER (advanced AND unused AND endorsements = 0 AND len(list_intersect(s.words, cf.role_words)) = 0) AS stuffed,
  count(*) FILTER (s.n IS NOT NULL AND duration_months IS NULL) AS no_months, list_distinct(flatten(list(s.tokens))) AS skill_tokens, count(*) FILTER (proficiency = 'expert' AND s.unused) AS experts, count(*) FILTER (trust >= 0.5) AS credible FROM p JOIN cf ON cf.n = p.n LEFT JOIN s ON s.n = p.n GROUP BY p.n),
concepts AS (SELECT * FROM (VALUES {', '.join(f"({j}, '{g}', {_list(ts)}, {ANCHORED.index(g) if g in ANCHORED else 'NULL'})" for j, (g, ts) in enumerate(Q.CONCEPTS.items()))}) AS t(no, g, known, anchor)),
co0 AS (SELECT p.n, no, g, {_k2('count(s.n)', 4)} AS claimed, 1 - coalesce(product(1 - s.trust), 1) AS trust, any_value(len(list_intersect(known, cf.career_tokens)) / len(known)::DOUBLE) AS in_career, any_value(cosine.x) AS x FROM p JOIN cf ON cf.n = p.n CROSS JOIN concepts LEFT JOIN s ON s.n = p.n AND len(list_intersect(s.tokens, known)) > 0 LEFT JOIN cosine ON cosine.n = p.n AND cosine.k = anchor GROUP BY p.n, no, g),
co1 AS (SELECT *, coalesce({_unit('(x + 1) / 2')}, 0) * CASE WHEN x IS NULL THEN 0 ELSE 1 END AS semantic FROM co0),
co AS (SELECT *, {_unit('least(0.25 * trust + 0.5 * in_career + 0.25 * semantic, (trust + in_career + semantic) / 3) - 0.5 * greatest(0, claimed - (trust + in_career + semantic) / 3)')} AS competency,
  {_unit('0.25 + 0.75 * (CASE WHEN trust > 0 THEN 1 ELSE 0 END + CASE WHEN in_career > 0 THEN 1 ELSE 0 END + CASE WHEN x IS NULL THEN 0 ELSE 1 END) / 3.0')} AS sure FROM co1),
together AS (SELECT a.n, sum(greatest((least(coalesce(a.end_date, {_DAY0}), coalesce(b.end_date, {_DAY0})) - greatest(a.start_date, b.start_date)) / 30.0 - 2, 0)) AS months FROM r a JOIN r b ON a.n = b.n AND a.k < b.k GROUP BY a.n),
bad AS (SELECT n, bool_or(coalesce(end_date < start_date, false) OR (is_current AND end_date IS NOT NULL)) AS dates, min(year(start_date)) AS first_role FROM r GROUP BY n),
hp0 AS (SELECT sf.n, CASE WHEN bad.dates OR ef.inverted THEN 1.0 ELSE 0.0 END AS timeline_impossible, CASE WHEN sk.unused >= 2 THEN {_k2('sk.unused', 6)} ELSE 0 END AS skill_time_contradiction, {_k2('coalesce(together.months, 0)', 24)} AS employment_overlap,
  CASE WHEN {_any('lower(current_title)', Q.SENIORITY_CUES)} AND years_of_experience < 4 THEN (4 - years_of_experience) / 4 ELSE 0 END AS title_seniority_anomaly, CASE WHEN bad.first_role < ef.first_study - 1 THEN 1.0 WHEN ef.endless THEN 0.8 ELSE 0 END AS education_career_anomaly,
  CASE WHEN salary_min > salary_max THEN 0.25 ELSE 0 END AS salary_anomaly, CASE WHEN cf.months / 12.0 - years_of_experience > 1.5 THEN {_k2('cf.months / 12.0 - years_of_experience - 1.5', 8)} ELSE 0 END AS experience_inflation, CASE WHEN sk.stuffed >= 4 THEN {_k2('sk.stuffed', 12)} ELSE 0 END AS keyword_stuffing,
  {_k2('CASE WHEN saved_by_recruiters_30d > 0 AND profile_views_received_30d = 0 THEN CASE WHEN search_appearance_30d > 0 THEN 2 ELSE 1 END ELSE 0 END', 2)} AS behavioral_inconsistency,
  CASE WHEN last_active_date < signup_date OR last_active_date > {_DAY0} OR signup_date > {_DAY0} THEN 1.0 ELSE 0.0 END AS signal_impossibility, CASE WHEN lower(trim(cf.current_name)) <> lower(trim(current_company)) THEN 0.4 ELSE 0 END AS identity_anomaly,
  (3 * unknowns + sk.no_months / greatest(sk.skills, 1)) / 4 AS uncertainty, cf.months / 12.0 - years_of_experience AS gap, sk.unused AS n_unused, sk.stuffed AS n_stuffed
  FROM sf JOIN cf ON cf.n = sf.n JOIN ef ON ef.n = sf.n JOIN sk ON sk.n = sf.n JOIN bad ON bad.n = sf.n LEFT JOIN together ON together.n = sf.n),
hp AS (SELECT *, greatest({', '.join(x for x in GROUPS['hp'] if x != 'composite')}) AS most, least(1.0, 0.15 * ({' + '.join(f"CASE WHEN {x} >= 0.5 THEN 1 ELSE 0 END" for x in ('timeline_impossible', 'education_career_anomaly', 'signal_impossibility', 'identity_anomaly'))}) + 0.05 * ({' + '.join(f"CASE WHEN {x} >= 0.3 THEN 1 ELSE 0 END" for x in GROUPS['hp'] if x != 'composite')})) AS extra FROM hp0)"""


def _sql(rest: str) -> str:
    return f"WITH {WITH} {rest}"


def _rounded(cells: dict[str, str]) -> str:
    return ", ".join(f"round(({v})::DOUBLE, 9) AS {k}" for k, v in cells.items())


def _features(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    return extract_features(records(spark, d, parts), AS_OF, "similarities")


def _cells(spark: SparkSession, d: str, groups: tuple[str, ...]) -> DataFrame:
    return _features(spark, d).select("candidate_id", *(F.round(column(g, x), 9).alias(column(g, x)) for g in groups for x in GROUPS[g]))


_CAREER = {column("career", x): x for x in GROUPS["career"]} | {
    "pvs__product_density": "product_company_density", "pvs__consulting_density": "consulting_density", "pvs__product_recent": "product_recent", "exp__years": "years_of_experience", "exp__in_band": "0.5", "exp__derived_vs_stated_gap": "1 - experience_authenticity",
    "sen__level": "progression_quality", "sen__title_vs_scope_gap": "title_inflation", "co__scale_progression": "company_progression", "co__industry_relevance": "product_company_density", "lead__scope": "1 - management_only", "lead__management_only": "management_only",
    "startup__small_co_experience": "small", "startup__shipping_signal": "production_exposure", "found__ownership": "founder", "found__breadth": "0.5",
}
CAREER_GROUPS = ("career", "pvs", "exp", "sen", "co", "lead", "startup", "found")


@query("r10_career_features", _sql(f"SELECT candidate_id, {_rounded(_CAREER)} FROM p JOIN cf ON cf.n = p.n"))
def r10(spark: SparkSession, d: str) -> DataFrame:
    """33 features of roles: progression, tenure, density, depth, authenticity (G-H, AGG-18 to 21, W-2 to W-4)."""
    return _cells(spark, d, CAREER_GROUPS)


_hub = "CASE WHEN fit = 'hub' OR in_hub THEN 1.0 ELSE 0.0 END"
_SIGNALS = {
    "id__is_valid_id": "1.0", "geo__hub_match": _hub, "geo__india_relocatable": "CASE WHEN fit IN ('hub', 'relocatable') THEN 1.0 ELSE 0.0 END", "geo__outside_india_no_sponsor": "CASE WHEN fit = 'outside' THEN 1.0 ELSE 0.0 END",
    "edu__tier_score": "tier_score", "edu__field_relevance": "field_relevance", "edu__timeline_valid": "timeline_valid",
    "oss__activity": "CASE WHEN github_activity_score <> -1 THEN github_activity_score / 100 ELSE 0 END", "oss__has_external_validation": _unit(f"0.6 * CASE WHEN github_activity_score > 20 THEN 1 ELSE 0 END + 0.6 * {_k2('cited', 3)}"),
    "avail__open": "is_open", "avail__recency": "recency", "avail__available": "available", "eng__passive": "passive", "eng__active": "active", "eng__network": _k2("connection_count", 1500), "eng__velocity": "0.5 * active + 0.5 * passive",
    "resp__rate": "recruiter_response_rate", "resp__speed": "24.0 / (24.0 + avg_response_time_hours)", "resp__reliable": "reliable", "sal__fit": "0.5", "sal__is_inverted": "CASE WHEN salary_min > salary_max THEN 1.0 ELSE 0.0 END",
    "reloc__willing": "CASE WHEN willing_to_relocate THEN 1.0 ELSE 0.0 END", "reloc__needed": f"1 - {_hub}", "notice__fit": "CASE WHEN notice_period_days <= 30 THEN 1.0 WHEN notice_period_days <= 60 THEN 0.6 ELSE 0.25 END", "notice__over_30": "CASE WHEN notice_period_days > 30 THEN 1.0 ELSE 0.0 END",
    "bhv__availability": "available", "bhv__recruitability": "(is_open + reliable + saves) / 3", "bhv__response_reliability": "reliable", "bhv__interview_reliability": "interview_completion_rate", "bhv__market_demand": "demand", "bhv__market_momentum": "demand * recency90",
    "bhv__engagement_velocity": "0.6 * active + 0.4 * passive", "bhv__candidate_temperature": "available * recency90 * (0.5 + 0.5 * active)", "bhv__recruiter_attractiveness": "demand", "bhv__hiring_probability_proxy": "available * reliable * reliability",
    "bhv__freshness": f"0.7 * recency90 + 0.3 * pow(0.5, greatest({_DAY0} - signup_date, 0) / 365.0)", "bhv__trust": "0.4 * profile_completeness_score / 100 + 0.6 * (verified_email::INT + verified_phone::INT + linkedin_connected::INT) / 3.0",
    "bhv__signal_consistency": "consistent", "bhv__behavioral_confidence": "0.5 * (1 - unknowns) + 0.5 * consistent", "bhv__behavioral_risk": "((1 - available) + (1 - reliability) + (1 - consistent)) / 3",
}
SIGNAL_GROUPS = ("id", "geo", "edu", "oss", "avail", "eng", "resp", "sal", "reloc", "notice", "bhv")


@query("r11_signal_features", _sql(f"SELECT candidate_id, {_rounded(_SIGNALS)} FROM sf JOIN cf ON cf.n = sf.n JOIN ef ON ef.n = sf.n"))
def r11(spark: SparkSession, d: str) -> DataFrame:
    """40 features of places, studies and activity signals."""
    return _cells(spark, d, SIGNAL_GROUPS)


_TITLE = _tokens("current_title")
_COHERENCE = {
    "cons__title_role_coherence": f"CASE WHEN len({_TITLE}) > 0 THEN len(list_intersect({_TITLE}, current_tokens)) / len({_TITLE})::DOUBLE ELSE 0 END",
    "cons__skill_role_coherence": "CASE WHEN len(skill_tokens) > 0 THEN len(list_intersect(skill_tokens, career_tokens)) / len(skill_tokens)::DOUBLE ELSE 0 END",
    "cons__summary_coherence": f"CASE WHEN len({_tokens('summary || chr(32) || headline')}) > 0 THEN len(list_intersect({_tokens('summary || chr(32) || headline')}, list_concat(career_tokens, {_TITLE}))) / len({_tokens('summary || chr(32) || headline')})::DOUBLE ELSE 0 END",
}
_CONCEPT_CELLS = {column(g, x): f"max({x}) FILTER (g = '{g}')" for g in Q.CONCEPTS for x in GROUPS[g]}


@query("r12_competency_features", _sql(f"SELECT candidate_id, {_rounded(_CONCEPT_CELLS)}, {_rounded({k: f'any_value({v})' for k, v in _COHERENCE.items()})} FROM p JOIN co ON co.n = p.n JOIN cf ON cf.n = p.n JOIN sk ON sk.n = p.n GROUP BY candidate_id"))
def r12(spark: SparkSession, d: str) -> DataFrame:
    """45 features of the nine competencies with their similarities, and three of coherence (J-5, SET-1 to SET-3, K-8)."""
    return _cells(spark, d, (*Q.CONCEPTS, "cons"))


_RISK = {"risk__uncertainty": "uncertainty", "risk__contradiction": "(salary_anomaly + 0.5 * title_seniority_anomaly + 0.5 * behavioral_inconsistency) / 3", "risk__confidence": "1 - uncertainty"}
_DETECTED = {column("hp", x): x for x in GROUPS["hp"] if x != "composite"} | {"hp__composite": _unit("most + (1 - most) * extra")}


@query("r13_detector_features", _sql(f"SELECT candidate_id, {_rounded(_DETECTED | _RISK)} FROM p JOIN hp ON hp.n = p.n"))
def r13(spark: SparkSession, d: str) -> DataFrame:
    """The graded detectors and their composite (G-H1 to G-H13, J-7, AGG-21)."""
    return _cells(spark, d, ("hp", "risk"))


_wide = ", ".join(f"max({x}) FILTER (g = '{g}') AS {g}_{x}" for g in Q.CONCEPTS for x in ("claimed", "trust", "in_career", "semantic", "competency", "sure", "x"))
_CO = f", cw AS (SELECT n, avg(claimed) AS all_claimed, avg(trust * in_career * semantic) AS all_backed, {_wide} FROM co GROUP BY n)"
_LATENT = {
    "jd__retrieval_ranking": "(retr_competency + rank_competency + ir_competency) / 3", "jd__production_ml": "(mle_competency + mlops_competency + product_company_density) / 3", "jd__product_company": "(product_company_density + product_recent) / 2",
    "jd__shipping_mentality": "(production_exposure + founder) / 2", "jd__eval_framework": "eval_competency", "jd__hybrid_retrieval": "ir_competency", "jd__keyword_only": _unit("all_claimed - all_backed"), "jd__consulting_only": "consulting_density",
    "jd__title_chaser": "(title_inflation + 1 - stability) / 2", "jd__pure_researcher": "(research_only + 1 - production_exposure) / 2", "jd__framework_enthusiast": "(llm_claimed + 1 - llm_trust) / 2", "jd__inactive": "((1 - available) + (1 - reliable) + (1 - available)) / 3",
}


@query("r14_latent_features", f"WITH {WITH}{_CO} SELECT candidate_id, {_rounded(_LATENT)} FROM sf JOIN cf ON cf.n = sf.n JOIN cw ON cw.n = sf.n")
def r14(spark: SparkSession, d: str) -> DataFrame:
    """The twelve latent cells."""
    return _cells(spark, d, ("jd",))


_struct_ = _unit(f"0.55 + 0.40 * {_k2('roles', 4)}")
_text_ = _unit(f"0.30 + 0.55 * described + 0.10 * {_k2('roles', 4)}")
_mixed_ = f"greatest({_text_}, 0.5 * {_struct_})"
_place_ = "CASE fit WHEN 'hub' THEN 0.95 WHEN 'non_relocatable' THEN 0.5 ELSE 0.85 END"
_SURE = [
    "CASE WHEN timeline_impossible > 0 THEN 0.97 ELSE 0.9 END", _unit("0.4 + 0.1 * n_unused"), "0.6", "0.55", "CASE WHEN education_career_anomaly >= 0.8 THEN 0.95 ELSE 0.85 END", "0.4", _unit("0.5 + 0.1 * gap"), _unit("0.4 + 0.05 * n_stuffed"), "0.6", "0.95", "0.7",
]
_CONF = {
    "id": "1.0", "geo": _place_, "exp": f"(0.9 + 0.3 + {_struct_}) / 3", "sen": f"(0.5 * ({_struct_} + {_text_}) + {_text_}) / 2", "edu": "CASE WHEN studies > 0 THEN (0.95 + CASE WHEN field_relevance > 0 THEN 0.9 ELSE 0.5 END + 0.98) / 3 ELSE 0.3 END", "co": f"({_struct_} + {_mixed_}) / 2", "pvs": _mixed_,
    "oss": "CASE WHEN github_activity_score = -1 THEN (0.15 + 0.4) / 2 ELSE (0.95 + 0.6) / 2 END", "lead": _text_, "startup": f"(0.5 + {_mixed_}) / 2", "found": "(0.5 + 0.3) / 2", "avail": "0.95", "eng": "0.95", "resp": "0.95", "sal": "(0.3 + 0.9) / 2", "reloc": f"(0.95 + {_place_}) / 2", "notice": "0.95",
    "bhv": "(0.95 + 0.85 + 0.95 + 0.9 + 0.95 + 0.7 + 0.8 + 0.8 + 0.95 + CASE WHEN offer_acceptance_rate = -1 THEN 0.5 ELSE 0.9 END + 0.95 + 0.9 + 0.8 + 0.95 + 0.8) / 15", "career": f"(0.5 * ({_struct_} + {_text_}) + 4 * {_struct_} + 5 * {_text_} + 4 * {_mixed_}) / 14",
    "cons": "(0.7 + 0.7 + 0.6) / 3", "risk": "(0.7 + 0.7 + 0.8) / 3", "hp": f"({' + '.join(_SURE)} + greatest({', '.join(_SURE)})) / 12", "jd": "1.0",
} | {g: f"(0.6 + 3 * {g}_sure + CASE WHEN {g}_x IS NULL THEN 0.2 ELSE 0.85 END) / 5" for g in Q.CONCEPTS}
_JOINED = "FROM sf JOIN cf ON cf.n = sf.n JOIN cw ON cw.n = sf.n JOIN ef ON ef.n = sf.n JOIN sk ON sk.n = sf.n JOIN hp ON hp.n = sf.n"


@query("r15_group_confidences", f"WITH {WITH}{_CO} SELECT candidate_id, {_rounded({f'conf__{g}': _CONF[g] for g in GROUPS})} {_JOINED}")
def r15(spark: SparkSession, d: str) -> DataFrame:
    """AGG-7: the confidence of each of the 32 groups."""
    return _features(spark, d).select("candidate_id", *(F.round(c, 9).alias(c) for c in CONFIDENCES))


# The slices that gates ask, gates, and the score.
_text = "lower(description)"
_GATES = f""",
facts AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY is_current DESC, start_date DESC, k) = 1 AND is_current AS holds, row_number() OVER (PARTITION BY n ORDER BY start_date DESC, k) = 1 AS latest, lower(industry) IN {tuple(Q.PRODUCT_INDUSTRIES)} AS made,
  {_any('lower(company)', Q.SLICE_FIRMS)} OR contains(lower(industry), 'consulting') OR contains({_text}, 'consulting') AS firm FROM r),
cs AS (SELECT n, sum(duration_months) AS total, sum(CASE WHEN made THEN duration_months ELSE 0 END) AS product_months, count(*) FILTER (duration_months > 0 AND duration_months < 18) / count(*) AS hop_rate,
  CASE WHEN bool_or(holds) THEN 0 ELSE greatest(round_even(max(CASE WHEN latest THEN {_DAY0} - coalesce(end_date, {_DAY0}) END) / 30.4375, 0), 0) END AS since, bool_or(made) AS ever_made, bool_or(made AND holds) AS makes, bool_and(firm) AS all_firms,
  count(*) FILTER (end_date IS NOT NULL AND abs((end_date - start_date) / 30.4375 - duration_months) > 1) AS mismatched, count(*) FILTER (holds AND end_date IS NOT NULL) AS ended,
  bool_or(is_current AND end_date IS NOT NULL) AS any_ended, bool_or(end_date IS NOT NULL AND abs((year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date) - duration_months) > 6) AS far_off FROM facts GROUP BY n),
ranked_e AS (SELECT *, CASE degree {' '.join(f"WHEN '{k}' THEN {v}" for k, v in DEGREES.items())} END AS rank FROM e),
back AS (SELECT DISTINCT x.n, x.k FROM ranked_e x JOIN ranked_e y ON x.n = y.n AND x.rank < y.rank AND x.start_year > y.end_year),
orphan AS (SELECT DISTINCT a.n FROM a ANTI JOIN s0 ON s0.n = a.n AND s0.name = a.name),
orphan_low AS (SELECT DISTINCT a.n FROM a ANTI JOIN s0 ON s0.n = a.n AND lower(s0.name) = lower(a.name)),
g0 AS (SELECT sf.n, candidate_id, years_of_experience, fit, notice_period_days, cs.*, least(total / 12.0, 50.0) AS derived, CASE WHEN total = 0 THEN 'unknown' WHEN product_months >= 2 * (total - product_months) THEN 'product' WHEN total - product_months >= 2 * product_months THEN 'services' ELSE 'mixed' END AS track,
  sk.unused, sk.experts, sk.bare, sk.credible, sk.bare / sk.skills AS stuffing, 1 - sk.credible / sk.skills AS gap, bad.first_role, ef.first_study, ef.inverted, sf.n IN (SELECT n FROM back) AS backwards, sf.n IN (SELECT n FROM orphan) AS orphaned, sf.n IN (SELECT n FROM orphan_low) AS orphaned_low,
  (SELECT coalesce(sum(competency), 0) / 3 * pow(count(*) FILTER (competency > 0.02) / 3, 2) FROM (SELECT competency FROM co WHERE co.n = sf.n AND g IN {EXPOSURE} ORDER BY competency DESC LIMIT 3)) AS exposure
  FROM sf JOIN cs ON cs.n = sf.n JOIN sk ON sk.n = sf.n JOIN bad ON bad.n = sf.n JOIN ef ON ef.n = sf.n),
g1 AS (SELECT *, list_sort(list_filter([CASE WHEN total / 12.0 > years_of_experience + 2 THEN 'tenure_exceeds_experience' END, CASE WHEN mismatched > 0 THEN 'role_duration_date_mismatch' END, CASE WHEN ended > 0 THEN 'current_role_has_end_date' END, CASE WHEN unused >= 5 THEN 'expert_skill_zero_usage' END,
    CASE WHEN inverted OR backwards THEN 'education_timeline_impossible' END, CASE WHEN first_role < first_study - 3 THEN 'career_before_education' END, CASE WHEN orphaned THEN 'assessment_for_absent_skill' END], lambda x: x IS NOT NULL)) AS integrity,
  list_sort(list_filter([CASE WHEN stuffing >= 0.6 AND gap >= 0.3 THEN 'langchain_openai_only_recent' END, CASE WHEN NOT makes AND since > 18 THEN 'no_production_code_18m' END, CASE WHEN all_firms THEN 'consulting_firms_only_career' END], lambda x: x IS NOT NULL)) AS settled FROM g0),
g2 AS (SELECT *, CASE WHEN len(settled) > 0 THEN settled ELSE list_sort(list_filter([CASE WHEN NOT ever_made AND track IN ('services', 'unknown') THEN 'pure_research_no_production' END, CASE WHEN exposure < 0.05 THEN 'primary_cv_speech_robotics_no_nlp' END, CASE WHEN derived >= 5 AND credible = 0 THEN 'closed_source_5y_no_validation' END], lambda x: x IS NOT NULL)) END AS hard,
  CASE WHEN len(settled) > 0 THEN [] ELSE list_sort(list_filter([CASE WHEN hop_rate >= 0.5 THEN 'title_chaser_sub_18m_hops' END, CASE WHEN notice_period_days > 60 THEN 'notice_over_30' END, CASE WHEN fit = 'outside' THEN 'outside_india_no_sponsor' END, CASE WHEN derived < 2 OR derived > 15 THEN 'outside_experience_band' END], lambda x: x IS NOT NULL)) END AS soft FROM g1)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return score_records(records(spark, d), POLICY)


@query("r16_gates", f"WITH {WITH}{_GATES} SELECT candidate_id, array_to_string(integrity, ',') AS integrity, len(integrity) > 0 AS is_honeypot, array_to_string(hard, ',') AS hard, array_to_string(soft, ',') AS soft, track, CAST(since AS BIGINT) AS since, round(hop_rate, 9) AS hop_rate, round(derived, 9) AS derived, CAST(credible AS BIGINT) AS credible, round(gap, 9) AS gap FROM g2")
def r16(spark: SparkSession, d: str) -> DataFrame:
    """G-I1 to G-I7, G-IV, G-E1 to G-E10, G-ES and the slices they ask (AGG-19, AGG-20, W-4, J-8)."""
    return _scored(spark, d).select(
        "candidate_id", F.array_join("integrity_codes", ",").alias("integrity"), "is_honeypot", F.array_join("hard_codes", ",").alias("hard"), F.array_join("soft_codes", ",").alias("soft"), "track", F.col("months_since_last").cast("long").alias("since"),
        F.round("hop_rate", 9).alias("hop_rate"), F.round("derived_years", 9).alias("derived"), F.col("n_credible").cast("long").alias("credible"), F.round("gap", 9).alias("gap"),
    )


@query(
    "r17_findings",
    f"""WITH {WITH}{_GATES} SELECT candidate_id, code, path FROM p JOIN (
    SELECT n, 'role_duration_date_mismatch' AS code, 'career_history[' || k || '].duration_months' AS path FROM facts WHERE end_date IS NOT NULL AND abs((end_date - start_date) / 30.4375 - duration_months) > 1
    UNION ALL SELECT n, 'current_role_has_end_date', 'career_history[' || k || '].end_date' FROM facts WHERE holds AND end_date IS NOT NULL
    UNION ALL SELECT n, 'education_timeline_impossible', 'education[' || k || '].end_year' FROM e WHERE end_year < start_year
    UNION ALL SELECT n, 'education_timeline_impossible', 'education[' || k || '].degree' FROM back) x ON x.n = p.n""",
)
def r17(spark: SparkSession, d: str) -> DataFrame:
    """G-I2, G-I3, G-I5, G-I5b role by role and degree by degree, each with its path (J-8, J-9)."""
    return integrity_findings(career_slice(_features(spark, d), POLICY), POLICY)


_OFFLINE = [
    ("current_role_has_end_date", "any_ended", 1.0), ("role_duration_date_mismatch", "far_off", 0.35), ("tenure_exceeds_experience", "years_of_experience > 0 AND total / 12.0 > 1.5 * years_of_experience", 1.0), ("expert_skill_zero_usage", "experts >= 5", 1.0),
    ("education_timeline_impossible", "inverted", 1.0), ("keyword_stuffing", "bare >= 8", 0.35), ("assessment_for_absent_skill", "orphaned_low", 1.0),
]


@query(
    "r18_offline_catalogue",
    f"""WITH {WITH}{_GATES}, o AS (SELECT candidate_id, list_sort(list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c, _ in _OFFLINE)}], lambda x: x IS NOT NULL)) AS codes, {' + '.join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c, w in _OFFLINE if w == 1)} AS hard_count,
    round(least(1.0, {' + '.join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for _, c, w in _OFFLINE)})::DOUBLE, 6) AS composite FROM g0), cut AS (SELECT least(1.0, greatest(coalesce(max(composite) FILTER (hard_count = 0), 0) + 0.001, 0.7)) AS threshold FROM o)
    SELECT candidate_id, array_to_string(codes, ',') AS codes, CAST(hard_count AS INT) AS hard_count, composite, round(threshold, 6) AS threshold FROM o, cut WHERE hard_count >= 2 OR composite >= threshold""",
)
def r18(spark: SparkSession, d: str) -> DataFrame:
    """G-O1 to G-O10, AGG-22: the suspects of the offline detectors above a threshold that soft findings alone never reach."""
    return G.suspects(_offline(spark, d)).select("candidate_id", F.array_join("codes", ",").alias("codes"), "hard_count", "composite", F.round("threshold", 6).alias("threshold"))


def _offline(spark: SparkSession, d: str) -> DataFrame:
    return G.verdicts(career_slice(_features(spark, d), POLICY), "candidate_id", offline_gates(POLICY))


@query(
    "r19_detector_prevalence",
    f"""WITH {WITH}{_GATES}, x AS (SELECT unnest([{', '.join(f"struct_pack(flag := '{k}', severity := '{'HARD' if w == 1 else 'SOFT'}', hit := ({c})::INT)" for k, c, w in _OFFLINE)}]) AS z FROM g0)
    SELECT z.flag AS code, z.severity AS severity, CAST(sum(z.hit) AS BIGINT) AS fired, round(avg(z.hit), 6) AS prevalence, CASE WHEN z.severity = 'HARD' AND avg(z.hit) <= 0.02 THEN 3.0 ELSE 1.0 END::DOUBLE AS weight FROM x GROUP BY 1, 2""",
)
def r19(spark: SparkSession, d: str) -> DataFrame:
    """G-O11, G-O13, AGG-6, AGG-23: how often each detector fires, and its weight within a budget of 2 %."""
    from evidentia.operators.calibrate import recalibrate_risk

    seen = G.rule_set(_offline(spark, d), offline_gates(POLICY))
    return recalibrate_risk(seen.withColumn("share", F.col("fired") / F.col("rows"))).select("code", "severity", "fired", F.round("share", 6).alias("prevalence"), "weight")


_RAW = {
    "skill_match": "(SELECT sum(competency) / 3 * (count(*) FILTER (competency > 0.02) / 3) FROM (SELECT competency FROM co WHERE co.n = sf.n ORDER BY competency DESC LIMIT 3))", "semantic_fit": "0.5", "career_fit": "(progression_quality + product_company_density) / 2", "experience_fit": "(0.5 + experience_authenticity) / 2", "education_fit": "(tier_score + field_relevance + timeline_valid) / 3",
    "credibility": f"({' + '.join(_COHERENCE.values())}) / 3", "archetype_fit": "0.0",
}
_family = {"availability": "CASE WHEN open_to_work_flag THEN 1.0 ELSE 0.4 END", "responsiveness": "recruiter_response_rate", "engagement": "recency90", "reliability": "interview_completion_rate"}
_weights = sum(v for k, v in BEHAVIOUR_WEIGHTS.items() if k != "verification")
_known = " + ".join(f"{BEHAVIOUR_WEIGHTS[k]} * ({v})" for k, v in _family.items())
_SCORE = f""",
sc AS (SELECT sf.n, sf.candidate_id, {', '.join(f'{v} AS raw_{k}' for k, v in _RAW.items())}, 0.6 + 0.4 * ({_known} + CASE WHEN offer_acceptance_rate >= 0 THEN {BEHAVIOUR_WEIGHTS['verification']} * offer_acceptance_rate ELSE 0 END) / ({_weights} + CASE WHEN offer_acceptance_rate >= 0 THEN {BEHAVIOUR_WEIGHTS['verification']} ELSE 0 END) AS behaviour,
  {_unit("greatest(0.5, CASE WHEN fit IN ('hub', 'relocatable') THEN 1.0 WHEN fit = 'non_relocatable' THEN 0.8 ELSE 0.55 END * CASE WHEN notice_period_days <= 30 THEN 1.0 WHEN notice_period_days <= 60 THEN 0.6 ELSE 0.25 END * CASE WHEN salary_min > salary_max THEN 0.9 ELSE 1.0 END)")} AS logistics,
  ({' + '.join(f"{CONFIDENCE_WEIGHTS[f'conf__{g}']} * ({_CONF[g]})" for g in GROUPS)}) / {sum(CONFIDENCE_WEIGHTS.values())} AS confidence {_JOINED}),
sd AS (SELECT sc.*, len(integrity) > 0 OR len(hard) > 0 AS floored, {' + '.join(f'{w} * raw_{k}' for k, w in COMPONENT_WEIGHTS.items())} AS base FROM sc JOIN g2 ON g2.candidate_id = sc.candidate_id),
fin AS (SELECT *, CASE WHEN floored THEN 0 ELSE 0.5 + confidence * (base * behaviour * logistics - 0.5) END AS score FROM sd)"""
_PARTS = {f"raw_{k}": f"raw_{k}" for k in _RAW} | {x: x for x in ("base", "behaviour", "logistics", "confidence", "score")}


@query("r20_scores", f"WITH {WITH}{_CO}{_GATES}{_SCORE} SELECT candidate_id, floored, {_rounded(_PARTS)} FROM fin")
def r20(spark: SparkSession, d: str) -> DataFrame:
    """E-3 to E-6, AGG-8 to AGG-11: the components, multipliers, confidence and score of every record."""
    return _scored(spark, d).select("candidate_id", "floored", *(F.round(c, 9).alias(c) for c in _PARTS))


@query("r21_top_records", f"WITH {WITH}{_CO}{_GATES}{_SCORE} SELECT candidate_id, CAST(row_number() OVER (ORDER BY floored, round(score, 6) DESC, candidate_id) AS INT) AS rank, round(score, 6) AS score FROM fin QUALIFY rank <= 100")
def r21(spark: SparkSession, d: str) -> DataFrame:
    """W-1, T-1, E-7: the top 100 by score as it is shown, ties by id."""
    shown = _scored(spark, d).withColumn("score", F.round("score", 6))
    return rank_records(shown, POLICY, exact=False).select("candidate_id", F.col("rank").cast("int").alias("rank"), "score")


@query(
    "r22_code_histogram",
    f"WITH {WITH}{_GATES} SELECT code, count(*) AS n FROM (SELECT unnest(list_concat(hard, soft, integrity)) AS code FROM g2) GROUP BY code",
)
def r22(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: how many records each code applies to."""
    return G.histogram(_scored(spark, d), "hard_codes", "soft_codes", "integrity_codes")


_every = {column(g, x): v for g, x, v in ((k.split("__")[0], k.split("__")[1], v) for k, v in (_CAREER | _SIGNALS).items())}


@query(
    "r23_feature_profile",
    f"""WITH {WITH}, f AS (SELECT {_rounded(_every)} FROM sf JOIN cf ON cf.n = sf.n JOIN ef ON ef.n = sf.n), u AS (UNPIVOT f ON COLUMNS(*) INTO NAME feature VALUE x)
    SELECT feature, count(*) AS n, round(min(x), 4) AS least, round(avg(x), 4) AS mean, round(max(x), 4) AS most FROM u GROUP BY feature""",
)
def r23(spark: SparkSession, d: str) -> DataFrame:
    """AGG-2 over features: their bounds and means over the whole pool."""
    wanted = [c for c in LAYOUT if c in _every]
    cells = _features(spark, d).select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), 9).alias("x")) for c in wanted))).alias("c"))
    return cells.groupBy("c.feature").agg(F.count("*").alias("n"), F.round(F.min("c.x"), 4).alias("least"), F.round(F.avg("c.x"), 4).alias("mean"), F.round(F.max("c.x"), 4).alias("most"))
