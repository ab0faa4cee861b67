"""Every query with SQL against DuckDB over the smallest tables; the others give rows."""

import compare
import pytest
from conftest import SMALL
from evidentia.features.layout import LAYOUT
from evidentia.plans import record_queries
from evidentia.plans.catalogue import ORACLES, QUERIES

#: Queries whose result has no rows over the smallest tables, and should have none: they look for faults.
MAY_BE_EMPTY = ()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


@pytest.fixture(scope="module")
def records(spark):
    """Features and scores of the pool, computed once for all queries that start from them."""
    return record_queries._features(spark, SMALL).cache(), record_queries._scored(spark, SMALL).cache()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name, request, monkeypatch):
    if name[0] == "r":
        features, scored = request.getfixturevalue("records")
        monkeypatch.setattr(record_queries, "_features", lambda spark, d: features)
        monkeypatch.setattr(record_queries, "_scored", lambda spark, d: scored)
    said = compare.difference(QUERIES[name](spark, SMALL), duck, ORACLES[name])
    assert said == "" or said == "no rows" and name in MAY_BE_EMPTY, said


def test_layout_in_order():
    """Every feature at its place, written out here a second time."""
    names = {
        "id": "is_valid_id", "geo": "hub_match india_relocatable outside_india_no_sponsor", "exp": "years in_band derived_vs_stated_gap", "sen": "level title_vs_scope_gap", "edu": "tier_score field_relevance timeline_valid", "co": "scale_progression industry_relevance",
        "pvs": "product_density consulting_density product_recent", **dict.fromkeys("retr rank recsys ir nlp llm mle mlops eval".split(), "claimed trust in_career semantic competency"), "oss": "activity has_external_validation", "lead": "scope management_only",
        "startup": "small_co_experience shipping_signal", "found": "ownership breadth", "avail": "open recency available", "eng": "passive active network velocity", "resp": "rate speed reliable", "sal": "fit is_inverted", "reloc": "willing needed", "notice": "fit over_30",
        "bhv": "availability recruitability response_reliability interview_reliability market_demand market_momentum engagement_velocity candidate_temperature recruiter_attractiveness hiring_probability_proxy freshness trust signal_consistency behavioral_confidence behavioral_risk",
        "career": "progression_quality stability promotion_velocity title_inflation role_consistency experience_authenticity company_progression product_company_density consulting_density technical_depth hands_on_engineering research_only management_only production_exposure",
        "cons": "title_role_coherence skill_role_coherence summary_coherence", "risk": "uncertainty contradiction confidence",
        "hp": "timeline_impossible skill_time_contradiction employment_overlap title_seniority_anomaly education_career_anomaly salary_anomaly experience_inflation keyword_stuffing behavioral_inconsistency signal_impossibility identity_anomaly composite",
        "jd": "retrieval_ranking production_ml product_company shipping_mentality eval_framework hybrid_retrieval keyword_only consulting_only title_chaser pure_researcher framework_enthusiast inactive",
    }
    assert [f"{g}__{x}" for g, xs in names.items() for x in xs.split()] == LAYOUT and len(LAYOUT) == 145


@pytest.mark.parametrize("name", ["q50_permutation_importance", "q51_kmeans_archetypes", "q52_weight_search"])
def test_gives_rows(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows
    if name == "q52_weight_search":
        assert abs(sum(r.weight for r in rows) - 1) < 1e-9 and min(r.weight for r in rows) >= 0.12 - 1e-9
    if name == "q51_kmeans_archetypes":
        assert [r.id for r in sorted(rows, key=lambda r: r.id)] == list(range(10)) and all(abs(sum(x * x for x in r.vector) - 1) < 1e-6 for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(e.queries()[n] is QUERIES[n] for n in QUERIES)


def test_compose_whole(spark, tmp_path):
    """Texts that differ late differ, short ones and those of unknown length are in, empty sections are left out."""
    import hashlib

    rows = [(1, "x" * 60 + "a", "en", "web", 61), (2, "x" * 60 + "b", "en", "web", None), (3, " ", None, "web", 1), (4, None, "", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.h for r in QUERIES["q35_compose_document"](spark, str(tmp_path)).collect()}
    said = {1: f"Language: en\nSource: web\nText: {rows[0][1]}", 2: f"Language: en\nSource: web\nText: {rows[1][1]}", 3: "Source: web", 4: ""}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in said.items()}


@pytest.mark.parametrize("block_pairs", [20, 4_000_000])
def test_cooccurrence_whole(spark, block_pairs):
    """All tokens are terms and neighbours, against counting by brute force."""
    import random
    import re
    from collections import Counter
    from itertools import permutations

    from evidentia.operators.lexicon import cooccurrence_whole

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", "alone", "The the THE x"]
    n = Counter(p for t in texts for p in permutations(set(re.findall("[a-z]+", (t or "").lower())), 2))
    said = {(a, b, n[a, b], k) for a in {a for a, _ in n} for k, b in enumerate(sorted((b for x, b in n if x == a), key=lambda b: (-n[a, b], b))[:10], 1)}
    got = cooccurrence_whole(spark.createDataFrame([(t,) for t in texts], "text string"), "text", block_pairs=block_pairs).collect()
    assert len(got) == len(said) and {tuple(r) for r in got} == said


@pytest.mark.parametrize("tasks", [1, 5])
def test_cooccurrence_in_tasks(spark, tasks):
    """Terms in one and in many documents, copies, and tasks without terms: as the blocks say; what is dealt does not grow with the pairs."""
    import random

    from evidentia.operators.lexicon import cooccurrence_whole

    rng = random.Random(8)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    texts = [" ".join(names[int(300 * rng.random() ** 3)] for _ in range(rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:9] + ["only once here"]], "text string").repartition(6)
    said = {tuple(r) for r in cooccurrence_whole(df, "text", held=0, block_pairs=1000).collect()}
    got = cooccurrence_whole(df, "text", tasks=tasks)
    rows = got.collect()
    assert len(rows) == len(said) and {tuple(r) for r in rows} == said
    assert cooccurrence_whole(df.limit(0), "text").count() == 0


@pytest.mark.parametrize(("name", "operator", "parameter", "least"), [("q52_weight_search", "weight_search", "draws", 2000), ("q51_kmeans_archetypes", "kmeans", "runs", 10)])
def test_whole_search(spark, monkeypatch, name, operator, parameter, least):
    """The registered searches are as wide as those of the reference."""
    import inspect

    from evidentia.operators import calibrate

    f, seen = getattr(calibrate, operator), []

    def spy(*args, **named):
        bound = inspect.signature(f).bind(*args, **named)
        bound.apply_defaults()
        seen.append(bound.arguments[parameter])
        return f(*args, **named)

    monkeypatch.setattr(calibrate, operator, spy)
    assert QUERIES[name](spark, SMALL).count() and seen == [least]


def test_union_of_tied_intervals(spark, tmp_path):
    """Many events of one user with the same interval, at both sides of gaps: covered days, counted one by one."""
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [(k * 100 + j, day + dt.timedelta(days=at, seconds=k), user) for k in range(20) for j, (user, at) in enumerate([(1, 0), (1, 9), (1, 20), (2, 3), (2, 3), (2, 15)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    said: dict[int, set] = {}
    for event, ts, user in rows:
        said.setdefault(user, set()).update(ts.date() + dt.timedelta(days=x) for x in range(1 + event % 4))
    assert {r.user_id: r.days for r in QUERIES["q18_interval_union_length"](spark, str(tmp_path)).collect()} == {k: len(v) for k, v in said.items()}


def test_union_of_odd_intervals(spark, tmp_path):
    """Events without a time or an id cover nothing, users of none but these have no total, and intervals that end before they start count one by one: as SQL in one thread."""
    import datetime as dt
    import random

    rng = random.Random(18)
    day = dt.datetime(2024, 1, 1)
    odd = [(1, day, 1), (2, None, 1), (None, day, 1), (3, day + dt.timedelta(days=9), 1), (4, None, 2), (None, day, 3), (-3, day, 4), (-7, day, 4), (5, None, None), (6, day, None)]
    some = [(rng.choice([None, rng.randrange(-20, 20)]), rng.choice([None, *[day + dt.timedelta(days=rng.randrange(40))] * 4]), rng.randrange(10, 60)) for _ in range(600)]
    spark.createDataFrame(odd + some, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    duck = compare.connect(str(tmp_path))
    duck.execute("SET threads = 1")
    got = QUERIES["q18_interval_union_length"](spark, str(tmp_path))
    assert {r.user_id: r.days for r in got.where("user_id < 10 or user_id is null").collect()} == {1: 6, 2: None, 3: None, 4: -4, None: 3}
    assert compare.difference(got, duck, ORACLES["q18_interval_union_length"]) == ""
