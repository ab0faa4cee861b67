"""Nested records from lines to the written ranking."""

import csv
import json

import pool
import pytest
from evidentia.features.layout import AT_LEAST, AT_MOST, BOUNDS, CONFIDENCES, LAYOUT
from evidentia.operators import gates as G
from evidentia.operators import ranking as R
from evidentia.plans.explain import explain, salted
from evidentia.plans.ranking import Policy, finding_counts, offline_gates, rank_records, report, score_records
from evidentia.sinks.files import markdown, write_report, write_submission
from evidentia.sources.files import read_submission
from evidentia.sources.records import read_records
from pyspark.sql import functions as F

ROWS = pool.pool()
BAD = {
    "MALFORMED_JSON": '{"a": ',
    "NOT_AN_OBJECT": "[1, 2]",
    "DUPLICATE_ID": json.dumps(ROWS[0]),
    "UNKNOWN_KEY": json.dumps(ROWS[1] | {"candidate_id": "CAND_0009001", "extra": 1}),
    "BAD_ID": json.dumps(ROWS[1] | {"candidate_id": "X"}),
    "BAD_CARDINALITY": json.dumps(ROWS[1] | {"candidate_id": "CAND_0009002", "career_history": []}),
    "BAD_ENUM": json.dumps(ROWS[1] | {"candidate_id": "CAND_0009003", "signals": ROWS[1]["signals"] | {"preferred_work_mode": "moon"}}),
    "OUT_OF_RANGE": json.dumps(ROWS[1] | {"candidate_id": "CAND_0009004", "profile": ROWS[1]["profile"] | {"years_of_experience": 70.0}}),
    "MISSING_FIELD": json.dumps(ROWS[1] | {"candidate_id": "CAND_0009005", "profile": ROWS[1]["profile"] | {"headline": None}}),
    "WRONG_TYPE": json.dumps(ROWS[1] | {"candidate_id": "CAND_0009006", "skills": 3}),
}
POLICY = Policy(as_of=pool.AS_OF)


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    path = pool.write(tmp_path_factory.mktemp("pool") / "records.jsonl", ROWS, ("", *BAD.values()))
    return read_records(spark, path).cache()


@pytest.fixture(scope="module")
def scored(read):
    return score_records(read.where("reject_reason is null").select("record.*"), POLICY).cache()


@pytest.fixture(scope="module")
def ranked(scored):
    return salted(explain(rank_records(scored, POLICY), POLICY)).cache()


def test_rejects(read):
    got = {r.reject_reason: (r.line_no, r.source_index) for r in read.where("reject_reason is not null").collect()}
    n = len(ROWS)
    assert got == {k: (n + 2 + j, n + j) for j, k in enumerate(BAD)}


def test_features(scored):
    assert len(LAYOUT) == 145 and len(CONFIDENCES) == 32
    assert scored.count() == len(ROWS)
    bounds = BOUNDS | {c: (0.0, 1.0) for c in CONFIDENCES}
    assert G.bound_violations(scored, "candidate_id", bounds).count() == 0
    assert G.contract_violations(scored, "candidate_id", at_most=AT_MOST, at_least=AT_LEAST).count() == 0


def test_gates(scored):
    by = {r.candidate_id: r for r in scored.select("candidate_id", "is_honeypot", "integrity_codes", "hard_codes", "floored", "score").collect()}
    for k in (1, 2, 3):
        r = by[f"CAND_900000{k}"]
        assert r.is_honeypot and "tenure_exceeds_experience" in r.integrity_codes and "expert_skill_zero_usage" in r.integrity_codes and r.score == 0
    for k in (4, 5):
        assert "consulting_firms_only_career" in by[f"CAND_900000{k}"].hard_codes
    counts = scored.select(*(c.alias(k) for k, c in finding_counts(POLICY).items()), G.fired(offline_gates(POLICY)).alias("offline"))
    assert counts.count() == len(ROWS)


def test_ranking(ranked, scored, spark):
    rows = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 101))
    assert all(a.score >= b.score for a, b in zip(rows, rows[1:]))
    assert not {r.candidate_id for r in rows} & {f"CAND_900000{k}" for k in range(1, 6)}
    assert len({r.reasoning for r in rows}) == 100
    assert R.validate_ranking(ranked, 100, "candidate_id", text="reasoning", id_pattern=r"^CAND_[0-9]{7}$", template_share=1.1).count() == 0
    assert R.band_faults(ranked.withColumn("n", F.lit(1)), 100, "band", "n").count() == 0


def test_written_twice_alike(ranked, scored, spark, tmp_path):
    a = write_submission(ranked, tmp_path / "a.csv")
    assert a == write_submission(ranked, tmp_path / "b.csv")
    back = list(csv.reader((tmp_path / "a.csv").open()))
    assert back[0] == ["candidate_id", "rank", "score", "reasoning"] and len(back) == 101
    assert read_submission(spark, str(tmp_path / "a.csv")).count() == 100
    said = report(scored, ranked, POLICY)
    assert said["reproducible"]["counts"]["records"] == len(ROWS)
    assert write_report(said, tmp_path / "r.json") == write_report(said, tmp_path / "s.json")
    assert markdown(ranked.orderBy("rank"), ["rank", "candidate_id"], 3).count("\n") == 5


def test_too_few_is_an_error(scored):
    with pytest.raises(Exception, match="fewer than"):
        rank_records(scored.limit(5), POLICY).collect()


def test_vectors_settle_what_is_left(spark, read):
    """Blocked records never meet the vectors; a missing vector still scores."""
    recs = read.where("reject_reason is null").select("record.*").limit(20)
    ids = [r.candidate_id for r in recs.select("candidate_id").collect()]
    vectors = spark.createDataFrame([(i, [1.0, 0.1 * k]) for k, i in enumerate(ids[:10])], "id string, vector array<double>")
    anchors = spark.createDataFrame([("jd.retr", "positive", [1.0, 0.0]), ("jd.neg", "negative", [0.0, 1.0])], "id string, polarity string, vector array<double>")
    got = score_records(recs, POLICY, vectors, anchors)
    assert got.count() == 20
    assert got.where("candidate_id in ('" + "','".join(ids[10:]) + "') and best_anchor is not null").count() == 0
    assert got.where("best_anchor = 'jd.retr' and retr__semantic > 0.5").count() > 0
