"""Checks of artifacts, files in and out, and operators that no query covers."""

import gzip
import json
import math

import pool
import pytest
from evidentia.features.layout import FEATURE_NEEDS, GROUPS, LAYOUT, layout_hash
from evidentia.functions import kernels as K
from evidentia.operators import artifacts as A
from evidentia.operators import calibrate as C
from evidentia.operators import gates as G
from evidentia.operators import lineage as L
from evidentia.operators import profile as P
from evidentia.operators import ranking as R
from evidentia.operators import vectors as V
from evidentia.plans import explain as E
from evidentia.plans.ranking import Policy, score_records
from evidentia.sinks.files import write_features, write_vectors
from evidentia.sources.files import artifact_hashes, read_labels, read_snapshot, read_vectors
from evidentia.sources.records import only_ids, read_records, sample_head
from pyspark.sql import functions as F


def test_predicates():
    assert A.weights_sound({"a": 0.5, "b": 0.5}, ["a", "b"]) == []
    assert A.weights_sound({"a": math.nan, "c": 0.1}, ["a", "b"], least=0.2) == ["NOT_FINITE:a", "BELOW:c", "MISSING:b", "UNKNOWN:c"]
    assert A.weights_sound({"a": 0.5, "b": 0.6}) == ["SUM_NOT_ONE"]
    assert A.knots_sound(C.identity_curve()) == [] and A.knots_sound([(0, 0.5), (0, 0.2), (1, 3.0)]) == ["INPUTS_DO_NOT_RISE", "OUTPUTS_FALL", "OUT_OF_BOUNDS"]
    assert A.thresholds_sound({"a": 0.7, "b": 1.5}) == ["OUT_OF_BOUNDS:b"]
    assert A.codes_known(["x", "y", "x"], ["x"]) == ["UNKNOWN:y", "REPEATED:x"] and A.not_blank(["a", " ", ""]) == ["BLANK:1", "BLANK:2"]
    found = A.run_predicates({"w": {"a": 2.0}, "t": {"z": 0.5}}, {"w": [A.weights_sound], "t": [A.thresholds_sound]}, required=["w", "k"])
    assert found == {"w": ["SUM_NOT_ONE"], "k": ["NOT_THERE"]}


def test_table_predicate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), (None, 2.0)], "id string, x double")
    assert A.table_sound(df, ["id"], ["x"]) == ["REPEATED_KEY", "NULL_KEY:id", "NOT_FINITE:x"]
    assert A.table_sound(df.limit(0), ["id"]) == ["WRONG_ROW_COUNT"] and A.table_sound(df.where("id = 'a' and x = 1"), ["id"], ["x"], rows=1) == []


def test_coherence():
    assert A.coherence(layout_hash(), layout_hash(), {"store": 8, "anchors": 8}, {"jd": 3, "matrix": 3}, 145, 145) == []
    assert A.coherence("a", "b", {"store": 8, "anchors": 9}, {"jd": 3, "matrix": 4}, 145, 144) == ["LAYOUT_HASH", "DIMENSIONS:anchors=9,store=8", "ANCHORS:jd=3,matrix=4", "FEATURES"]


def test_certificate(spark, tmp_path):
    (tmp_path / "w.json").write_text("{}")
    L.write_manifest(tmp_path, {"weights": "w.json"})
    rows = spark.createDataFrame([(f"c{k}", k, 1.0 - k / 10) for k in range(1, 4)], "candidate_id string, rank int, score double")
    good = A.certificate(tmp_path, rows, rows, ["score"], rows, lambda: {"w": "1", "log": "x"}, {"w": "1", "log": "y"}, rows=3, skip=["log"])
    assert good["reproducible"] and all(c["ok"] for c in good["checks"].values())
    moved = rows.withColumn("score", F.when(F.col("rank") == 2, 5.0).otherwise(F.col("score")))
    (tmp_path / "w.json").write_text("{1}")
    bad = A.certificate(tmp_path, rows, moved, ["score"], moved, lambda: {"w": "2"}, {"w": "1"}, rows=3)
    assert not bad["reproducible"] and not any(c["ok"] for c in bad["checks"].values())
    assert bad["checks"]["manifest_reload"]["faults"] == ["SHA256:weights"] and bad["checks"]["rerun_determinism"]["differ"] == ["w"] and bad["checks"]["dry_run_ranking"]["faults"] == ["SCORE_INCREASING"]


def test_budget():
    now = [10.0]
    b = A.Budget(5, clock=lambda: now[0])
    now[0] = 14.0
    assert (b.used, b.left, b.exit_code()) == (4.0, 1.0, 0)
    now[0] = 16.0
    assert (b.left, b.exit_code()) == (0.0, 3)
    with pytest.raises(ValueError):
        A.Budget(0)


def test_feature_lineage():
    graph = A.FeatureGraph(FEATURE_NEEDS)
    order = {x: k for k, x in enumerate(graph.order())}
    assert set(order) == set(LAYOUT) and all(order[p] < order[c] for c, ps in FEATURE_NEEDS.items() for p in ps)
    assert graph.upstream("jd__hybrid_retrieval") == {"ir__competency", "ir__claimed", "ir__trust", "ir__in_career", "ir__semantic"}
    assert "jd__consulting_only" in graph.downstream("career__consulting_density") and "hp__composite" in graph.downstream("sal__is_inverted")
    with pytest.raises(ValueError, match="cycle"):
        A.FeatureGraph({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError, match="unknown"):
        A.FeatureGraph({"a": ["x"]})


def test_hallucinations(spark):
    rows = [("a", "career_history[0].description"), ("b", "career_history[1].description"), ("c", "career_history[2].description"), ("d", "raw_skill_match"), ("e", "made.up"), ("f", None), ("g", "career_history[0].salary"), ("h", "career_history[x].description")]
    df = spark.createDataFrame(rows, "id string, evidence string").withColumn("career_history", F.expr("array(named_struct('description', 'built', 'months', 3), named_struct('description', ' ', 'months', 3))"))
    got = R.hallucinations(df, derived=["raw_skill_match"])
    assert sorted(r.id for r in got.collect()) == ["b", "c", "e", "f", "g", "h"] and got.columns == [*df.columns, "code"]


def test_catalogue_of_suspects(spark):
    gates = [G.Gate("h1", F.col("a") > 0, True), G.Gate("h2", F.col("b") > 0, True), G.Gate("s", F.col("c") > 0, False, 0.35)]
    df = spark.createDataFrame([("x", 1, 1, 0), ("y", 0, 0, 1), ("z", 1, 0, 1), ("n", None, 0, 0)], "id string, a int, b int, c int")
    found = G.verdicts(df, "id", gates)
    assert {(r.id, r.hard_count, r.composite) for r in found.collect()} == {("x", 2, 1.0), ("y", 0, 0.35), ("z", 1, 1.0), ("n", 0, 0.0)}
    assert G.calibrated_threshold(found).first().threshold == 0.7 and G.calibrated_threshold(found.limit(0)).first().threshold == 0.7
    assert [(r.id, r.exemplar, r.codes) for r in G.catalogue(found, "id", cap=1).orderBy("id").collect()] == [("x", True, ["h1", "h2"]), ("z", False, None)]
    assert {(r.code, r.fired, r.rows) for r in G.rule_set(found, gates).collect()} == {("h1", 2, 4), ("h2", 1, 4), ("s", 2, 4)}
    assert {(r.flag, r.fired, r.share) for r in G.prevalence(df.select((F.col("a") > 0).alias("fa"), (F.col("c") > 0).alias("fc")), ["fa", "fc"]).collect()} == {("fa", 2, 0.5), ("fc", 2, 0.5)}


def test_small_calibrations(spark):
    assert C.curve_knots([3, 1, 2, 2]) == [(1.0, 0.0), (2.0, 0.5), (3.0, 1.0)] and C.is_monotone(C.curve_knots([5, 4, 9], 0.2, 0.8))
    got = spark.range(1).select(C.composite_metric(*map(F.lit, (1.0, 0.5, 0.4, 0.2))).alias("x")).first().x
    assert got == pytest.approx(0.5 + 0.15 + 0.06 + 0.01)
    df = spark.createDataFrame([(k, float(k % 5), float(k % 2)) for k in range(50)], "id int, a double, t double")
    keys = df.withColumn("id", F.col("id") + 40)
    assert {r.key: r.side for r in P.key_differences(df, keys, "id").collect()} == {**dict.fromkeys(range(40), "left"), **dict.fromkeys(range(50, 90), "right")}
    assert sorted(r.key for r in P.shared_keys(df, keys, "id").collect()) == list(range(40, 50))


def test_hash_encoder(spark):
    got = [r.v for r in spark.createDataFrame([("a",), ("a",), ("b",), ("",)], "t string").select(V.hash_encoder(F.col("t"), 16).alias("v")).collect()]
    assert got[0] == got[1] != got[2] and all(len(v) == 16 and math.isclose(sum(x * x for x in v), 1) for v in got)


def test_files(spark, tmp_path):
    rows = pool.pool(6)[:6]
    path = tmp_path / "r.jsonl.gz"
    path.write_bytes(gzip.compress(("\n".join([json.dumps(rows[0]), "", *(json.dumps(r) for r in rows[1:])]) + "\n").encode()))
    read = read_records(spark, str(path))
    assert read.count() == 6 and [r.line_no for r in read.orderBy("line_no").collect()] == [1, 3, 4, 5, 6, 7]  # SRC-3
    records = read.where("reject_reason is null").select("record.*")
    ids = [r["candidate_id"] for r in rows]
    assert sample_head(read, 2).count() == 2
    assert sorted(r.record.candidate_id for r in only_ids(read.where("reject_reason is null"), spark.createDataFrame([(i,) for i in ids[1:3]] + [("CAND_9999999",)], "candidate_id string")).collect()) == ids[1:3]
    vectors = spark.createDataFrame([(i, [0.6, 0.8]) for i in ids], "id string, vector array<float>")
    write_vectors(vectors, str(tmp_path / "v"), dim=2)
    back = {r.id: r.vector for r in read_vectors(spark, str(tmp_path / "v")).collect()}
    assert {k: [round(x, 5) for x in v] for k, v in back.items()} == {i: [0.6, 0.8] for i in ids}
    with pytest.raises(Exception):
        write_vectors(vectors.withColumn("vector", F.expr("array(2f, 2f)")), str(tmp_path / "bad"), dim=2)
    scored = score_records(records, Policy(as_of=pool.AS_OF))
    write_features(scored, str(tmp_path / "f"), LAYOUT, [f"conf__{g}" for g in GROUPS])
    snapshot = read_snapshot(spark, str(tmp_path / "f"), LAYOUT)
    assert snapshot.count() == 6
    assert len({r[1] for r in artifact_hashes(spark, str(tmp_path / "f")).collect()}) >= 1


def test_labels(spark, tmp_path):
    head = "candidate_id,tier,reasoning,reviewer,archetype_id,is_honeypot_suspect,is_borderline,cited_features"
    lines = ['CAND_0000001,4,"good, ""very""",ann,3,false,yes,a; b;', "CAND_0000002,3,x,ann,,TRUE,,", "CAND_0000003,1,x,ann,,,,", "CAND_0000003,2,y,bob,,,,"]
    (tmp_path / "gold.csv").write_text("\n".join([head, *lines]) + "\n")
    got = {r.candidate_id: r for r in read_labels(spark, str(tmp_path / "gold.csv")).collect()}
    assert {k: r.tier for k, r in got.items()} == {"CAND_0000001": 4, "CAND_0000002": 0, "CAND_0000003": 2}  # a suspect has tier 0, the last of repeated ids wins
    first = got["CAND_0000001"]
    assert first.reasoning == 'good, "very"' and first.archetype_id == 3 and first.is_borderline and first.cited_features == ["a", "b"]


def test_explanations(spark):
    """Every text cites something that is in its record, texts differ, and the fallbacks come in their order."""
    rows = pool.pool(120)
    for k, r in enumerate(rows):
        if k % 4 == 1:
            for x in r["career_history"]:
                x["description"] = "Taught classes"
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]), schema=__import__("evidentia.sources.records", fromlist=["x"]).record_schema())
    df = df.withColumn("similarities", F.when(F.col("candidate_id") == "CAND_0000002", F.create_map(F.lit("jd.eval_framework"), F.lit(0.5))).cast("map<string,double>"))
    policy = Policy(as_of=pool.AS_OF)
    scored = score_records(df, policy)
    top = scored.withColumn("rank", F.row_number().over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("candidate_id")))
    told = E.salted(E.explain(top, policy, rows=len(rows))).cache()
    assert told.select("reasoning").distinct().count() == len(rows) and told.where("reasoning is null or evidence is null").count() == 0
    derived = [f"raw_{c}" for c in ("skill_match", "career_fit", "experience_fit", "education_fit", "credibility")] + [f"semantic.{k.replace('__', '.')}" for k in E.EVIDENCE] + [f"signals.{f}" for f in ("open_to_work_flag", "recruiter_response_rate", "github_activity_score", "saved_by_recruiters_30d")]
    assert R.hallucinations(told, derived=derived).count() == 0
    by = {r.candidate_id: r for r in told.collect()}
    assert by["CAND_0000002"].evidence == "semantic.jd.eval_framework" and "nearness" in by["CAND_0000002"].reasoning
    assert any(r.evidence.startswith("signals.") for r in by.values()) and any(r.evidence.startswith("career_history[") for r in by.values())
    words = {w for pool_ in E.WORDS.values() for w in pool_}
    assert all(any(w in r.reasoning for w in words) for r in by.values() if r.evidence.startswith("career_history["))


def test_salted_repicks(spark):
    """Equal texts take other words first, and the title only when words run out."""
    df = spark.createDataFrame([(f"c{k}", k, "same", ["same", f"other {k % 2}"]) for k in range(1, 5)], "candidate_id string, rank int, reasoning string, texts array<string>").withColumn("profile", F.expr("named_struct('current_title', 'Engineer')"))
    got = [r.reasoning for r in E.salted(df).orderBy("rank").collect()]
    assert got[:2] == ["same", "other 0"] and len(set(got)) == 4 and all("Current title" in t for t in got[2:])


def test_rank_of_pool_has_words(spark):
    assert set(E.WORDS) == {n for n, _ in K.INTENSITY} | {"LOW"} and [len(p) for p in E.WORDS.values()] == [20, 12, 12, 12]
