"""Kernels against plain Python, with properties."""

import math

import pytest
from evidentia.functions import kernels as K
from evidentia.functions import text as T
from evidentia.operators import calibrate as C
from evidentia.operators import lineage as L
from evidentia.sources.files import check_config, deep_merge
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_values(spark):
    lit = F.lit
    got = spark.range(1).select(
        K.bounded_log(lit(50), 50).alias("a"), K.inverse_bounded(lit(24.0), 24).alias("b"), K.recency(lit(180), 180).alias("c"), K.band_jaccard(lit(5.0), lit(1.0), lit(3.0), lit(7.0)).alias("d"), K.affine(lit(0.5), 0.6, 1.0).alias("e"), K.shrink(lit(1.0), lit(0.4)).alias("f"),
        K.net_fit(lit(0.6), lit(0.2)).alias("g"), K.intensity(lit(0.5)).alias("h"), K.evidence_intensity(lit(9)).alias("i"), K.article(lit("Engineer")).alias("j"), K.percent(lit(0.125)).alias("k"), K.duration_text(lit(61234)).alias("l"), K.noisy_or(F.array(lit(0.5), lit(0.5))).alias("m"), K.mean_array(F.array().cast("array<double>")).alias("n"),
        K.weighted_mean(F.array(lit(1.0), lit(3.0)), F.array(lit(0.0), lit(0.0))).alias("o"), K.interpolate(lit(15.0), [(0, 0.0), (10, 1.0), (20, 0.0)]).alias("p"), K.months_between_ym(F.to_date(lit("2020-11-30")), F.to_date(lit("2022-02-01"))).alias("q"),
    ).first()
    want = (1.0, 0.5, 0.5, 2 / 6, 0.8, 0.7, 0.7, "GOOD", 0.85, "an", "12%", "01:01.234", 0.75, 0.0, 2.0, 0.5, 15)
    for x, y in zip(got, want, strict=True):
        assert x == pytest.approx(y) if isinstance(y, float) else x == y


def test_not_finite_is_an_error(spark):
    with pytest.raises(Exception, match="finite"):
        one(spark, K.clamp_unit(F.lit(float("nan"))))
    assert one(spark, K.clamp_unit(F.lit(7.0))) == 1.0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(0.1, 1e4)), min_size=1, max_size=20))
def test_bounded_and_rising(spark, xs):
    xs = sorted(xs)
    df = spark.createDataFrame([(float(x),) for x, _ in xs], "x double")
    got = [r[0] for r in df.select(K.bounded_log(F.col("x"), xs[0][1])).collect()]
    assert all(0 <= g <= 1 for g in got) and got == sorted(got)


def test_hash_pick_is_the_digest(spark):
    import hashlib

    for s in ("", "abc", "é"):
        assert one(spark, K.hash_pick(F.lit(s), 1000)) == int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big") % 1000


def test_text(spark):
    got = spark.createDataFrame([("Café  Noir",), ("plain",), (None,)], "t string").select(T.normal_text(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["café noir", "plain", None]
    assert one(spark, T.skeleton(F.lit("CAND_12 has 3.5 years"))) == "<id> has <n> years"
    assert one(spark, T.without_hedges(F.lit("I built x. I am still building depth in y."), ("still building depth",))) == "I built x."
    assert one(spark, T.tokens(F.lit("The C++ and c# a by x2"))) == ["c++", "c#", "x2"]
    assert one(spark, T.overlap_ratio(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0


def test_metrics():
    import numpy as np

    tiers = np.array([0, 4, 3, 0, 2])
    assert C.metric_of(tiers.astype(float), tiers) > C.metric_of(-tiers.astype(float), tiers)
    w = C.floor_weights(np.array([1.0, 0, 0]))
    assert w.sum() == pytest.approx(1) and w.min() >= 0.12
    assert C.is_monotone(C.identity_curve()) and len(C.identity_curve()) == 17


def test_inversions(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 1.5), (4, 4.0)], "a int, b double")
    assert C.inversions(df, "a", "b").first().n == 1
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(300), rng.random()) for _ in range(2000)]
    low, high = {}, {}
    for a, b in rows:
        low[a], high[a] = min(low.get(a, 2), b), max(high.get(a, -1), b)
    want = sum(low[a] < max((high[x] for x in high if x < a), default=-1) for a in low)
    assert C.inversions(spark.createDataFrame(rows, "a int, b double"), "a", "b").first().n == want
    assert C.inversions(df.limit(0), "a", "b").first().n == 0


def test_permutation_importance(spark):
    """A feature that makes the tier matters, one that has no weight does not; every move is a permutation."""
    import random

    rng = random.Random(5)
    rows = [(k, x := rng.random(), rng.random(), int(5 * x)) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, a double, b double, tier int").repartition(5)
    got = {r.feature: r.importance for r in C.permutation_importance(df, ["a", "b"], [1.0, 0.0], "tier", "id").collect()}
    assert got["a"] > 0.9 and abs(got["b"]) < 1e-9
    again = {r.feature: r.importance for r in C.permutation_importance(df.repartition(2), ["a", "b"], [1.0, 0.0], "tier", "id").collect()}
    assert got == pytest.approx(again, abs=1e-12)
    for n in (1, 2, 3, 6, 7, 100):
        a, b = C._permutation(n, 7, "f", 1)
        assert sorted((a * k + b) % n for k in range(n)) == list(range(n))
    assert C.permutation_importance(df.limit(0), ["a"], [1.0], "tier", "id").count() == 0


def test_permutation_importance_in_memory(spark):
    """The columns moved in memory say what the join says, with unknown values, and each feature is computed once a row."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(k, rng.random(), rng.random() if k % 7 else None, rng.randrange(4)) for k in range(301)]
    computed = spark.sparkContext.accumulator(0)
    costly = F.udf(lambda x: (computed.add(1), x)[1], "double")
    df = spark.createDataFrame(rows, "id int, a double, b double, tier int").repartition(5).withColumn("c", costly("a"))
    said = [{r.feature: r.importance for r in C.permutation_importance(df, ["a", "b", "c"], [0.7, 0.2, 0.1], "tier", "id", held=held).collect()} for held in (0, 301)]
    assert len(said[1]) == 3 and said[0] == pytest.approx(said[1], abs=1e-12)
    computed.value = 0
    C.permutation_importance(df, ["a", "b", "c"], [0.7, 0.2, 0.1], "tier", "id").collect()
    assert computed.value == 301


def test_weight_search_over_many_rows(spark):
    """More labelled rows than the search once took, with ties and rows out of order, against the search in one place."""
    import numpy as np
    from pyspark.sql import functions as F

    n = 100_001
    df = spark.range(n).select("id", *(F.round(F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(1000)) / 1000, 1).alias(c) for c in "ab"), (F.pmod(F.xxhash64(F.lit("v"), "id"), F.lit(4)) == 0).alias("val"))
    df = df.withColumn("tier", F.floor(3 * F.col("a") + F.pmod(F.col("id"), F.lit(2))).cast("int"))
    got = {r.component: r for r in C.weight_search(df.repartition(7, "b"), ["a", "b"], "tier", "id", "val", draws=6).collect()}
    rows = df.orderBy("id").toPandas()
    a, b, y, val = (rows[c].to_numpy() for c in ("a", "b", "tier", "val"))
    metric = lambda w, side: C.metric_of(w[0] * a[side] + w[1] * b[side], y[side].astype(float))
    weights = [C.floor_weights(d) for d in np.vstack([[0.5, 0.5], np.random.default_rng(7).dirichlet([1, 1], 6)])]
    trained = [metric(w, ~val) - 0.02 * float(((w - 0.5) ** 2).sum()) for w in weights]
    w = weights[int(np.argmax(trained))]
    held = metric(w, val)
    assert [got[c].weight for c in "ab"] == pytest.approx(list(w), abs=1e-12) and got["a"].train == pytest.approx(max(trained), abs=1e-12)
    assert got["a"].val == pytest.approx(held, abs=1e-12)
    assert got["a"].ablation == pytest.approx(held - metric((0, 1), val), abs=1e-12) and got["b"].ablation == pytest.approx(held - metric((1, 0), val), abs=1e-12)


def test_weight_search_without_rows_on_a_side(spark):
    rows = [(k, k / 10, int(k > 4), False) for k in range(10)]
    df = spark.createDataFrame(rows, "id int, a double, tier int, val boolean")
    assert [(r.weight, r.val, r.ablation) for r in C.weight_search(df, ["a"], "tier", "id", "val", draws=2).collect()] == [(1.0, 0.0, 0.0)]


def test_build_skips_what_is_fresh(tmp_path):
    ran = []

    def stage(name, fail=False):
        def run(up):
            ran.append(name)
            if fail:
                raise RuntimeError("no")
            return {"name": name, "up": sorted(up)}

        return run

    stages = [L.Stage("a", stage("a")), L.Stage("b", stage("b"), ("a",)), L.Stage("c", stage("c"), ("b",))]
    assert L.Build(tmp_path, stages).run() == {"a": "ran", "b": "ran", "c": "ran"}
    assert L.Build(tmp_path, stages).run() == {"a": "fresh", "b": "fresh", "c": "fresh"}
    stages[1] = L.Stage("b", stage("b"), ("a",), version="2")
    assert L.Build(tmp_path, stages).run() == {"a": "fresh", "b": "ran", "c": "fresh"}
    stages[0] = L.Stage("a", stage("a", True), version="2")
    assert L.Build(tmp_path, stages).run(keep_going=True) == {"a": "failed", "b": "blocked", "c": "blocked"}
    with pytest.raises(ValueError, match="cycle"):
        L.topological({"x": ["y"], "y": ["x"]})


def test_manifest(tmp_path):
    (tmp_path / "w.json").write_text("{}")
    L.write_manifest(tmp_path, {"weights": "w.json"})
    assert L.verify_manifest(tmp_path) == []
    (tmp_path / "w.json").write_text("{1}")
    assert L.verify_manifest(tmp_path) == ["SHA256:weights"]


def test_config():
    assert deep_merge({"a": {"x": 1, "y": [1]}}, {"a": {"y": [2]}}) == {"a": {"x": 1, "y": [2]}}
    assert check_config({"online": {}, "weights": {"a": math.inf}, "run": {"alarm_seconds": 9, "ceiling_seconds": 3}}) == ["ALARM_ABOVE_CEILING", "WEIGHT_NOT_FINITE"]
