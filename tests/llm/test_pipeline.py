"""The stages one after another over the smallest tables, and each against brute force over odd rows."""

from collections import Counter

import pytest
from conftest import SMALL
from evidentia.llm.common import stored, table
from evidentia.llm.exact_dedup import exact_dedup
from evidentia.llm.near_dedup import near_duplicates
from test_operators import WHITE, brute_components, brute_mix, odd_rows
from test_operators import table as made


def test_stages(spark):
    import corpus_pipeline as C

    docs = table(spark, SMALL, "documents")
    names, cols = [n for n, _ in C.STAGES], docs.columns
    assert names == ["language", "exact_dedup", "near_dedup", "mixing", "encoding"] and C.ORACLE_SQL is None
    for name, stage in C.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SMALL), name).df
        if name != "encoding":
            assert docs.columns == cols
        if name == "exact_dedup":
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r.doc_id for r in exact_dedup(before).where("kept").collect())
        if name == "near_dedup":
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted({r.component_id for r in near_duplicates(before).collect()})
    assert docs.count() == C.run(spark, SMALL).count() > 0


@pytest.fixture(scope="module")
def odd(spark):
    return stored(made(spark, odd_rows()).repartition(3), "odd-stages").df


def test_empty_tables(spark):
    import corpus_pipeline as C

    for name, stage in C.STAGES:
        out = stage(spark, made(spark, []), SMALL)
        assert out.count() == 0 and (name == "encoding" or out.columns == made(spark, []).columns)


def test_exact_stage(spark, odd):
    """Which rows stay, not only how many."""
    import corpus_pipeline as C

    best = {}
    for i, t, lang, source in odd_rows():
        key = WHITE.sub("", t or "")
        best[key] = min(best.get(key, (1, True, 0)), (-len(t or ""), i is None, i))
    got = C.exact(spark, odd, SMALL).collect()
    assert Counter(WHITE.sub("", r.text or "") for r in got) == Counter(best.keys())
    assert all(r.doc_id == best[WHITE.sub("", r.text or "")][2] for r in got)


def test_near_stage(spark, odd):
    import corpus_pipeline as C

    component = {}
    for i, _, c in brute_components(odd_rows(), 5, 4, 5):
        component.setdefault(i, set()).add(c)
    got = Counter(r.doc_id for r in C.near(spark, odd, SMALL).collect())
    assert got == Counter(i for i, *_ in odd_rows() if i in component[i])


def test_mix_stage(spark, odd):
    import corpus_pipeline as C

    times = {}
    for i, n, taken in brute_mix(spark, odd_rows()):
        if n:
            times[i] = max(times.get(i, 0), taken // n)
    got = Counter(r.doc_id for r in C.mix(spark, odd, SMALL).collect())
    want = Counter()
    for i, t, *_ in odd_rows():
        if len((t or "").split()) and times[i]:
            want[i] += times[i]
    assert got == want
