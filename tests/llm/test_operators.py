"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import compare
import numpy as np
import pytest
import regex
from conftest import SMALL
from evidentia.llm import html_text as H
from evidentia.llm import katz as K
from evidentia.llm import near_dedup as N
from evidentia.llm import personal_data as P
from evidentia.llm.common import WORD, crc_mod, stored
from evidentia.llm.components import components
from evidentia.llm.exact_dedup import exact_dedup, keep_first_copies
from evidentia.llm.html_text import extract_text, main_text
from evidentia.llm.katz import Classes, katz_scores
from evidentia.llm.language import identify_language, language_profiles, with_language
from evidentia.llm.mixing import mix_sources, mix_targets, take_mix
from evidentia.llm.near_dedup import keep_one_of_each, near_duplicates
from evidentia.llm.packing import pack, unpack
from evidentia.llm.personal_data import sanitise_spans, span_digests
from evidentia.llm.pieces import decode, encode, encode_digests
from evidentia.llm.quality import Rule, order_rules, quality
from evidentia.llm.queries import ORACLES, QUERIES, piece_model
from evidentia.llm.shingles import shingle_set
from evidentia.llm.toxicity import Lexicon, choose_entries, choose_exceptions, fold, learn_toxicity, score_toxicity
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, size string, norm string, row string"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def table(spark, rows):
    """(doc_id, text, lang, source); further columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None, "x", "x", "x", "x", "x") for i, t, lang, s in rows], SCHEMA)


def odd_rows():
    rng = random.Random(3)
    words = "the of and a thing tion er in über façade x1 don't ▁ ﬁ 中文  z".split(" ")
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(60)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, base, "en", "a"), (5, base.replace(" ", "\n"), "en", "b"), (6, base, "en", "b"), (7, base + " more", "en", "b"), (8, text(4000), "de", "a"), (9, "x" * 30_000, "en", None), (10, "one two", "en", "b"), (11, "ONE TWO", "en", "b")]
    rows += [(None, base, "en", "a"), (4, base, "en", "a"), (12, text(30) + " " + text(30), "de", "c"), (13, "\x00a\x1fb", "en", "c")]
    return rows + [(20 + k, text(rng.randint(1, 40)), rng.choice(("en", "de")), rng.choice("abc")) for k in range(30)]


@pytest.fixture(scope="module")
def odd(spark):
    return stored(table(spark, odd_rows()).repartition(3), "odd").df


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare.difference(QUERIES[name](spark, SMALL), compare.connect(SMALL), ORACLES[name]) == ""


def test_exact_dedup(odd, empty):
    rows = odd_rows()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i is None, i))
    want = Counter((i, min(groups[WHITE.sub("", t or "")])[2], len(groups[WHITE.sub("", t or "")]), hashlib.sha256(WHITE.sub("", t or "").encode()).hexdigest()) for i, t, *_ in rows)
    got = exact_dedup(odd).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(empty).count() == 0
    left = keep_first_copies(odd)
    assert left.columns == odd.columns and left.count() == len(groups)


def test_exact_dedup_over_partitions(spark):
    """One group that is larger than a partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(k, "same text" + " " * (k % 3), "en", "a") for k in range(2000)] + [(3000 + k, f"other {k}", "en", "a") for k in range(200)]
    got = exact_dedup(table(spark, rows)).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    same = [r for r in got if r.doc_id < 2000]
    assert {r.group_size for r in same} == {2000} and {r.keep_id for r in same} == {2} and sum(r.kept for r in same) == 1


def brute_discounts(counts, most=5):
    """Katz's own formula: d_r = (r*/r - q) / (1 - q)."""
    n = Counter(counts)
    out = {}
    for r in range(1, most + 1):
        q = (most + 1) * n[most + 1] / n[1] if n[1] else 1
        x = ((r + 1) * n[r + 1] / n[r] / r - q) / (1 - q) if n[r] and q < 1 else 1
        out[r] = x if 0 < x < 1 else 1
    return out


def brute_katz(train):
    """A model as a function from (u, w) to a probability, by sums over whole dictionaries."""
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["\t", *t[:-1]], t, strict=True))
    if not uni:
        return uni, lambda u, w: 1.0
    d1, d2 = brute_discounts(uni.values()), brute_discounts(bi.values())
    cut = lambda c, d: c * d.get(c, 1)
    total = sum(uni.values())
    if math.isclose(sum(cut(c, d1) for c in uni.values()), total, rel_tol=1e-9):
        total += 1
    p1 = {w: cut(c, d1) / total for w, c in uni.items()}
    unknown = 1 - math.fsum(p1.values())
    after = {}
    for (u, w), c in bi.items():
        after.setdefault(u, {})[w] = c

    def prob(u, w):
        if u not in after:
            return p1.get(w, unknown)
        s = after[u]
        n = sum(s.values())
        n += math.isclose(sum(cut(c, d2) for c in s.values()), n, rel_tol=1e-9)
        if w in s:
            return cut(s[w], d2) / n
        left = 1 - math.fsum(cut(c, d2) / n for c in s.values())
        return left / (1 - math.fsum(p1[x] for x in s)) * p1.get(w, unknown)

    return uni, prob


def check_katz(spark, rows, docs):
    key = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    got = katz_scores(docs, crc_mod("doc_id", 10) != 0).collect()
    toks = [(i, [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]) for i, t, *_ in rows]
    uni, prob = brute_katz([t for i, t in toks if key(i)])
    n, v = sum(uni.values()), len(uni)
    want = Counter((i, len(t), sum(w in uni for w in t), round(sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6), round(sum(math.log10(prob(u, w)) for u, w in zip(["\t", *t[:-1]], t, strict=True)), 6)) for i, t in toks)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} <= {n} and all(r.held_out == (key(r.doc_id) == 0) for r in got)
    return uni, prob


def test_katz(odd, empty, spark):
    uni, prob = check_katz(spark, odd_rows(), odd)
    for u in ["\t", *list(uni)[:40]]:  # each history's probabilities sum to one, unknown words included
        assert math.isclose(sum(prob(u, w) for w in uni) + prob(u, "never seen"), 1, rel_tol=1e-9)
    assert katz_scores(empty, crc_mod("doc_id", 10) != 0).count() == 0
    nothing = katz_scores(odd, F.lit(False)).collect()
    assert {r.score for r in nothing} == {0.0} and {r.n_known for r in nothing} == {0}


def test_katz_with_spread_histories(spark, monkeypatch):
    """Many chunks and buckets, and words so frequent that their pairs are spread over parts."""
    rng = random.Random(4)
    words = ["the"] * 40 + ["of"] * 20 + [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "en", "a") for k in range(400)] + [(9000 + k, "the of w1 w2 the of", "en", "a") for k in range(150)]
    check_katz(spark, rows, table(spark, rows).repartition(7))
    layout = K.Layout(Classes(sorted(Counter(Counter(w for _, t, *_ in rows for w in t.split()).values()).items()), len(rows)), 16)
    parts = layout.parts(np.arange(layout.classes.v + 2))
    assert parts[0] > 8 and parts[-3] == 1 and parts[layout.classes.v + 1] > 1
    u, v = np.zeros(500, np.int64), np.arange(500)
    assert set(layout.bucket(u, v)) <= set(layout.buckets_of(0)) and len(set(layout.bucket(u, v))) > 4


PII = [
    "mail a.b+c@ex-ample.co.uk, or x@y.z_w@q.r; 10.0.0.255 and 1.2.3.256 and 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 call +49 (30) 123-4567 now, +1 2",
    "é" * 10 + " a@b.c 中 8.8.8.8",
    "1" * 20_000 + " " + "a" * 20_000 + "@" + "b." * 5_000 + "c",
    "a@b a@b. @c.d 1.2.3 +12345678901234567890 0000000000000000",
    None,
    "",
]


def luhn(s):
    return sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(s))) % 10 == 0


def spans_of(t):
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    t = "" if t is None else t
    if len(t) > 10_000:
        t, kinds = t, [k for k in kinds if k[0] != "email"]  # the plain pattern takes quadratic time on long runs
    return sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0]))


def test_personal_data(spark, empty):
    got = {r.doc_id: r for r in span_digests(table(spark, [(k, t, "en", "a") for k, t in enumerate(PII)])).collect()}
    for k, t in enumerate(PII):
        if t is not None and len(t) > 10_000:
            assert got[k].n_email == 1
            continue
        said = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans_of(t))
        assert got[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[k].spans == said
    assert span_digests(empty).count() == 0


def test_revealing_terms(spark):
    """A name that never stands without its address is removed; a common word is not."""
    rows = [(k, f"Zorblatt wrote from zorb@mail.org about the plan {k}", "en", "a") for k in range(5)] + [(100 + k, f"they wrote about the plan from here {k}", "en", "a") for k in range(60)]
    got = sanitise_spans(table(spark, rows)).where("size(terms) > 0").collect()
    assert sorted(r.id for r in got) == list(range(5))
    assert all([(t.start, t.end, t.action) for t in r.terms] == [(0, 8, "remove")] for r in got)


def test_revealing_terms_anywhere(spark):
    """A name far from its address counts, and is marked wherever it stands, in texts without the address too."""
    far = "and so they wrote about the plan from here " * 5
    rows = [(k, f"Zorblatt: {far}to zorb@mail.org, from ZORBLATT", "en", "a") for k in range(20)] + [(50, f"{far} zorblatt", "en", "a")] + [(100 + k, f"{far} {k}", "en", "a") for k in range(380)]
    got = {r.id: [(t.start, t.end, t.action) for t in r.terms] for r in sanitise_spans(table(spark, rows)).where("size(terms) > 0").collect()}
    end = len(rows[0][1])
    assert got == {k: [(0, 8, "remove"), (end - 8, end, "remove")] for k in range(20)} | {50: [(len(far) + 1, len(far) + 9, "remove")]}


def brute_terms(rows):
    """Term spans of each text by counting in plain Python."""
    low = lambda w: w.lower()
    word = regex.compile(r"\p{L}{3,}")
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    docs = []
    for _, t, *_ in rows:
        t, spans = t or "", spans_of(t)
        names = set()
        for a, _, b, kind in spans:
            m = t[a:b]
            names |= {"email": {f"email:{m.lower()}", f"domain:{m.lower().split('@')[-1]}"}, "ip": {f"ip:{m}", f"network:{'.'.join(m.split('.')[:3])}"}, "card": {f"card:{digits(m)}", f"issuer:{digits(m)[:6]}"}, "phone": {f"phone:{digits(m)}", f"block:{digits(m)[:-4]}"}}[kind]
        free = [(m.start(), m.end(), low(m[0])) for m in word.finditer(t) if not any(a < m.end() and m.start() < b for a, _, b, _ in spans)]
        docs.append((t, names, free, {low(m[0]) for m in word.finditer(t)}))
    n, n_e, n_t, n_te = len(docs), Counter(), Counter(), Counter()
    for _, names, free, every in docs:
        n_e.update(names)
        n_t.update(every)
        n_te.update((w, e) for w in {w for *_, w in free} for e in names)
    action = {}
    for (w, e), c in n_te.items():
        ic = math.log2(n / n_e[e]) if n_e[e] < n else 0
        if c >= 2 and ic and c * ic >= P.EVIDENCE and (d := math.log2(c * n / (n_t[w] * n_e[e])) / ic) >= P.GENERALISE:
            action[w] = "remove" if d >= P.REMOVE or action.get(w) == "remove" else "generalise"
    return Counter(tuple((a, b, action[w]) for a, b, w in free if w in action) for _, _, free, _ in docs)


def test_revealing_terms_against_brute_force(spark):
    rng = random.Random(11)
    words = [a + b for a in "ka lo mi ru te zu".split() for b in "nat sol pim dur vek".split()]
    people = [(f"p{k}.x@m{k % 3}.org", f"Name{'abcdefgh'[k]}", f"10.0.{k}.7") for k in range(8)]
    rows = []
    for k in range(400):
        t = [rng.choice(words) for _ in range(rng.randint(3, 12))]
        if k % 5 == 0:
            mail, name, host = rng.choice(people)
            for x in (mail, name, *([host] if k % 2 else [])):
                t.insert(rng.randrange(len(t) + 1), x)
            if k % 3:
                t.append("Teamred" if mail.endswith("m1.org") else "both")
        rows.append((k, " ".join(t), "en", "a"))
    rows += [(None, rows[5][1], "en", "a"), (5, rows[5][1], "en", "a"), (900, None, None, None), (901, "", None, None)]
    got = Counter(tuple((t.start, t.end, t.action) for t in r.terms) for r in sanitise_spans(table(spark, rows)).collect())
    assert got == brute_terms(rows)
    assert sum(len(k) * n for k, n in got.items()) > 50


def test_many_spans_in_one_text(spark):
    """Thousands of spans and words in one text: positions are right across the blocks of the folds."""
    text = " ".join(f"word{'abcdefgh'[k % 8]} u{k}@m{k}.org" for k in range(1500))
    got = span_digests(table(spark, [(1, text, "en", "a")])).first()
    assert got.spans == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[a-z0-9]+@[a-z0-9.]+", text))


def test_mix_targets():
    assert mix_targets([10, 100, 90], [1, 2, 3]) == pytest.approx([30, 170 * 2 / 5, 170 * 3 / 5])
    assert mix_targets([], [1]) == [] and mix_targets([0, 0], [1, 2]) == [0, 0]


def test_mixing(odd, empty):
    got = mix_sources(odd).collect()
    assert len(got) == len(odd_rows())
    size = {}
    for i, t, _, s in odd_rows():
        size.setdefault(s, 0)
        size[s] += len(re.findall(WORD, t or ""))
    names = sorted(size, key=lambda x: (x is None, x or ""))
    targets = dict(zip(names, mix_targets([size[n] for n in names], [(1, 2, 3)[k % 3] for k in range(len(names))]), strict=True))
    by = Counter()
    for r in got:
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        by[r.source_size] += r.taken
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(size[n], round(targets[n], 6)) for n in names}
    assert sum(by.values()) <= sum(size.values())
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix_sources(odd).collect()))
    assert mix_sources(empty).count() == 0


def brute_mix(spark, rows, weights=(1, 2, 3), most=3):
    """(id, size, taken) by walking the queue; targets by bisection of the level that all sources are filled to."""
    size = [len(re.findall(WORD, t or "")) for _, t, *_ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda x: (x is None, x or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    lo, hi = 0.0, float(3 * sum(size) + 1)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * total[s], mid * weight[s]) for s in sources) < sum(size) else (lo, mid)
    target = {s: min(most * total[s], hi * weight[s]) for s in sources}
    keys = [r.h for r in spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, id long").select("k", F.xxhash64(F.lit(42), "id").alias("h")).orderBy("k").collect()]
    first = lambda k: (keys[k], rows[k][0] is not None, rows[k][0] or 0)
    turns = []
    for no, s in enumerate(sources):
        before = 0
        for k in sorted((k for k, r in enumerate(rows) if r[3] == s and size[k]), key=first):
            turns += [((turn * total[s] + before + size[k]) / target[s], no, first(k), k) for turn in range(most)]
            before += size[k]
    taken, so_far = Counter(), 0
    for *_, k in sorted(turns, key=lambda x: (round(x[0], 9), x[1], x[2])):
        taken[k] += size[k] if so_far + size[k] <= sum(size) else 0
        so_far += size[k]
    return [(r[0], size[k], taken[k]) for k, r in enumerate(rows)]


def test_mixing_queue(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randint(0, 9), "en", rng.choice(("a", "a", "a", "b", "c", "d", None))) for k in range(150)]
    got = sorted((r.doc_id, r["size"], r.taken) for r in mix_sources(table(spark, rows).repartition(3)).collect())
    assert got == sorted(brute_mix(spark, rows))


def test_mixing_nears_targets(spark):
    rng = random.Random(1)
    docs = table(spark, [(k, "w " * rng.randint(1, 30), "en", rng.choice("aaaaab") if k % 10 else "c") for k in range(3000)])
    got = mix_sources(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 90 for r in got)
    mixed = take_mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] == sum(r.taken for r in got)


def test_fold():
    assert fold("Ѕtuріd 1d10t!! m0r0n$$$ x@y 1234ab56 stupid$$$") == ["stupid", "idiot", "moron", "xay", "i", "eaabs", "stupid"]
    assert fold("ｓｔｕｐｉｄ 𝐬𝐭𝐮𝐩𝐢𝐝 s t u p i d i.d.i.o.t a b cd 5h1t 12 15 3") == ["stupid"] * 3 + ["idiot", "a", "b", "cd", "shit"]
    assert fold("") == fold("\u200b 12 !?") == []


_FOLDED = st.lists(st.sampled_from("ab abc abcd abcde bc xabc cd trash can".split()), max_size=12)


@settings(max_examples=300, deadline=None)
@given(_FOLDED, st.dictionaries(st.sampled_from(["ab ", "abc ", "abc", "abcd", "bc ", "x", "can "]), st.floats(0.1, 5), max_size=5), st.sets(st.sampled_from(["trash can", "ab abc", "bc cd"])))
def test_lexicon_against_brute_force(words, weights, exceptions):
    """The automaton finds what asking every word for every entry finds."""
    want = []
    for k, w in enumerate(words):
        spared = any(k + d >= 0 and " ".join(words[k + d : k + d + 2]) == p for p in exceptions for d in (-1, 0) if k + d + 2 <= len(words))
        fit = [x for t, x in weights.items() if (w == t[:-1] if t.endswith(" ") else w.startswith(t))]
        if fit and not spared:
            want.append(max(fit))
    total, per_word = Lexicon(weights, sorted(exceptions)).features(" ".join(words))
    single = any(len(w) == 1 for w in words)
    assert single or (math.isclose(total, math.log1p(math.fsum(want))) and math.isclose(per_word, math.fsum(want) / math.sqrt(len(words) or 1)))


def test_entries_count_alike_in_any_sample():
    """The same shares in a sample ten times as large: nothing that was an entry is none any more."""
    few = choose_entries({"bad ": 9, "word ": 10}, {"word ": 20}, 20, 40)
    many = choose_entries({"bad ": 90, "word ": 100}, {"word ": 200}, 200, 400)
    assert set(few) == set(many) == {"bad "}
    assert choose_exceptions({"a b": 1, "c d": 9}, {"a b": 3, "c d": 3, "e f": 2}, 10, 10) == ["a b"]


def test_toxicity(spark, empty):
    rng = random.Random(5)
    words = [a + b for a in "ka lo mi ru te".split() for b in "na so pi du ve".split()]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        t = ["trash", "grumfle"] if k % 9 == 1 and not toxic else []
        t += [rng.choice(words) for _ in range(rng.randint(10, 60))]
        for _ in range(3 * toxic):
            t.insert(rng.randrange(len(t)), rng.choice(("idiot", "1diot", "grumfle", "grumfled")))
        rows.append((k, " ".join(t), "en", "a"))
        labels.append((k, int(toxic)))
    docs = table(spark, [*rows, (None, None, None, None), (9000, "", None, None)])
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = learn_toxicity(docs, marks, crc_mod("doc_id", 3) != 1)
    got = score_toxicity(docs, model).collect()
    truth = dict(labels)
    assert "trash grumfle" in model["exceptions"]
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert score_toxicity(empty, model).count() == 0
    for none in (marks.where("toxic = 0"), marks.where("toxic = 1"), marks.limit(0), marks.withColumn("doc_id", F.col("doc_id") + 100_000)):
        clean = learn_toxicity(docs, none, F.lit(True))
        assert clean["weights"] == {} and {r.predicted for r in score_toxicity(docs, clean).collect()} == {0}
    assert learn_toxicity(empty, marks, F.lit(True))["weights"] == {}


def brute_components(rows, width, num, den):
    sets = [(i, frozenset(tuple(w[k : k + min(width, len(w))]) for k in range(len(w) - min(width, len(w)) + 1)) if (w := (t or "").encode().lower().split()) else frozenset()) for i, t, *_ in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if group[j] == group[k] and sets[j][0] is not None]
        out.append((i, len(s), min(ids) if ids and s else i))
    return Counter(out)


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_near_duplicates(spark, odd, empty, width, num, den):
    rng = random.Random(7)
    rows = odd_rows()
    words = [f"w{k}" for k in range(400)]
    for g in range(6):  # groups whose members drift apart, so that not all are similar to all
        base = [rng.choice(words) for _ in range(rng.choice((12, 40, 120)))]
        for k in range(14):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 20))):
                t[rng.randrange(len(t))] = rng.choice((*words, f"u{g}{k}"))
            rows.append((1000 + 100 * g + k, " ".join(t), "en", "a"))
    got = near_duplicates(table(spark, rows).repartition(4), width=width, similarity=(num, den)).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, width, num, den)
    assert near_duplicates(empty, width=width).count() == 0
    left = keep_one_of_each(odd, width=width, similarity=(num, den))
    assert left.columns == odd.columns and 0 < left.count() <= len(odd_rows())


def test_prefix_is_never_too_short():
    import numpy as np

    for n in (1, 2, 9, 10, 11, 57, 500):
        p = N.choose_prefix(np.full(n, 200), 0.0, 9, 10)
        assert n - N.least_overlap(n, 9, 10) + 1 <= p <= n
        assert N._index_prefix(np.array([n]), np.array([p]), 9, 10)[0] >= 1


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 120), (120, 110), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 110: 100, 120: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pieces(odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((i, len(ids := sp.encode(t or "", add_eos=True)), sha(" ".join(map(str, ids))), sha(sp.decode(ids))) for i, t, *_ in odd_rows())
    assert Counter(map(tuple, encode_digests(odd, piece_model()).collect())) == want
    assert encode_digests(empty, piece_model()).count() == 0
    back = {r.doc_id: r.text for r in decode(encode(odd, piece_model()), piece_model()).collect()}
    assert all(back[i] == sp.decode(sp.encode(t or "")) for i, t, *_ in odd_rows() if i not in (None, 4))


_TEXT = st.one_of(st.text(st.sampled_from(list("ab  ▁▁\n\t\x00\x01\x7fé中😀\u3000\xa0ﬁ\ufffd")), max_size=30), st.text(max_size=60))


@settings(max_examples=400, deadline=None)
@given(st.lists(_TEXT, max_size=6))
def test_pieces_any_text(texts):
    """Ids and decoded text as the library's, with unknown and control characters and a table that ages all the time."""
    from evidentia.llm.pieces import Pieces

    p = test_pieces_any_text.__dict__.setdefault("p", Pieces(piece_model(), table_rows=5, block_chars=10))
    for (said, back), text in zip(p.encode(texts), texts, strict=True):
        ids = p.sp.encode(text, add_eos=True)
        assert said == " ".join(map(str, ids)) and back == p.sp.decode(ids)
        assert len(p.young) <= 5 + len(set(p.chunks(text))) + 20


def test_quality(spark, odd, empty):
    rows = [*odd_rows(), (500, "a b c d e f g h " * 4 + "tail " * 3, "en", "a"), (501, "line one two\nline one two\n\n \nline one two", "en", "a"), (502, " ".join(f"w{k}" for k in range(50)) + " # $ %", "en", "a")]
    got = quality(table(spark, rows)).collect()
    want = Counter()
    for i, t, *_ in rows:
        w = re.findall(WORD, t or "")
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = len({j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)})
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w))] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert quality(empty).count() == 0


def test_quality_verdict(spark):
    """``kept`` against the rules written out in Python."""
    rng = random.Random(8)
    words = [f"word{k}" for k in range(90)] + ["CAPS", "LOUD", "x", "!!", "#", "averyverylongwordindeedtoolong", "12345", "a\nb"]
    rows = []
    for k in range(150):
        some = rng.sample(words, rng.randint(1, 8)) if k % 2 else words
        rows.append((k, " ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) + "\nsame line\nsame line" * (k % 3), "en", "a"))

    def kept(t):
        w, lines = re.findall(WORD, t), t.split("\n")
        n, chars, letters = len(w), sum(map(len, w)), len(regex.findall(r"\p{L}", t))
        said = [x for x in lines if re.search(WORD, x)]
        c = Counter(tuple(w[k : k + 8]) for k in range(n - 7))
        rep = len({j for k in range(n - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)})
        fails = [n < 20, 100 * rep > 30 * n, len(re.findall(r"[#*$%&|<>]", t)) > 0.3 * n, not 2 * n <= chars <= 15 * n, len(said) - len(set(said)) > 0.3 * len(lines), len(regex.findall(r"\p{Lu}", t)) > 0.5 * letters, t.count("!") > 0.3 * n, letters < 0.5 * chars, len(set(w)) < 0.1 * n]
        return not any(fails)

    got = {r.doc_id: r.kept for r in quality(table(spark, rows)).collect()}
    assert got == {k: kept(t) for k, t, *_ in rows} and 5 < sum(got.values()) < 145


def test_cascade_order_keeps_the_verdict(odd):
    rules = [Rule("slow", F.sha2(F.col("text"), 512) == "x"), Rule("short", F.col("n_words") < 30)]
    assert {r.name for r in order_rules(odd, rules)} == {"slow", "short"}
    a, b = (Counter((r.doc_id, r.kept) for r in quality(odd, x).collect()) for x in (rules, rules[::-1]))
    assert a == b


def test_language(spark, empty):
    rng = random.Random(2)
    parts = {"en": "th er in on re an".split(), "de": "sch ung ei ch zu".split(), "fr": "eau oi qu ai ment".split()}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang, "a") for k, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = table(spark, [*rows, (900, None, "en", "a"), (901, "12 !?", "en", "a"), (902, "", None, "a"), (None, rows[0][1], None, "a")])
    profiles = language_profiles(docs, crc_mod("doc_id", 4) != 2)
    got = {r.doc_id: r for r in identify_language(docs, profiles).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows) >= 0.99 * len(rows)
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    left = with_language(docs, profiles)
    assert left.columns == docs.columns and left.count() == len(rows) + 1
    assert language_profiles(empty, F.lit(True)) == {} and identify_language(empty, profiles).count() == 0
    assert {r.lang_pred for r in identify_language(docs, {}).collect()} == {"und"}


def brute_language(text, profiles, ranks=300):
    """Nearest profile by out-of-place distance, over dictionaries of n-grams."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    grams = Counter(c for w in words for c in w)
    grams.update(f" {w} "[k : k + n] for w in words for n in (2, 3) for k in range(len(w) + 3 - n))
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
    own = sorted(map(code, grams), key=lambda c: (-count[c], c)) if (count := {code(g): n for g, n in grams.items()}) else []
    place = {lang: {c: k for k, c in enumerate(p)} for lang, p in profiles.items()}
    return {lang: sum(abs(place[lang][c] - k) if c in place[lang] else ranks for k, c in enumerate(own[:ranks])) for lang in profiles} if own else {}


def test_language_distance(spark):
    rng = random.Random(9)
    letters = {"en": "etaoin shrdlu", "de": "enisr atdhul", "es": "eaosr nidlct"}
    rows = [(k, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 300))), lang, "a") for k, lang in enumerate(["en", "de", "es"] * 30)] + [(200, "Ünïcödé ßtraße 12 x_y", "de", "a"), (201, "a", "en", "a"), (202, "", None, "a")]
    docs = table(spark, rows)
    profiles = language_profiles(docs, F.lit(True))
    got = {r.doc_id: r for r in identify_language(docs, profiles).collect()}
    for i, text, *_ in rows:
        far = sorted((d, lang) for lang, d in brute_language(text, profiles).items())
        assert got[i].lang_pred == (far[0][1] if far else "und")
        assert math.isclose(got[i].score, (far[1][0] - far[0][0]) / far[1][0] if far and far[1][0] else 0.0)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>";</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First
 part<br><p>Second&nbsp;part &lt;b&gt; a < b</p><form><p>Sign up</p></form><aside>More</aside><p>End</article>
<section id="comments"><p>Nice article, thanks for all the words that are in it, truly many words to read here.</p></section><footer>&copy; x</footer></body></html>"""


def test_html():
    assert main_text(PAGE) == "Head & line First part Second part <b> a < b End"
    assert main_text(None) == "" and main_text("") == "" and main_text("<nav>only</nav>") == ""
    long = "word " * 40
    assert main_text(f"<div><a href=x>{long}</a></div><div><p>{long}</p><p>{long}</p></div><div>short</div>").split() == long.split() * 2
    assert main_text("<article><p>cut off &am") == "cut off &am"


PROSE = "Words of a paragraph that is long enough to be main text by its length alone, so there."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><h1>Head</h1></div><div>{PROSE}</div><div><h2>Middle</h2></div><div>Tiny</div><div>{PROSE}</div><div><p>End</p></div>", f"Head {PROSE} Middle Tiny {PROSE} End"),
        ("<div><h1>Short</h1></div><div><p>A short note.</p></div>", "Short A short note."),
        (f"<div><h2><a href=x>Title</a></h2></div><div><p>{PROSE}</p></div><div><a href=y>More</a></div>", f"Title {PROSE}"),
        (f"<div class='has-sidebar no-nav with-header'><p>{PROSE}</p><div class='left-sidebar'>Side</div></div>", PROSE),
        (f"<div class=sidebar><article><p>{PROSE}</article></div>", PROSE),
        (f"<form><main><p>{PROSE}</main></form>", PROSE),
        (f"<div data-class=nav title='class=nav'><p>{PROSE}</div>", PROSE),
        (f"<article><div class=entry-header><h1>Head</h1></div><p>{PROSE}</article>", f"Head {PROSE}"),
        (f"<div class=search-results><p>{PROSE}</p><h2>Two</h2><p>{PROSE}</p></div>", f"{PROSE} Two {PROSE}"),
        (f"<article><h1 class=page-header>Head</h1><div class=page-header><p>Line</p></div><p>{PROSE}</article>", f"Head Line {PROSE}"),
        (f"<div class=page-header>Site</div><h1 class=page-header>Head</h1><p>{PROSE}</p>", f"Head {PROSE}"),
        (f"<article>x x x</article><div><p>{PROSE}</p><p>{PROSE}</p></div>", f"x x x {PROSE} {PROSE}"),
        ("<body><h1>Hi</h1><p>Short.</p></body>", "Hi Short."),
        (f"<div><p class=ad>Buy<p>{PROSE}<ul><li class=share>Share<li>One</ul></div>", f"{PROSE} One"),
    ],
)
def test_html_plain_pages(page, text):
    assert main_text(page) == text


def test_html_article_is_a_weight():
    """Line blocks pick the text on pages with an article too: a block beside it is judged by its sums."""
    assert main_text(f"<article><p>Text</article><div>Foot</div><div><p>{PROSE}</p></div><div><p>Small.</p></div>") == f"Text {PROSE}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=25))
def test_line_blocks_against_brute_force(weights):
    n = len(weights)
    sums = [sum(weights[j] for j in range(k, min(n, k + H.WINDOW))) for k in range(n)]
    assert H.window_sums(weights) == sums
    peak, surge, dive = H.surge_and_dive(weights)
    assert peak == min(H.PEAK, max(sums, default=0))
    if peak:
        assert all(x < peak for x in sums[:surge]) and sums[surge] >= peak
        last = max(k for k in range(n) if sums[k] >= peak)
        assert last <= dive < last + H.WINDOW and sum(weights[last : dive + 1]) >= peak > sum(weights[last:dive])
    else:
        assert surge > dive


def test_surge_and_dive_pick_the_text(monkeypatch):
    """Without surge and dive, bare text before and after the main text stays; the window of the surge counts whole."""
    page = f"<div>Home</div><div>By</div><div>{PROSE}</div><div>Bare words inside</div><div>{PROSE}</div><div>Terms</div><div>Contact</div>"
    assert main_text(page) == f"By {PROSE} Bare words inside {PROSE}"
    monkeypatch.setattr(H, "surge_and_dive", lambda weights: (0, 0, len(weights)))
    assert main_text(page) == f"Home By {PROSE} Bare words inside {PROSE} Terms Contact"


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == sorted([(1, 48), (0, 0), (1, 48)])
    assert extract_text(pages.limit(0)).count() == 0


def test_packing():
    import numpy as np

    for x in ([], [0], [1, 2, 3], [255, 256], [1 << 31, 1 << 40]):
        a = np.array(x, np.int64)
        assert unpack(pack(a)).tolist() == x and unpack(pack(np.sort(a), True)).tolist() == sorted(x)
    assert unpack(pack(np.array([0.5, -1.25]))).tolist() == [0.5, -1.25]
    assert len(shingle_set("a b", 3)) == 1 and len(shingle_set("", 3)) == 0
