"""Information-theoretic sanitisation of personal data, in built-in functions only.

Protected entities are the addresses and numbers that four patterns find, and what
they belong to: an address' domain, a host's network, a card's issuer, a phone
number's block.  Terms (words of letters) in a text with an entity may reveal it as
well.  How strongly one does is estimated from the whole corpus:

    disclosure(t, e) = PMI(t; e) / IC(e),   PMI = log2(n(t, e) N / (n(t) n(e))),   IC = log2(N / n(e))

with n counting documents: t with e, t anywhere, e anywhere.  It is 1 when t never
occurs without e.  Terms that reach REMOVE are removed, those that reach GENERALISE
are replaced by a general word, wherever they stand, if they are seen with the entity
in SUPPORT documents at least and n(t, e) IC(e) reaches EVIDENCE bits: a word that
has nothing to do with an entity stands in k documents, all with the entity, with a
chance of 2^-(k IC(e)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole

GENERALISE, REMOVE, SUPPORT, EVIDENCE = 0.80, 0.95, 2, 16.0
#: Terms too frequent to reveal anything that are left out of the counting at once; the rest of them fail later.
FREQUENT = 500
KINDS = ("email", "ip", "card", "phone", "term")

# Possessive quantifiers keep Java's matcher from recursing over long runs.  The look-behinds start a
# match only where a run of its first characters starts: a later start in a run that fails fails too.
_RUN = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_RUN})|\G){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
_NEEDS = {"email": "contains(text, '@')", "ip": "digits", "card": "digits", "phone": "contains(text, '+')"}
_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and (length(ltrim('0', p)) < 3 or int(p) <= 255))",
    "card": f"length({_DIGITS}) between 12 and 19 and aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + int(substring(reverse({_DIGITS}), i, 1)) * (2 - i % 2) - if(i % 2 = 0 and int(substring(reverse({_DIGITS}), i, 1)) > 4, 9, 0)) % 10 = 0",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
#: What makes two spans one entity, and what that belongs to.
_ENTITY = {"email": "lower(x.value)", "ip": "x.value", "card": _DIGITS, "phone": _DIGITS}
_GROUP = {
    "email": "concat('domain:', lower(substring_index(x.value, '@', -1)))",
    "ip": "concat('network:', substring_index(x.value, '.', 3))",
    "card": f"concat('issuer:', left({_DIGITS}, 6))",
    "phone": f"concat('block:', left({_DIGITS}, length({_DIGITS}) - 4))",
}


#: Elements of an array that are folded one by one; longer arrays are folded in blocks of so many.
_BLOCK = 64
_INTS = "cast(array() as array<int>)"


def _folded(xs: str, step: str) -> str:
    """SQL for the fold, from 0, of what stands before each element of an array of ints; ``step`` says how, of {a} and x.

    An append copies its array, so the folds of blocks are appended first and then those within each block.
    """
    running = f"aggregate(%s, named_struct('at', %s, 's', {_INTS}), (z, x) -> named_struct('at', {step.format(a='z.at')}, 's', array_append(z.s, z.at))).s"
    totals = f"transform(blocks, b -> aggregate(b, 0, (z, x) -> {step.format(a='z')}))"
    blocks = f"transform(sequence(0, greatest(size(v) - 1, 0) div {_BLOCK}), k -> slice(v, k * {_BLOCK} + 1, {_BLOCK}))"
    return f"element_at(transform(array({xs}), v -> element_at(transform(array({blocks}), blocks -> flatten(zip_with(blocks, {running % (totals, 0)}, (b, first) -> {running % ('b', 'first')}))), 1)), 1)"


def _located(text: str, pattern: str) -> str:
    """SQL for all matches of SQL's pattern in a text, as array<struct<start, end, value>> in code points.

    A split at the same pattern gives what lies between the matches, and so where each begins.
    """
    return (
        f"element_at(transform(array(named_struct('p', split({text}, {pattern}, -1), 'h', regexp_extract_all({text}, {pattern}, 0))), m -> zip_with(m.h, "
        f"zip_with({_folded('zip_with(slice(m.p, 1, size(m.h)), m.h, (p, h) -> length(p) + length(h))', '{a} + x')}, slice(m.p, 1, size(m.h)), (at, p) -> at + length(p)), "
        "(h, at) -> named_struct('start', at, 'end', at + length(h), 'value', h))), 1)"
    )


def _apart(found: str, spans: str) -> str:
    """SQL for those of found (start, end, value) that no span overlaps: in order of their ends, those beyond whose start no earlier span reaches."""
    events = (
        f"sort_array(concat(transform({spans}, o -> named_struct('pos', o.start, 'no', 1, 'reach', o.end, 'start', 0, 'end', 0, 'value', '')), "
        f"transform({found}, o -> named_struct('pos', o.end, 'no', 0, 'reach', 0, 'start', o.start, 'end', o.end, 'value', o.value))))"
    )
    reach = _folded("transform(events, e -> e.reach)", "greatest({a}, x)")
    return (
        f"element_at(transform(array({events}), events -> transform(filter(zip_with(events, {reach}, (e, most) -> named_struct('e', e, 'most', most)), o -> o.e.no = 0 and o.most <= o.e.start), "
        "o -> named_struct('start', o.e.start, 'end', o.e.end, 'value', o.e.value))), 1)"
    )


_SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,entity:string,belongs:string>>"
_TERM = r"\p{L}{3,}+"


def _quoted(pattern: str) -> str:
    return f"r'{pattern}'"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, text, spans (by start, then kind, as array of structs)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text")).withColumn("row", F.monotonically_increasing_id())
    flagged = rows.withColumn("digits", F.expr("text rlike '[0-9]'"))
    for no, kind in enumerate(KINDS[:4]):
        made = f"transform(filter({_located('text', _quoted(PATTERNS[kind]))}, x -> {_VALID[kind]}), x -> named_struct('start', x.start, 'kind_no', {no}, 'end', x.end, 'kind', '{kind}', 'entity', concat('{kind}:', {_ENTITY[kind]}), 'belongs', {_GROUP[kind]}))"
        flagged = flagged.withColumn(kind, F.expr(f"case when {_NEEDS[kind]} then {made} else cast(array() as {_SPANS}) end"))
    return flagged.select("row", "id", "text", F.sort_array(F.concat(*KINDS[:4])).alias("spans"))


def _words(text: str) -> str:
    """SQL for the words of a text as they stand, each once."""
    return f"array_distinct(regexp_extract_all({text}, {_quoted(_TERM)}, 0))"


def _terms(text: str) -> str:
    return f"array_distinct(transform({_words(text)}, x -> lower(x)))"


def _revealing(found: DataFrame, total: int) -> DataFrame:
    """term, action (the stronger one, if it reveals several entities).

    A term of disclosure d with an entity is in n(e)^d N^(1 - d) texts at most, so
    only entities of SUPPORT texts and terms below that bound are counted together.
    """
    information = F.log2(F.lit(float(total)) / F.col("n_e"))
    in_text = found.select("row", F.explode(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.array(s["entity"], s["belongs"]))))).alias("entity"))
    entities = stored(in_text.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= SUPPORT) & (F.col("n_e") < total) & (F.col("n_e") * information >= EVIDENCE)), "personal-entities").df
    # Counted within each task first, so what is shuffled is one row for each term and task.
    terms = stored(found.select(F.explode(F.expr(_terms("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= SUPPORT), "personal-terms").df
    bound = (entities.agg(F.max("n_e")).first()[0] or 0) ** GENERALISE * total ** (1 - GENERALISE) * (1 + 1e-9)
    frequent = [r.term for r in terms.where(F.col("n_t") > bound).orderBy(F.desc("n_t"), "term").limit(FREQUENT).collect()]
    held = in_text.join(entities, "entity").groupBy("row").agg(F.collect_list("entity").alias("entities"))
    outside = f"transform({_apart(_located('text', _quoted(_TERM)), 'spans')}, w -> lower(w.value))"
    words = F.array_except(F.expr(f"array_distinct({outside})"), F.lit(frequent).cast("array<string>"))
    # Written before they are taken apart: a filter that Spark derives from an explode would compute the words of a text again.
    told = stored(found.join(held, "row").select("entities", words.alias("words")), "personal-words").df
    pairs = told.select(F.explode("entities").alias("entity"), "words").select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= SUPPORT)
    disclosure = F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e"))) / information
    scored = pairs.join(entities, "entity").where(F.col("n_te") * information >= EVIDENCE).join(terms.where(F.col("n_t") <= bound), "term").withColumn("disclosure", disclosure).where(F.col("disclosure") >= GENERALISE)
    return scored.groupBy("term").agg(F.max(F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")).alias("action"))


def sanitise_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row, id, base (spans of the patterns), terms (array of start, end, action).

    A null text counts as empty.  Null ids and repeated rows are rows of their
    own; other columns are ignored.  An empty table gives an empty result.
    """
    found = stored(find_spans(docs, id_col, text_col), "personal-data").df
    revealing = stored(_revealing(found, found.count()), "personal-revealing").df
    seen = found.select("row", F.explode(F.expr(_terms("text"))).alias("term")).join(revealing, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("revealing"))
    # All forms of the revealing terms of a text, as one pattern for whole words.
    words = f"filter({_words('text')}, x -> map_contains_key(revealing, lower(x)))"
    marked = f"transform({_apart(_located('text', 'pattern'), 'spans')}, w -> named_struct('start', w.start, 'end', w.end, 'action', revealing[lower(w.value)]))"
    none = "cast(array() as array<struct<start:int,end:int,action:string>>)"
    joined = found.join(seen, "row", "left").withColumn("pattern", F.expr(f"concat(r'(?<!\\p{{L}})(?:', array_join({words}, '|'), r')(?!\\p{{L}})')"))
    return joined.select("row", "id", F.col("spans").alias("base"), F.expr(f"case when revealing is null then {none} else {marked} end").alias("terms"))


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    short = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind")))
    added = F.transform(F.array_distinct(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind_no"), s["end"].alias("end"), F.lit("term").alias("kind")))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}") for k in KINDS[:4]]
    return sanitise_spans(docs, id_col, text_col).select(F.col("id").alias(id_col), *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.sort_array(F.concat(short, added))).alias("spans"))
