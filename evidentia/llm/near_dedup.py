"""N-gram Jaccard join with adaptive multi-match prefixes, and its groups.

Documents with equal shingle sets are one class.  All shingles have one global
order, rare ones first by a sketch of counts over all documents.  Of a class
with n shingles that must share at least o with any similar one, the first
n - o + l shingles are its prefix: similar classes share l shingles of their
prefixes, and more where their sizes ask for it (see ``shared_needed``).  Each
class takes the l with the least estimated cost: longer prefixes make longer
candidate lists but ask for more shared shingles before a verification.

Which classes hang together is wanted, not every link, so no group's pairs are
all emitted.  First each class is verified against the one class that leads
most of its lists (a star).  Then lists give only pairs of classes that are
still apart, each with enough shared prefix shingles; all of these are verified
in full.  The result is exact: every link between classes that the star left
apart is found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored, stored, whole
from .components import components
from .shingles import set_id, shingle_set

#: Counters of the sketch: a quarter of the shingles, within these powers of two (one byte each when sent to the executors).
SKETCH_BITS = (16, 26)
_SLICES = 64
#: What verifying a candidate costs, in units of one entry of a candidate list.
VERIFY_COST = 64.0
#: Multi-match lengths to choose from, as far as they are at most a tenth of the set.
LENGTHS = (1, 2, 4, 8, 16, 32, 64)
_BLOOM_BITS = 27


def least_overlap(n: int, num: int, den: int) -> int:
    """Shingles that a set of n must share with any set of similarity num/den or more."""
    return -(-num * n // den)


def shared_needed(na: Column, nb: Column, pa_: Column, pb: Column, num: int, den: int) -> Column:
    """Shared prefix shingles without which two sets can't be similar.

    They must share ceil(num (na + nb) / (num + den)).  Of the set whose counted prefix ends first in the
    global order, at most n - p shared shingles lie beyond its prefix; all others are in both prefixes.
    """
    need = F.floor((num * (na + nb) + (num + den - 1)) / (num + den))
    return F.greatest(F.lit(1), need - F.greatest(na - pa_, nb - pb))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids = [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                sizes.append(len(s))
                ids.append(set_id(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], names=["id", "n", "cls"])

    return run


def _sketch(width: int, bits: int):
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            found = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            if found and sum(map(len, found)):
                at, n = np.unique(np.concatenate(found) >> shift, return_counts=True)
                at = at.astype(np.int64)
                counts[at] = np.minimum(counts[at].astype(np.int64) + n, 255)
        for k, part in enumerate(np.split(counts, _SLICES)):
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    return run


def _add_slices(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(blob, size), np.uint8)
                total[k] = np.minimum(total[k] + part, 255) if k in total else part.astype(np.uint16)
        for k, x in total.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zstandard.compress(x.astype(np.uint8).tobytes(), 3)], pa.binary())], names=["slice", "counts"])

    return run


def shingle_counts(texts: DataFrame, width: int, n_shingles: int) -> np.ndarray:
    """A sketch of how many documents have a shingle: one counter, up to 255, for all shingles with the same leading bits."""
    bits = min(max(int(n_shingles // 4).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    size = (1 << bits) // _SLICES
    parts = texts.mapInArrow(_sketch(width, bits), "slice int, counts binary").repartition(_SLICES, "slice").mapInArrow(_add_slices(size), "slice int, counts binary")
    counts = np.zeros(1 << bits, np.uint8)
    for r in parts.collect():  # bounded by SKETCH_BITS
        counts[r.slice * size : (r.slice + 1) * size] = np.frombuffer(zstandard.decompress(bytes(r.counts), size), np.uint8)
    return counts


def choose_prefix(counts: np.ndarray, noise: float, num: int, den: int) -> int:
    """How many of a set's shingles, in global order with the given counts, its prefix has."""
    n = len(counts)
    base = n - least_overlap(n, num, den)
    lengths = [m for m in LENGTHS if m == 1 or m <= n // 10]
    others = np.cumsum(np.maximum(counts[: base + lengths[-1]].astype(float) - 1 - noise, 0))
    entries = np.array([others[min(base + m, n) - 1] for m in lengths])
    # A candidate takes up as many entries as shingles it must share.
    cost = entries + VERIFY_COST * entries / np.array(lengths)
    return min(base + lengths[int(np.argmin(cost))], n)


def _prefixes(width: int, sketch, num: int, den: int, noise: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = np.frombuffer(zstandard.decompress(sketch.value), np.uint8)
        shift = np.uint64(64 - (len(counts_of).bit_length() - 1))
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width)
                if not len(s) or (cls := set_id(s)) in seen:
                    continue
                seen.add(cls)
                counts = counts_of[(s >> shift).astype(np.int64)]
                order = np.lexsort((s, counts))
                p = choose_prefix(counts[order], noise, num, den)
                rows.append((s[order[:p]].view(np.int64), cls, doc, len(s), p))
            if rows:
                n = [len(r[0]) for r in rows]
                long = lambda k: pa.array(np.repeat(np.array([-1 if r[k] is None else r[k] for r in rows], np.int64), n))  # noqa: E731, B023
                yield pa.record_batch([pa.array(np.concatenate([r[0] for r in rows])), long(1), long(2), long(3), long(4), pa.array(np.concatenate([np.arange(k) for k in n]))], names=_LIST)

    return run


#: A shingle of a class's prefix: the class, one of its documents, its size, its prefix's length, and the shingle's place in the prefix.
_LIST = ["shingle", "cls", "doc", "n", "p", "pos"]


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Batches sorted by shingle, cut so that no list is split."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if rest is not None:
            now = {c: np.concatenate([rest[c], x]) for c, x in now.items()}
        key = now["shingle"]
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield {c: x[:cut] for c, x in now.items()}
        rest = {c: x[cut:] for c, x in now.items()}
    if rest is not None and len(rest["shingle"]):
        yield rest


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists without the classes that come from several tasks twice, and only those of two classes or more; lead is the list's first class by document."""
    for x in _whole_lists(batches):
        new = np.r_[True, (x["shingle"][1:] != x["shingle"][:-1]) | (x["cls"][1:] != x["cls"][:-1])]
        x = {c: v[new] for c, v in x.items()}
        starts = np.flatnonzero(np.r_[True, x["shingle"][1:] != x["shingle"][:-1]])
        sizes = np.diff(np.r_[starts, len(x["shingle"])])
        keep = np.repeat(sizes > 1, sizes)
        if not keep.any():
            continue
        no = np.repeat(np.arange(len(starts)), sizes)
        order = np.lexsort((x["cls"], x["doc"], no))
        lead = order[starts]
        columns = {c: v[keep] for c, v in x.items()}
        for c, of in (("lead", "cls"), ("lead_doc", "doc"), ("lead_n", "n"), ("lead_p", "p")):
            columns[c] = x[of][lead][no][keep]
        yield pa.record_batch([pa.array(v) for v in columns.values()], names=list(columns))


def _index_prefix(n, p, num: int, den: int):
    """How much of its prefix the smaller set of a pair needs: with a set of its own size or more it must share 2 num n / (num + den)."""
    multi = p - (n - -(-num * n // den))
    return np.minimum(p, n - -(-2 * num * n // (num + den)) + multi)


def _apart(num: int, den: int, block: int = 512):
    """Pairs of classes of one list that are in different components and can be similar by their sizes and the shingle's places.

    The smaller class (of equals, the one with the smaller number) meets others by its index prefix only.
    ``before`` counts the shingles of the prefix before this one that any other class's prefix has.  No other
    one can be common to both sets, so there is room for min(before, before) common ones in front and
    for as many behind as the shorter rest has; where that is too little the sets are not similar.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_lists(batches):
            starts = np.flatnonzero(np.r_[True, x["shingle"][1:] != x["shingle"][:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(x["shingle"])], strict=True):
                comp, n = x["comp"][s:e], x["n"][s:e]
                if (comp == comp[0]).all():
                    continue
                # By size: only the next few are small enough.
                order = np.lexsort((x["cls"][s:e], n))
                comp, n, cls, p, pos, before = (x[c][s:e][order] for c in ("comp", "n", "cls", "p", "pos", "before"))
                k = _index_prefix(n, p, num, den)
                upto = np.searchsorted(n, n * den // num, side="right")
                small = np.flatnonzero(pos < k)
                for i in range(0, len(small), block):
                    one = small[i : i + block]
                    top = int(upto[one].max())
                    other = np.arange(one[0], top)
                    n1, n2, p1, p2 = n[one, None], n[None, other], pos[one, None], pos[None, other]
                    room = np.minimum(before[one, None], before[None, other]) + np.minimum(n1 - p1, n2 - p2)
                    meets = (comp[one, None] != comp[None, other]) & (other[None, :] > one[:, None]) & (other[None, :] < upto[one, None]) & (room * (num + den) >= num * (n1 + n2))
                    left, right = np.nonzero(meets)
                    if len(left):
                        left, right = one[left], other[right]
                        yield pa.record_batch([pa.array(v) for v in (cls[left], cls[right], n[left], n[right], k[left], p[right])], names=["a", "b", "na", "nb", "pa", "pb"])

    return run


def _bloom(classes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (_BLOOM_BITS - 3), np.uint8)
    any_ = False
    for batch in classes:
        x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        any_ |= len(x) > 0
        for at in _bloom_at(x):
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    if any_:
        yield pa.record_batch([pa.array([zstandard.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])


def _bloom_at(x: np.ndarray) -> list[np.ndarray]:
    return [((x * np.uint64(m)) >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _sets_of(width: int, bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zstandard.decompress(bloom.value), np.uint8)
        seen: set[int] = set()
        for batch in batches:
            found, sets = [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                if not len(s) or (cls := set_id(s)) in seen:
                    continue
                if all(bits[int(at[0]) >> 3] >> (int(at[0]) & 7) & 1 for at in _bloom_at(np.array([cls], np.uint64))):
                    seen.add(cls)
                    found.append(cls)
                    sets.append(s.tobytes())
            yield pa.record_batch([pa.array(found, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _links(texts: DataFrame, pairs: DataFrame, width: int, num: int, den: int, label: str) -> DataFrame:
    """Those of the pairs (a, b) that are similar, by their whole sets."""
    spark = texts.sparkSession
    held = stored(pairs.select("a", "b"), f"{label}-pairs")
    wanted = held.df.select(F.col("a").alias("cls")).distinct().union(held.df.select(F.col("b").alias("cls")).distinct()).distinct()
    bits = np.zeros(1 << (_BLOOM_BITS - 3), np.uint8)
    # A Bloom filter has a fixed size, however many classes there are; what it lets through too much, the joins drop.
    for r in wanted.coalesce(4).mapInArrow(_bloom, "bits binary").collect():
        bits |= np.frombuffer(zstandard.decompress(bytes(r.bits)), np.uint8)
    if not bits.any():
        return held.df
    bloom = spark.sparkContext.broadcast(zstandard.compress(bits.tobytes(), 1))
    sets = stored(texts.mapInArrow(_sets_of(width, bloom), "cls long, shingles binary").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), f"{label}-sets").df
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    joined = held.df.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stored(joined.mapInArrow(_verify(num, den), "a long, b long"), f"{label}-links").df


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Texts are similar when the Jaccard similarity of their sets of shingles of
    ``width`` words is at least ``similarity`` (a fraction); component_id is
    the smallest id reachable over similar texts, nulls last.  A text without
    words (null, empty or blank) has no shingles and is linked with nothing: its
    component is its own id.  Repeated rows are rows of their own in one
    component.  An empty table gives an empty result.
    """
    num, den = similarity
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    members: Stored = stored(texts.mapInArrow(_members(width), "id long, n long, cls long"), "shingle-members")
    total = members.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return members.df.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    counts = shingle_counts(texts, width, total)
    noise = total / len(counts)
    sketch = spark.sparkContext.broadcast(zstandard.compress(counts.tobytes(), 1))
    schema = ", ".join(f"{c} long" for c in _LIST)
    entries = texts.mapInArrow(_prefixes(width, sketch, num, den, noise), schema)
    leads = ("lead", "lead_doc", "lead_n", "lead_p")
    lists: Stored = stored(
        entries.repartition("shingle").sortWithinPartitions("shingle", "cls", "doc").mapInArrow(_shared, f"{schema}, {', '.join(f'{c} long' for c in leads)}"),
        "prefix-lists",
    )

    # The star: each class and the class that leads most of its lists, if that is often enough for two similar ones.
    led = lists.df.where("cls <> lead").where(den * F.least("n", "lead_n") >= num * F.greatest("n", "lead_n")).groupBy("cls", "lead").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("p").alias("p"), F.first("lead_n").alias("ln"), F.first("lead_p").alias("lp"), F.min("lead_doc").alias("ld"))
    likely = led.where(F.col("shared") >= shared_needed(F.col("n"), F.col("ln"), F.col("p"), F.col("lp"), num, den))
    star = likely.groupBy("cls").agg(F.max_by("lead", F.struct("shared", -F.col("ld"), "lead")).alias("lead")).select(F.col("cls").alias("a"), F.col("lead").alias("b"))
    links = _links(texts, star, width, num, den, "star")
    joined = stored(components(links, "a", "b"), "star-components").df

    # The rest: pairs that are still apart.
    parted = lists.df.select(*_LIST).join(joined, lists.df["cls"] == joined["node"], "left").select("shingle", "cls", "n", "p", "pos", (F.row_number().over(Window.partitionBy("cls").orderBy("pos")) - 1).cast("long").alias("before"), F.coalesce("component", "cls").alias("comp"))
    pair_schema = "a long, b long, na long, nb long, pa long, pb long"
    pairs = parted.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_apart(num, den), pair_schema).groupBy("a", "b").agg(F.count("*").alias("shared"), *(F.first(c).alias(c) for c in ("na", "nb", "pa", "pb")))
    rest = _links(texts, pairs.where(F.col("shared") >= shared_needed(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), num, den)), width, num, den, "rest")
    groups = stored(components(links.union(rest), "a", "b"), "near-components").df

    # From classes to documents: the smallest id of each class, then of each component.
    grouped = members.df.where("cls is not null").groupBy("cls").agg(F.min("id").alias("first")).join(groups, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("component", "cls").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = stored(grouped.join(least, "component").select("cls", "component_id"), "near-classes").df
    # Classes with one document, which are most, need no join: the others' table is what is joined.
    return members.df.join(of_class, "cls", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows that are the smallest id of their component, with all their columns.

    Rows with a null id stay only if no other row of their component has an id;
    rows that repeat an id stay or go together.
    """
    kept = near_duplicates(docs, id_col, text_col, **options).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__near_id")).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__near_id")), "left_semi")
