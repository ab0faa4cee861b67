"""A Katz backoff language model over a corpus, and the corpus scored by it.

    P(v | u) = d_c c(u v) / c(u)     where u v was seen in training
             = a(u) P(v)             otherwise

d_r are Good-Turing discounts for counts up to K; P(v) is the unigram model,
discounted likewise, whose left-over mass goes to unknown words as one class;
a(u) is what makes each history's probabilities sum to one exactly.

The corpus is held as chunks of about CHUNK_TOKENS tokens.  Words get numbers by
falling count, so that a number alone gives a word's count (``Classes``), and
numbers of frequent words are short.  N-grams are kept and scored in buckets by
history.  A history that would take up more than a part (an eighth) of a bucket
is spread over as many buckets as it has parts, by its successors; what its
backoff weight needs is summed over those buckets and goes back to them alone.

All tables between the steps (chunks, vocabulary, n-grams of each chunk, counted
n-grams) are partitioned tables in the shared folder; nothing that grows with
the corpus goes through the driver, except one number for each distinct word
count (at most the root of twice the number of tokens).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, whole
from .packing import give_back, pack, unpack
from .prefix_sums import running_sums
from .shingles import word_hashes

CHUNK_TOKENS = 1_000_000
#: Tokens that a bucket of n-grams has, about.
BUCKET_TOKENS = 1_000_000
#: Words of chunks that a bucket of the vocabulary has, about.
BUCKET_WORDS = 2_000_000
#: Parts of a bucket: a history that needs more than one is spread.
PARTS = 8
#: Counts above this are not discounted.
K = 5
#: What the base adds to each count.
BASE_ADD = 0.1
#: The end of a text as a word: no word has a blank.
_END = xxhash.xxh3_64_intdigest(b" end")


def discounts(n: dict[int, int]) -> np.ndarray:
    """Good-Turing discount for counts 0..K (0 unused), from how many types have each count.

    d_r = (r*/r - q) / (1 - q), r* = (r+1) n_(r+1) / n_r, q = (K+1) n_(K+1) / n_1.  Where that is not
    between 0 and 1, as with few data, count r is not discounted.
    """
    d = np.ones(K + 1)
    if n.get(1):
        q = (K + 1) * n.get(K + 1, 0) / n[1]
        for r in range(1, K + 1):
            if n.get(r) and q < 1:
                x = ((r + 1) * n.get(r + 1, 0) / n[r] / r - q) / (1 - q)
                if 0 < x < 1:
                    d[r] = x
    return d


class Classes:
    """Words by number: those with the same count have consecutive numbers, higher counts first.

    Number ``v`` (as many as there are words) stands for every unknown word, ``v + 1`` for the begin of a text.
    """

    def __init__(self, counts: list[tuple[int, int]], train_texts: int):
        counts = sorted(counts, reverse=True)
        self.count = np.array([c for c, _ in counts] + [0], np.int64)
        types = np.array([n for _, n in counts], np.int64)
        self.start = np.r_[0, np.cumsum(types)].astype(np.int64)
        self.v, self.tokens, self.texts = int(types.sum()), int((self.count[:-1] * types).sum()), train_texts
        d = discounts(dict(counts))
        kept = np.where(self.count <= K, d[np.minimum(self.count, K)], 1.0) * self.count
        left = self.tokens - float((kept[:-1] * types).sum())
        # With nothing discounted, one token more leaves room for unknown words.
        total = self.tokens + (1 if left <= 1e-9 * max(self.tokens, 1) else 0)
        left = total - float((kept[:-1] * types).sum())
        self.p = np.r_[kept[:-1], left] / total

    def of(self, number: np.ndarray) -> np.ndarray:
        """The class of each number; unknown words are the last."""
        return np.searchsorted(self.start, number, side="right") - 1

    def history_count(self, number: np.ndarray) -> np.ndarray:
        """How often each number was a history in training."""
        at = np.minimum(number, self.v)
        return np.where(number == self.v + 1, self.texts, self.count[self.of(at)])

    def base(self, klass: np.ndarray) -> np.ndarray:
        return np.log10((self.count[klass] + BASE_ADD) / (self.tokens + BASE_ADD * (self.v + 1)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    part, no = TaskContext.get().partitionId(), 0
    ids: list = []
    train: list[bool] = []
    tokens: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, local = np.unique(np.concatenate(tokens), return_inverse=True)
        lengths = np.array([len(x) for x in tokens], np.int64)
        learned = np.bincount(local[np.repeat(np.array(train), lengths)], minlength=len(words))
        row = {"chunk": pa.array([part << 32 | no], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "train": pa.array([pack(np.array(train, np.uint8))]), "lengths": pa.array([pack(lengths)]), "tokens": pa.array([pack(local)]), "words": pa.array([words.tobytes()]), "counts": pa.array([pack(learned)])}
        return pa.record_batch(list(row.values()), names=list(row))

    end = np.array([_END], np.uint64)
    for batch in batches:
        for i, text, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            ids.append(i)
            train.append(t)
            tokens.append(np.concatenate([word_hashes(text), end]))
            size += len(tokens[-1])
            if size >= CHUNK_TOKENS:
                yield flush()
                no, size = no + 1, 0
                ids, train, tokens = [], [], []
                give_back()
    if ids:
        yield flush()


_CHUNK = "chunk long, ids array<long>, train binary, lengths binary, tokens binary, words binary, counts binary"


def _by_word(buckets: int):
    """A chunk's words in ranges of their hash, which are the vocabulary's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                w, c = np.frombuffer(words, np.uint64), unpack(counts)
                edges = np.searchsorted((w >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                some = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([w[edges[b] : edges[b + 1]].tobytes() for b in some], pa.binary()), pa.array([pack(c[edges[b] : edges[b + 1]]) for b in some], pa.binary())], names=["bucket", "chunk", "words", "counts"])

    return run


def _count_words(table: pa.Table) -> pa.Table:
    w = np.concatenate([np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()])
    c = np.concatenate([unpack(x) for x in table["counts"].to_pylist()])
    w, c = w[c > 0], c[c > 0]
    words, at = np.unique(w, return_inverse=True)
    total = np.bincount(at, weights=c, minlength=len(words)).astype(np.int64)
    order = np.lexsort((words, -total))
    n, first, types = np.unique(-total[order], return_index=True, return_counts=True)
    return pa.table({"bucket": table["bucket"][:1], "words": pa.array([words[order].tobytes()], pa.binary()), "counts": pa.array([(-n).tolist()], pa.list_(pa.int64())), "types": pa.array([types.tolist()], pa.list_(pa.int64()))})


def _number_words(v: int):
    """The numbers of each chunk's words, in the order of the chunk; ``v`` for those that training lacks."""

    def run(table: pa.Table) -> pa.Table:
        words = numbers = np.empty(0, np.int64)
        for w, starts, types in zip(table["vocabulary"].to_pylist(), table["starts"].to_pylist(), table["types"].to_pylist(), strict=True):
            if w is not None:
                words = np.frombuffer(w, np.uint64)
                types = np.array(types, np.int64)
                numbers = np.repeat(np.array(starts, np.int64) - np.cumsum(types) + types, types) + np.arange(len(words))
                order = np.argsort(words)
                words, numbers = words[order], numbers[order]
        chunks, out = [], []
        for chunk, asked in zip(table["chunk"].to_pylist(), table["words"].to_pylist(), strict=True):
            if asked is None:
                continue
            asked = np.frombuffer(asked, np.uint64)
            found = np.full(len(asked), v, np.int64)
            if len(words):
                at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                found = np.where(words[at] == asked, numbers[at], v)
            chunks.append(chunk)
            out.append(pack(found))
        n = len(chunks)
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * n, pa.int32()), "numbers": pa.array(out, pa.binary())})

    return run


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray, buckets: int | np.ndarray) -> np.ndarray:
    """A number below ``buckets`` for each x."""
    x = x.astype(np.uint64) * _MIX
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) * np.asarray(buckets, np.uint64) >> np.uint64(32)).astype(np.int64)


def _key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of two numbers below 2**32 one that sorts as the pair does."""
    return u.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64)


class Layout:
    """Which bucket a pair of a history and a successor is in."""

    def __init__(self, classes: Classes, buckets: int):
        self.classes, self.buckets = classes, buckets
        self.part = max(1, classes.tokens // (PARTS * buckets))

    def parts(self, u: np.ndarray) -> np.ndarray:
        """Over how many parts each history is spread."""
        return np.maximum(1, -(-self.classes.history_count(u) // self.part))

    def bucket(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return _spread(_key(u, _spread(_key(u, v), self.parts(u))), self.buckets)

    def buckets_of(self, u: int) -> np.ndarray:
        """Those that pairs of the history may be in."""
        n = int(self.parts(np.array([u]))[0])
        return np.unique(_spread(_key(np.full(n, u), np.arange(n)), self.buckets))


_GRAMS = "bucket int, chunk long, history binary, next binary, times binary, learned binary, texts binary, ids array<long>, held_out binary, n_tokens binary, n_known binary, base binary"


def _pairs(layout: Layout):
    """Each chunk's pairs by bucket (with the texts that have them), and a row with bucket -1 with what its texts have of their own."""

    classes, buckets = layout.classes, layout.buckets

    def run(table: pa.Table) -> pa.Table:
        give_back()
        rows = table.to_pylist()
        own = next(r for r in rows if r["tokens"] is not None)
        numbers = np.concatenate([unpack(r["numbers"]) for r in sorted((r for r in rows if r["numbers"] is not None), key=lambda r: r["bucket"])])
        lengths, train = unpack(own["lengths"]), unpack(own["train"]).astype(bool)
        v = numbers[unpack(own["tokens"])]
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        u = np.r_[0, v[:-1]]
        u[starts] = classes.v + 1
        text = np.repeat(np.arange(len(lengths)), lengths)
        klass = classes.of(v)
        base = np.add.reduceat(classes.base(klass), starts)
        known = np.add.reduceat((v < classes.v).astype(np.int64), starts)
        out = [{"bucket": -1, "chunk": own["chunk"], "ids": own["ids"], "held_out": pack(~train), "n_tokens": pack(lengths), "n_known": pack(known), "base": pack(base)}]
        bucket = layout.bucket(u, v)
        key = _key(u, v)
        order = np.lexsort((key, bucket))
        bucket, key, text = bucket[order], key[order], text[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
        times = np.diff(np.r_[first, len(key)])
        learned = np.add.reduceat(train[text].astype(np.int64), first)
        edges = np.searchsorted(bucket[first], np.arange(buckets + 1))
        at = np.r_[first, len(key)]
        for b in range(buckets):
            i, j = edges[b], edges[b + 1]
            if i < j:
                k = key[first[i:j]]
                out.append({"bucket": b, "chunk": own["chunk"], "history": pack((k >> np.uint64(32)).astype(np.int64), rising=True), "next": pack((k & np.uint64(0xFFFFFFFF)).astype(np.int64)), "times": pack(times[i:j]), "learned": pack(learned[i:j]), "texts": pack(text[at[i] : at[j]])})
        kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "ids": pa.list_(pa.int64())}
        return pa.table({c: pa.array([r.get(c) for r in out], kinds.get(c, pa.binary())) for c in (x.split()[0] for x in _GRAMS.split(", "))})

    return run


def _history_sums(u: np.ndarray, c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct (sorted) history: types by count 1..K, counts above K summed, successors' unigram probability."""
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.empty(0, np.int64)
    if not len(first):
        return np.empty(0, np.int64), np.empty((0, K + 2))
    parts = [np.add.reduceat((c == r).astype(float), first) for r in range(1, K + 1)]
    return u[first], np.c_[tuple(parts) + (np.add.reduceat(np.where(c > K, c, 0).astype(float), first), np.add.reduceat(p, first))]


def _count_pairs(layout: Layout):
    classes = layout.classes

    def run(table: pa.Table) -> pa.Table:
        give_back()
        key = np.concatenate([_key(unpack(u), unpack(v)) for u, v in zip(table["history"].to_pylist(), table["next"].to_pylist(), strict=True)])
        n = np.concatenate([unpack(x) for x in table["learned"].to_pylist()])
        key, n = key[n > 0], n[n > 0]
        keys, at = np.unique(key, return_inverse=True)
        c = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
        u, v = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        spread = layout.parts(u) > 1
        histories, sums = _history_sums(u[spread], c[spread], classes.p[classes.of(v[spread])])
        return pa.table(
            {
                "bucket": table["bucket"][:1],
                "history": pa.array([pack(u, rising=True)], pa.binary()),
                "next": pa.array([pack(v)], pa.binary()),
                "times": pa.array([pack(c)], pa.binary()),
                "with_count": pa.array([[int((c == r).sum()) for r in range(1, K + 2)]], pa.list_(pa.int64())),
                "spread": pa.array([[{"history": int(h), "sums": s.tolist()} for h, s in zip(histories, sums, strict=True)]], pa.list_(pa.struct([("history", pa.int64()), ("sums", pa.list_(pa.float64()))]))),
            }
        )

    return run


_COUNTED = "bucket int, history binary, next binary, times binary, with_count array<long>, spread array<struct<history: long, sums: array<double>>>"


def backoff(sums: np.ndarray, count: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of histories with their sums and counts: the denominator of seen pairs, and the backoff weight a(u)."""
    kept = sums[:, :K] @ (d[1:] * np.arange(1, K + 1)) + sums[:, K]
    # Where nothing is discounted, one count more leaves room for what was not seen.
    total = count + (count - kept <= 1e-9 * count)
    return total, (total - kept) / total / (1 - sums[:, K + 1])


def _weights(layout: Layout, d: np.ndarray):
    """Of spread histories, with their sums over all buckets, what scoring needs, once for each bucket that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            histories = batch.column(0).to_numpy(zero_copy_only=False)
            sums = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(K + 2)]) if len(histories) else np.empty((0, K + 2))
            total, weight = backoff(sums, layout.classes.history_count(histories), d)
            to = [layout.buckets_of(h) for h in histories.tolist()]
            times = [len(x) for x in to]
            yield pa.record_batch([pa.array(np.concatenate([*to, np.empty(0, np.int64)]), pa.int32()), pa.array(np.repeat(histories, times)), pa.array(np.repeat(total, times).astype(float)), pa.array(np.repeat(weight, times))], names=["bucket", "history", "total", "weight"])

    return run


def _score_pairs(layout: Layout, d: np.ndarray):
    classes = layout.classes

    def run(table: pa.Table) -> pa.Table:
        give_back()
        rows = table.to_pylist()
        keys = c = np.empty(0, np.int64)
        hot = sorted((x["history"], x["total"], x["weight"]) for r in rows for x in r["spread"] or ())
        for r in rows:
            if r["texts"] is None and r["history"] is not None:
                keys, c = _key(unpack(r["history"]), unpack(r["next"])), unpack(r["times"])
        u, v = (keys.astype(np.uint64) >> np.uint64(32)).astype(np.int64), (keys.astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own = layout.parts(u) == 1
        histories, sums = _history_sums(u[own], c[own], classes.p[classes.of(v[own])])
        total, weight = backoff(sums, classes.history_count(histories), d)
        histories = np.concatenate([histories, np.array([h for h, *_ in hot], np.int64)])
        total = np.concatenate([total, np.array([t for _, t, _ in hot], float)])
        weight = np.concatenate([weight, np.array([w for *_, w in hot], float)])
        order = np.argsort(histories)
        histories, total, weight = histories[order], total[order], weight[order]

        def at(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(sorted_):
                return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
            k = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
            return k, sorted_[k] == x

        out: dict[str, list] = {"bucket": [], "chunk": [], "texts": [], "score": []}
        for r in rows:
            if r["texts"] is None:
                continue
            hu, hv, times, texts = unpack(r["history"]), unpack(r["next"]), unpack(r["times"]), unpack(r["texts"])
            k, seen = at(keys, _key(hu, hv))
            j, known = at(histories, hu)
            p = np.where(known, weight[j] if len(weight) else 1.0, 1.0) * classes.p[classes.of(hv)]
            if len(keys):
                n = c[k]
                p = np.where(seen, np.where(n <= K, d[np.minimum(n, K)], 1.0) * n / np.where(known, total[j], 1.0), p)
            score = np.bincount(texts, weights=np.repeat(np.log10(p), times))
            some = np.unique(texts)
            out["bucket"].append(r["bucket"])
            out["chunk"].append(r["chunk"])
            out["texts"].append(pack(some, rising=True))
            out["score"].append(pack(score[some]))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int64()), "texts": pa.array(out["texts"], pa.binary()), "score": pa.array(out["score"], pa.binary())})

    return run


def _sum_up(train_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        base = unpack(own["base"])
        score = np.zeros(len(base))
        for r in sorted((r for r in rows if r["ids"] is None), key=lambda r: r["bucket"]):
            score[unpack(r["texts"])] += unpack(r["score"])
        n = len(base)
        return pa.table({"id": pa.array(own["ids"], pa.int64()), "held_out": pa.array(unpack(own["held_out"]).astype(bool)), "n_tokens": pa.array(unpack(own["n_tokens"])), "n_known": pa.array(unpack(own["n_known"])), "train_tokens": pa.array(np.full(n, train_tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


_RESULT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that have ``train`` and scores all.  A null text
    counts as empty, which is its end alone.  With nothing to learn from, every
    token is unknown and has probability 1.  Null ids and repeated rows are
    rows of their own; other columns are ignored.  An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = stored(texts.mapInArrow(_chunks, _CHUNK), "lm-chunks")

    # The vocabulary, in buckets by hash, each in order of falling count.
    held = chunks.df.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("n")).first().n // 8
    word_buckets = int(max(shuffle_partitions(spark), 16, held // BUCKET_WORDS))
    asked = chunks.df.select("chunk", "words", "counts").mapInArrow(_by_word(word_buckets), "bucket int, chunk long, words binary, counts binary")
    vocabulary = stored(asked.groupBy("bucket").applyInArrow(_count_words, "bucket int, words binary, counts array<long>, types array<long>"), "lm-vocabulary")
    by_count = vocabulary.df.select("bucket", F.inline(F.arrays_zip("counts", "types"))).toDF("bucket", "count", "types")
    counts = [(r["count"], r.n) for r in by_count.groupBy("count").agg(F.sum("types").alias("n")).collect()]
    train_texts = texts.where("train").count()
    classes = Classes(counts, train_texts)
    if classes.v + 1 >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    starts = spark.createDataFrame([(int(c), int(s)) for c, s in zip(classes.count[:-1], classes.start[:-1], strict=True)], "count long, class_start long") if counts else spark.createDataFrame([], "count long, class_start long")
    earlier = running_sums(by_count, ["count", "bucket"], "types", within="count", label="lm-classes")
    placed = earlier.join(starts, "count").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), (F.col("class_start") + F.col("before")).alias("start")))).alias("placed"))
    words = vocabulary.df.join(placed, "bucket").select("bucket", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("words"), F.col("words").alias("vocabulary"), F.col("placed.start").alias("starts"), "types")
    requests = asked.select("bucket", "chunk", "words", F.lit(None).cast("binary").alias("vocabulary"), F.lit(None).cast("array<long>").alias("starts"), F.lit(None).cast("array<long>").alias("types"))
    numbered = requests.union(words).groupBy("bucket").applyInArrow(_number_words(classes.v), "chunk long, bucket int, numbers binary")

    # Pairs, in buckets by history.  The numbers of the most frequent histories are the smallest.
    all_tokens = classes.tokens / max(train_texts, 1) * max(texts.count(), 1)
    buckets = int(max(shuffle_partitions(spark), 16, all_tokens // BUCKET_TOKENS))
    layout = Layout(classes, buckets)
    none = F.lit(None)
    left = chunks.df.select("chunk", "ids", "train", "lengths", "tokens", none.cast("int").alias("bucket"), none.cast("binary").alias("numbers"))
    right = numbered.select("chunk", none.cast("array<long>").alias("ids"), *(none.cast("binary").alias(c) for c in ("train", "lengths", "tokens")), "bucket", "numbers")
    pairs = stored(left.union(right).groupBy("chunk").applyInArrow(_pairs(layout), _GRAMS), "lm-pairs")
    chunks.drop()
    vocabulary.drop()

    counted = stored(pairs.df.where("bucket >= 0").select("bucket", "history", "next", "learned").groupBy("bucket").applyInArrow(_count_pairs(layout), _COUNTED), "lm-counted")
    with_count = counted.df.select(F.posexplode("with_count").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
    d = discounts({r.r + 1: r.n for r in with_count})
    sums = counted.df.select(F.inline("spread")).groupBy("history").agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(K + 2)))
    weights = sums.mapInArrow(_weights(layout, d), "bucket int, history long, total double, weight double").groupBy("bucket").agg(F.collect_list(F.struct("history", "total", "weight")).alias("spread"))

    blobs = ("history", "next", "times", "texts")
    kind = "array<struct<history: long, total: double, weight: double>>"
    model = counted.df.select("bucket", none.cast("long").alias("chunk"), "history", "next", "times", none.cast("binary").alias("texts"), none.cast(kind).alias("spread"))
    there = pairs.df.where("bucket >= 0").select("bucket", "chunk", *blobs, none.cast(kind).alias("spread"))
    heavy = weights.select("bucket", none.cast("long").alias("chunk"), *(none.cast("binary").alias(c) for c in blobs), "spread")
    scored = there.union(model).union(heavy).groupBy("bucket").applyInArrow(_score_pairs(layout, d), "bucket int, chunk long, texts binary, score binary")
    own = ("ids", "held_out", "n_tokens", "n_known", "base")
    kinds = {"ids": "array<long>"}
    by_text = scored.select("chunk", "bucket", "texts", "score", *(none.cast(kinds.get(c, "binary")).alias(c) for c in own))
    base = pairs.df.where("bucket = -1").select("chunk", "bucket", none.cast("binary").alias("texts"), none.cast("binary").alias("score"), *own)
    return base.union(by_text).groupBy("chunk").applyInArrow(_sum_up(classes.tokens), _RESULT).withColumnRenamed("id", id_col)
