"""SentencePiece encoding and decoding through a table of distinct chunks.

White space becomes the marker U+2581 and one marker goes in front.  Where no
piece of the vocabulary has a marker after another character, merging never
crosses from a word into the next marker, so a text may be cut in front of
every marker that follows another character.

Texts go in blocks of about BLOCK_CHARS characters.  The distinct chunks of a
block that the table lacks are segmented in one call, each once, and their ids
and decoded strings are joined back at every position the chunks have.  The
table goes from block to block.  It is kept in two generations of TABLE_ROWS
rows: when the young one is full it becomes the old one, and rows that are used
move back to the young one, so that frequent chunks stay for the whole task and
memory is bounded whatever the task reads.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

MARK = "▁"
#: A chunk after the first marker: further markers, then a word; or markers at the end.
_CHUNK = re.compile(" +[^ ]*")
#: Distinct chunks in a generation of a task's table.
TABLE_ROWS = 300_000
#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
_CALL = 50_000


class Pieces:
    """A SentencePiece model behind a table from chunk to its ids.

    A chunk is keyed by its characters after the first marker, other markers as blanks.
    """

    def __init__(self, model_path: str, table_rows: int = TABLE_ROWS, block_chars: int = BLOCK_CHARS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(len(self.sp))]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross white space: {crossing[:3]}")
        if self.sp.normalize("  é é ﬁ  x ") != f"{MARK}{MARK}{MARK}é{MARK}é{MARK}ﬁ{MARK}{MARK}x{MARK}":
            raise ValueError("the model changes more than white space")
        self.said = [str(i) for i in range(len(self.sp))]
        #: Ids that are more than their piece's characters; chunks without them decode to themselves.
        self.special = frozenset(i for i in range(len(self.sp)) if self.sp.is_byte(i) or self.sp.is_unknown(i) or self.sp.is_control(i) or self.sp.is_unused(i))
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        #: Chunks that do not decode to themselves.
        self.decoded: dict[str, str] = {}
        self.rows, self.block_chars = table_rows, block_chars

    def chunks(self, text: str) -> list[str]:
        """The keys of a text's chunks in their order."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(f" {text}")]

    def learn(self, distinct: set[str]) -> None:
        """All of these are in the young generation afterwards; those that no generation has are segmented."""
        wanted = distinct - self.young.keys()
        if len(self.young) + len(wanted) > self.rows:
            kept = {c: x for c in self.old.keys() & distinct for x in (self.old[c],)}
            self.old, self.young = self.young, kept
            self.decoded = {c: x for c, x in self.decoded.items() if c in self.old or c in kept}
            wanted = distinct - kept.keys()
        new = []
        for c in wanted:
            if (x := self.old.get(c)) is None:
                new.append(c)
            else:
                self.young[c] = x
        said = self.said
        for k in range(0, len(new), _CALL):
            some, odd = new[k : k + _CALL], {}
            for c, found in zip(some, self.sp.encode(some, num_threads=1), strict=True):
                if not c:
                    # A marker alone: the library gives nothing for an empty text, so it is looked up.
                    found = [self.sp.piece_to_id(MARK)]
                self.young[c] = " ".join([said[i] for i in found])
                if not self.special.isdisjoint(found):
                    odd[c] = found
            back = self.sp.decode([*odd.values()], num_threads=1) if odd else ()
            self.decoded |= {c: x for c, x in zip(odd, back, strict=True) if c != x}

    def blocks(self, texts: Iterable[str]) -> Iterator[list[list[str]]]:
        block, size = [], 0
        for text in texts:
            block.append(self.chunks(text))
            size += len(text)
            if size >= self.block_chars:
                yield block
                block, size = [], 0
        if block:
            yield block

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[str, str]]:
        """Of each text its ids as decimals, with an end id only, and what they decode to."""
        end = self.said[self.sp.eos_id()]
        for block in self.blocks(texts):
            distinct = set().union(*block)
            self.learn(distinct)
            odd = {c: self.decoded[c] for c in self.decoded.keys() & distinct}
            for chunks in block:
                said = " ".join([*map(self.young.__getitem__, chunks), end])
                yield said, " ".join([odd.get(c, c) for c in chunks] if odd else chunks)


def _digests(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, ids_sha, decoded = [], [], []
            for said, back in pieces.encode(batch.column(1).to_pylist()):
                n.append(said.count(" ") + 1)
                ids_sha.append(sha(said))
                decoded.append(sha(back))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty, which is the end id alone.  Null ids and
    repeated rows are rows of their own; other columns are ignored; an empty
    table gives an empty result.  A text of any length is encoded whole.  No
    shuffle: each task keeps its own table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))
    out = rows.mapInArrow(_digests(model_path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _ids(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        for batch in batches:
            for k, (said, _) in enumerate(pieces.encode(batch.column(1).to_pylist())):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([list(map(int, said.split(" ")))], pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: id, ids array<int>."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_ids(model_path), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """From ids back to text: id, text.  Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sp.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
