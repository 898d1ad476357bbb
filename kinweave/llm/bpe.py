"""Byte-level BPE by a tree of halves.

A text is the leaves of a binary tree.  Leaves are encoded by themselves and joined in pairs up the tree:

* Texts.  The split pattern looks at most ``AHEAD`` characters beyond a match's start to choose its kind, and else reads
  on to the match's end and one character further.  So after a cut only matches that reach the cut or start less than
  ``AHEAD`` characters before it can change.  A join matches again from the first of these until a match ends where one
  of the right half's began; from there on matching goes the same way, as it never looks back.
* Matches.  The bytes of one match are halved until a half is at most ``SHORT`` bytes, whose neighbours are merged by rank.
  A join takes the last token on the left and the first on the right.  If this pair is what its own bytes encode to, the tokens stand side by side.  Else the
  bytes of a window around the border are encoded again, and the window grows by one token on each side that has not
  settled, until the pairs at both ends of the window are stable.  A sequence in which every neighbouring pair encodes to
  itself is the encoding of its bytes: the first merge across a border would have happened in that pair as well.

Decoding concatenates the bytes of the tokens up the same tree.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from kinweave.llm.words import bounded, sub_batches

AHEAD = 3
LEAF = 1 << 14
#: Bytes of a leaf of a match, and of a window worth remembering.
SHORT, WINDOW = 6, 16
#: Bytes that a task's memory of matches takes, and its memories of leaves and of windows; each has two generations of this size.
MATCH_BYTES, PART_BYTES = 18 << 20, 12 << 20
#: Bytes of an entry besides its text and its ids: two objects and their place in a hash table.
ENTRY_BYTES = 180
NEVER = 1 << 62


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file; a vocabulary is of a fixed size and is read by Spark's own reader."""
    lines = spark.read.text(path).where("value <> ''").collect()
    return {base64.b64decode(a): int(b) for a, b in (line.value.split() for line in lines)}


class Memory(dict):
    """What was used of late: when the young generation is full, it becomes the old one and the old one is dropped.

    A generation is bounded in bytes, whatever the lengths of its entries; ``unit`` is what one item of a value takes.
    """

    def __init__(self, make, limit: int, unit: int):
        super().__init__()
        self.make, self.limit, self.unit, self.old, self.used = make, limit, unit, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.used += ENTRY_BYTES + len(key) + self.unit * len(value)
        if self.used > self.limit:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self[key] = value
        return value


class Merges:
    """Encoding of single matches."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.windows, self.leaves = Memory(self._merge, PART_BYTES, 8), Memory(self._merge, PART_BYTES, 8)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        return self.windows[piece] if len(piece) <= WINDOW else self._merge(piece)

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge neighbours of least rank, the leftmost first, until none is left; for leaves and short windows."""
        rank_of = self.ranks.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        ranks = [rank_of(piece[i:i + 2], NEVER) for i in range(len(piece) - 1)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] + parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + parts[i], NEVER)
        return tuple([self.ranks[p] for p in parts])

    def settled(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        bytes_of = self.bytes_of
        if not left or not right:
            return left + right
        window, i, j = self.merge(bytes_of[left[-1]] + bytes_of[right[0]]), 1, 1
        if window == (left[-1], right[0]):
            return left + right
        while True:
            fits_left = i == len(left) or self.settled(left[len(left) - i - 1], window[0])
            fits_right = j == len(right) or self.settled(window[-1], right[j])
            if fits_left and fits_right:
                return (*left[:len(left) - i], *window, *right[j:])
            i, j = i + (not fits_left), j + (not fits_right)
            window = self.merge(b"".join([bytes_of[t] for t in (*left[len(left) - i:], *right[:j])]))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) <= SHORT:
            return self.leaves[piece]
        middle = len(piece) // 2
        return self.join(self.encode(piece[:middle]), self.encode(piece[middle:]))


class Matches:
    """Splitting of whole texts up the tree."""

    def __init__(self, pattern: str, leaf: int = LEAF):
        self.pattern, self.leaf = regex.compile(pattern), leaf

    def split(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return self.pattern.findall(text)
        middle = len(text) // 2
        return self.join(self.split(text[:middle]), self.split(text[middle:]), text, middle)

    def join(self, left: list[str], right: list[str], text: str, cut: int) -> list[str]:
        """Matches of ``text`` from those of its two halves; every character lies in a match."""
        start = cut
        while left and (start == cut or start > cut - AHEAD):
            start -= len(left.pop())
        ends, n = cut, 0
        for m in self.pattern.finditer(text, start):
            left.append(m.group())
            while ends < m.end():
                ends += len(right[n])
                n += 1
            if ends == m.end():
                break
        return left + right[n:]


class Coder:
    """Vocabulary and memory of matches; a worker process keeps its copy from task to task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.packed = Memory(self._pack, MATCH_BYTES, 1)

    def _pack(self, match: str) -> bytes:
        ids = self.merges.encode(match.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def __reduce__(self):
        return Coder, (self.merges.ranks,)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out: str = "token_ids", leaf: int = LEAF,
           decoded: str | None = None) -> DataFrame:
    """Replace ``text_col`` by its ids, packed as little-endian unsigned 32-bit numbers.

    Whole texts, without special tokens.  Null and empty texts have no ids.  Rows stay where they are: there is no
    shuffle, a task holds one Arrow batch and its memory of matches.  The vocabulary is sent to the tasks; its size does
    not depend on the data.  Other columns pass through; one that is called ``out`` is replaced.

    ``decoded`` names a column for the bytes that the ids decode to, made in the same pass as ``decode`` makes them.
    """
    made = [out] if decoded is None else [out, decoded]
    rest = [c for c in docs.columns if c not in (text_col, *made)]
    schema = StructType([*[docs.schema[c] for c in rest], *[StructField(c, BinaryType()) for c in made]])
    sent = docs.sparkSession.sparkContext.broadcast(Coder(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, known = Matches(pattern, leaf), sent.value.packed
        for batch in (part for whole in batches for part in sub_batches(whole, len(rest))):
            packed = [b"".join(map(known.__getitem__, matches.split(t.as_py() or ""))) for t in batch.column(len(rest))]
            columns = [packed] if decoded is None else [packed, [text_of(ids, sent.value.merges.bytes_of) for ids in packed]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], *[pa.array(c, pa.binary()) for c in columns]], names=[*rest, *made])

    return bounded(docs).select(*[F.col(f"`{c}`") for c in rest], F.col(text_col)).mapInArrow(run, schema)


def concatenated(tokens: list[bytes], leaf: int = LEAF) -> bytes:
    """Bytes of a run of tokens, concatenated up the tree."""
    if len(tokens) <= leaf:
        return b"".join(tokens)
    middle = len(tokens) // 2
    return concatenated(tokens[:middle], leaf) + concatenated(tokens[middle:], leaf)


def text_of(packed: bytes, bytes_of: dict[int, bytes]) -> bytes:
    """Bytes that packed ids stand for."""
    return concatenated([bytes_of[i] for i in np.frombuffer(packed, "<u4").tolist()])


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; an id outside the vocabulary is an error, null ids decode to nothing."""
    rest = [c for c in encoded.columns if c != out]
    schema = StructType([*[encoded.schema[c] for c in rest], StructField(out, BinaryType())])
    sent, at = encoded.sparkSession.sparkContext.broadcast(ranks), rest.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: b for b, i in sent.value.items()}
        for batch in (part for whole in batches for part in sub_batches(whole, at)):
            texts = [text_of(v.as_py() or b"", bytes_of) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*rest, out])

    return bounded(encoded).select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
