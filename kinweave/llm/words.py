"""Words of a whole Arrow batch hashed at once, for the operators that run numpy inside tasks.

A batch's texts lie behind one another in one buffer, so words are found and hashed with a few passes over that
buffer and no loop over documents.  Memory is bounded by the Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS = 1000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of the 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class WordHasher:
    """Finds and hashes words; ``gap`` is a table of 256 flags that marks the bytes between words."""

    def __init__(self, gap: np.ndarray, fold: bool):
        self.gap = gap
        code = np.arange(256, dtype=np.uint64)
        if fold:
            code[65:91] += 32
        self.code = code + np.uint64(1)
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 1 << 16)
            self.up, self.down = _powers(BASE, self.size), _powers(INVERSE, self.size)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and where each row's words begin (one entry more than rows).  Null counts as empty."""
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null("")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        if data is None or edges[-1] == edges[0]:
            return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        raw = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]]
        edges = edges - edges[0]
        n = len(raw)
        self._grow(n + 1)
        inside = ~self.gap[raw]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        border = edges[:-1][edges[:-1] < n]
        starts[border] = inside[border]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = edges[1:][edges[1:] > 0] - 1
        ends[last] = inside[last]
        first, past = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.code[raw] * self.up[:n], out=total[1:])
        hashes = (total[past] - total[first]) * self.down[first]
        return mix64(hashes + (past - first).astype(np.uint64)), np.searchsorted(first, edges)


def slabs(texts: pa.Array, limit: int = 1 << 20):
    """Consecutive row ranges (first, texts) of about ``limit`` bytes, so that the passes stay within the cache."""
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        past = max(first + 1, int(np.searchsorted(edges, edges[first] + limit, "right")) - 1)
        yield first, texts.slice(first, past - first)
        first = past


def bounded(docs: DataFrame) -> DataFrame:
    """Have Spark send texts in batches of ``BATCH_ROWS`` rows, unless the session has its own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if docs.sparkSession.conf.get(name) == "10000":
        docs.sparkSession.conf.set(name, str(BATCH_ROWS))
    return docs


def sub_batches(batch: pa.RecordBatch, column: int, limit: int = 4 << 20):
    """Consecutive parts of a batch with about ``limit`` bytes of text each; what a task makes at a time stays small."""
    for first, part in slabs(batch.column(column), limit):
        yield batch.slice(first, len(part))


def white_space() -> np.ndarray:
    """Bytes that ``[\\x20\\x09-\\x0D]`` matches."""
    gap = np.zeros(256, bool)
    gap[[32, 9, 10, 11, 12, 13]] = True
    return gap


def not_letters() -> np.ndarray:
    """Every ASCII byte that is no letter and no digit; bytes of other characters count as letters."""
    gap = np.ones(256, bool)
    gap[48:58] = gap[65:91] = gap[97:123] = False
    gap[128:] = False
    return gap


def chain(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """Hash of a sequence of word hashes, position by position."""
    out = np.full(len(parts[0]), seed, np.uint64)
    for part in parts:
        out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + part)
    return out
