"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Every coordinate has its own learning rate, and the L1 term sets most of them to exactly zero, so the model that goes to
the tasks is a short list of (bucket, weight) whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from kinweave.llm.words import WordHasher, bounded, chain, not_letters, slabs, sub_batches

#: Labelled rows that a fit reads at most; the rows of least hash are taken.
SAMPLE_ROWS = 16_000
BITS = 22
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Weights other than zero by bucket, in ascending order; there are never more than 2 ** bits."""

    bits: int
    bias: float
    buckets: np.ndarray
    weights: np.ndarray


def features(hasher: WordHasher, texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, word pair and pair with one word left out between."""
    words, at = hasher(texts)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows, keys = [row], [chain([words], 1)]
    for step, seed in ((1, 2), (2, 3)):
        same = row[step:] == row[:-step] if len(row) > step else np.empty(0, bool)
        rows.append(row[step:][same] if len(row) > step else row[:0])
        keys.append(chain([words[:-step][same], words[step:][same]], seed) if len(row) > step else words[:0])
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)


def ftrl(examples, bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal over a stream of (label, distinct buckets); the bias is a coordinate without a penalty.

    Returns the bias, the buckets whose weight is not zero, and their weights.
    """
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i):
        shrunk = np.abs(z[i]) - l1 * (i != bias)
        return np.where(shrunk > 0, -np.sign(z[i]) * shrunk / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for label, buckets in examples:
        i = np.append(buckets, bias)
        w = weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
        z[i] += g - sigma * w
        n[i] += g * g
    kept = np.flatnonzero(np.abs(z[:-1]) > l1)
    return float(weights(np.array([bias]))[0]), kept, weights(kept)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: int = SAMPLE_ROWS, bits: int = BITS, epochs: int = 6) -> Model:
    """Fit on at most ``rows`` labelled documents.

    Rows without id or label are not used; an id that is labelled twice counts as 1 if any of its labels is, and an id
    that several documents have stands for the least of their texts.  Features
    are made where the documents lie; only (order, label, buckets) of the bounded sample meet in one task.  Without any
    labelled row every score is 1/2.
    """
    sample = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
              .orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(rows))
    picked = (bounded(docs).select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_text")).join(F.broadcast(sample), "_id")
              .groupBy("_id", "_label").agg(F.min("_text").alias("_text")))
    made = StructType([StructField("order", DoubleType()), StructField("label", IntegerType()), StructField("buckets", ArrayType(IntegerType()))])

    def extract(batches):
        hasher = WordHasher(not_letters(), fold=False)
        for batch in (part for whole in batches for part in sub_batches(whole, 2)):
            order = np.concatenate([np.empty(0, np.int64), *(np.unique(((row + first) << bits) | bucket) for first, part in slabs(batch.column(2))
                                                             for row, bucket in [features(hasher, part, bits)])])
            edges = np.searchsorted(order, np.arange(batch.num_rows + 1, dtype=np.int64) << bits)
            flat = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array((order & ((1 << bits) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["order", "label", "buckets"])

    order = (F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 12), 16, 10)).cast("double")
    ready = picked.select(order.alias("order"), F.col("_label").alias("label"), "_text").mapInArrow(extract, made)
    result = StructType([StructField("buckets", ArrayType(IntegerType())), StructField("weights", ArrayType(DoubleType())), StructField("bias", DoubleType())])

    def train(batches):
        held = []
        for batch in batches:
            orders, marks, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            held += [(orders[k], float(marks[k]), values[edges[k]:edges[k + 1]]) for k in range(batch.num_rows)]
        held.sort(key=lambda x: x[:2])
        bias, kept, w = ftrl(((y, b) for _ in range(epochs) for _, y, b in held), bits) if held else (0.0, np.empty(0, np.int64), np.empty(0))
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array([kept.astype(np.int32)], pa.list_(pa.int32())), pa.array([w], pa.list_(pa.float64())), pa.array([bias])], names=["buckets", "weights", "bias"])
        pa.default_memory_pool().release_unused()

    found = ready.repartition(1).mapInArrow(train, result).collect()
    if not found:
        return Model(bits, 0.0, np.empty(0, np.int64), np.empty(0))
    return Model(bits, found[0].bias, np.array(found[0].buckets, np.int64), np.array(found[0].weights, float))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) from the whole text.

    Null and empty texts get the score of the bias.  Other columns (or those named in ``keep``) pass through; those called score or
    predicted are replaced.  The text may be any length; a feature counts once per document.  No shuffle.
    """
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = StructType([*[docs.schema[c] for c in rest], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, hasher = sent.value, WordHasher(not_letters(), fold=False)
        table = np.zeros(1 << m.bits, np.float32)
        table[m.buckets] = m.weights
        for batch in (part for whole in batches for part in sub_batches(whole, len(rest))):
            total = np.full(batch.num_rows, m.bias)
            for first, part in slabs(batch.column(len(rest))):
                row, bucket = features(hasher, part, m.bits)
                used = table[bucket] != 0
                both = np.unique((row[used] << m.bits) | bucket[used])
                total[first:first + len(part)] += np.bincount(both >> m.bits, table[both & ((1 << m.bits) - 1)], len(part))
            s = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*rest, "score", "predicted"])

    return bounded(docs).select(*[F.col(f"`{c}`") for c in rest], F.lower(F.col(text_col)).alias("_lowered")).mapInArrow(run, schema)
