"""Line deduplication through a sharded minimal perfect hash.

Every document gives 128-bit hashes of its distinct line keys.  Keys found in two documents or more are dealt to shards of
about ``SHARD_KEYS`` keys.  A shard is one row: the bit levels of a minimal perfect hash, and three arrays in its order,
the fingerprints (the half of the hash that places no key), the number of documents and the first document.  Probes go
to the shards' arrays in blocks of about ``BLOCK_PROBES``, so a line that a third of all documents holds is dealt to as many
tasks as it needs, and each holds one shard and one block.  A probe that finds its fingerprint and is not of the first
document marks its lines; only the marked ordinals go back to the documents.  Line texts are never shuffled or joined.

The hash: keys are placed by a hash of a level into an array of twice their number; places taken once are set, the
other keys go on to the next level.  A key's index is the number of places set before its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from kinweave.llm.words import BASE, _powers, bounded, mix64, slabs, sub_batches
from kinweave.sources.staging import materialize

WHITE = " \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 15
BLOCK_PROBES = 1 << 18
#: A document without id counts as one with this id.
LAST_ID = (1 << 63) - 1
OTHER = 0xD6E8FEB86659FD93
SHARD = StructType([StructField("shard", LongType()), StructField("sizes", ArrayType(LongType())), StructField("levels", ArrayType(BinaryType())),
                    *[StructField(c, BinaryType()) for c in ("fingerprints", "counts", "owners")]])
PROBE = StructType([StructField("owner", LongType()), StructField("text_hash", LongType()), StructField("place", LongType()),
                    StructField("print", LongType()), StructField("spread", IntegerType()), StructField("at", ArrayType(IntegerType()))])


# --- line keys -----------------------------------------------------------------------------

def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lines of all texts (none null) behind one another, the parent of each and its ordinal in the text."""
    lists = pc.split_pattern(texts, "\n")
    length = pc.list_value_length(lists).to_numpy().astype(np.int64)
    parent = pc.list_parent_indices(lists).to_numpy()
    return pc.list_flatten(lists), parent, np.arange(len(parent)) - (np.cumsum(length) - length)[parent]


class KeyHasher:
    """Two independent 64-bit hashes of every key, with a few passes over the buffer the keys lie in, about a megabyte at a time."""

    def __init__(self):
        self.size, self.base = 0, (BASE, OTHER)

    def __call__(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._some(part) for _, part in slabs(keys)] or [(np.empty(0, np.uint64),) * 2]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _some(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        keys = keys.cast(pa.large_string())
        edges = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset:keys.offset + len(keys) + 1]
        if not len(keys) or edges[-1] == edges[0]:
            return (np.zeros(len(keys), np.uint64),) * 2
        raw = np.frombuffer(keys.buffers()[2], np.uint8)[edges[0]:edges[-1]]
        edges = edges - edges[0]
        if len(raw) >= self.size:
            self.size = max(len(raw) + 1, 1 << 16)
            self.up = [_powers(b, self.size) for b in self.base]
            self.down = [_powers(pow(b, -1, 1 << 64), self.size) for b in self.base]
        # each byte is spread first, so that the sums of unlike texts do not cancel by the bytes' small differences
        spread = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in self.base]
        length, out = np.diff(edges).astype(np.uint64), []
        for up, down, code in zip(self.up, self.down, spread, strict=True):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(code[raw] * up[:len(raw)], out=total[1:])
            out.append(mix64((total[edges[1:]] - total[edges[:-1]]) * down[edges[:-1]] + length))
        return out[0], out[1]


def distinct_keys(texts: pa.Array, least: int, hasher: KeyHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, place, print, ordinals of the lines) of every distinct key of ``least`` code points or more in each text."""
    lines, parent, ordinal = split(texts)
    keys = pc.ascii_lower(pc.ascii_trim(lines, WHITE))
    long = pc.greater_equal(pc.utf8_length(keys), least)
    kept = long.to_numpy(zero_copy_only=False)
    place, mark = hasher(keys.filter(long))
    parent, ordinal = parent[kept], ordinal[kept]
    order = np.lexsort((ordinal, mark, place, parent))
    parent, place, mark, ordinal = parent[order], place[order], mark[order], ordinal[order]
    new = np.ones(len(order), bool)
    new[1:] = (parent[1:] != parent[:-1]) | (place[1:] != place[:-1]) | (mark[1:] != mark[:-1])
    first = np.flatnonzero(new)
    at = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(ordinal, pa.int32()))
    return parent[first], place[first], mark[first], at


# --- the index -----------------------------------------------------------------------------

def _level_places(place: np.ndarray, mark: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    return (mix64(place + mix64(mark + seed)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct (place, print) pairs: its levels are bit arrays, an index is a count of bits."""

    def __init__(self, sizes: list[int], levels: list[bytes]):
        self.sizes, self.bits, self.before, seen = sizes, [], [], 0
        for size, packed in zip(sizes, levels, strict=True):
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)
            self.bits.append(bits)
            self.before.append(np.cumsum(bits, dtype=np.int64) - 1 + seen)
            seen += int(bits.sum())

    @staticmethod
    def build(place: np.ndarray, mark: np.ndarray) -> tuple[list[int], list[bytes]]:
        sizes, levels = [], []
        while len(place):
            size = 2 * len(place)
            at = _level_places(place, mark, len(sizes), size)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(once).tobytes())
            place, mark = place[~once[at]], mark[~once[at]]
        return sizes, levels

    def index(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Index of every pair; one that the hash was not built of gets any index, or -1."""
        out, left = np.full(len(place), -1, np.int64), np.arange(len(place))
        for level, size in enumerate(self.sizes):
            at = _level_places(place[left], mark[left], level, size)
            found = self.bits[level][at]
            out[left[found]] = self.before[level][at[found]]
            left = left[~found]
        return out


def _unsigned(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _shard(key: tuple, table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    place, mark = _unsigned(table["place"]), _unsigned(table["print"])
    sizes, levels = PerfectHash.build(place, mark)
    index = PerfectHash(sizes, levels).index(place, mark)
    order = np.empty(len(index), np.int64)
    order[index] = np.arange(len(index))
    arrays = {"fingerprints": mark, "counts": table["n"].to_numpy(), "owners": table["owner"].to_numpy()}
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                     "levels": pa.array([levels], pa.list_(pa.binary())),
                     **{c: pa.array([a[order].astype("<i8", copy=False).tobytes() if c != "fingerprints" else a[order].tobytes()], pa.binary())
                        for c, a in arrays.items()}})


def _probe(probes: pa.Table, shards: pa.Table) -> pa.Table:
    if shards.num_rows == 0 or probes.num_rows == 0:
        return probes.select(["owner", "text_hash", "at"]).slice(0, 0)
    probes, row = probes.combine_chunks(), shards.slice(0, 1).to_pylist()[0]
    place, mark = _unsigned(probes["place"]), _unsigned(probes["print"])
    index = PerfectHash(row["sizes"], row["levels"]).index(place, mark)
    prints, counts, owners = (np.frombuffer(row[c], t) for c, t in (("fingerprints", np.uint64), ("counts", "<i8"), ("owners", "<i8")))
    hit = (index >= 0) & (prints[index] == mark)
    dropped = hit & (counts[index] >= 2) & (owners[index] != probes["owner"].to_numpy())
    return probes.select(["owner", "text_hash", "at"]).filter(pa.array(dropped))


# --- the operator --------------------------------------------------------------------------

def _probes(docs: DataFrame, least: int) -> DataFrame:
    """One row per distinct key of every document; ``spread`` deals the rows of a key, and a retried task repeats it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = KeyHasher(), 0
        for batch in (part for whole in batches for part in sub_batches(whole, 2)):
            parent, place, mark, at = distinct_keys(batch.column(2), least, hasher)
            spread = mix64(np.arange(seen, seen + len(parent), dtype=np.uint64)) >> np.uint64(33)
            seen += len(parent)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parent)), batch.column(1).take(pa.array(parent)), pa.array(place.view(np.int64)),
                                              pa.array(mark.view(np.int64)), pa.array(spread.astype(np.int32)), at], names=PROBE.fieldNames())

    return docs.select("owner", "text_hash", "text").mapInArrow(run, PROBE)


def build_index(probes: DataFrame) -> DataFrame:
    """The shards, one row each, of all keys that documents of two ids or more hold; rows of an id are one document.

    The counts are combined map-side, so a hot key is one row per task.
    """
    one = probes.groupBy("place", "print").agg(F.min("owner").alias("owner"), F.max("owner").alias("last"), F.count("*").alias("n"))
    repeated = materialize(one.where("owner < last").drop("last"), "line-keys")
    shards = max(1, -(-repeated.count() // SHARD_KEYS))
    dealt = repeated.withColumn("shard", F.pmod("place", F.lit(shards).cast("bigint")))
    return materialize(dealt.groupBy("shard").applyInArrow(_shard, SHARD), "line-shards")


def marked_lines(probes: DataFrame, index: DataFrame) -> DataFrame:
    """(owner, text_hash, ordinals): the lines that a document loses; documents that keep all lines have no row."""
    shards = max(1, index.count())
    dealt = probes.withColumn("shard", F.pmod("place", F.lit(shards).cast("bigint")))
    blocks = dealt.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_PROBES).cast("int").alias("blocks"))
    # one row per shard; the join follows the optimizer's own size bound, beyond it the skew split
    met = dealt.join(blocks, "shard").withColumn("block", F.pmod(F.col("spread"), F.col("blocks"))).drop("spread", "blocks")
    copies = index.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    out = StructType([StructField("owner", LongType()), StructField("text_hash", LongType()), StructField("at", ArrayType(IntegerType()))])
    found = (met.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block"))
             .applyInArrow(_probe, out))
    # equal rows of an id mark the same lines; once is enough
    return found.distinct().groupBy("owner", "text_hash").agg(F.flatten(F.collect_list("at")).alias("ordinals"))


def drop_repeated(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that other documents hold already.

    Texts are split at newlines; a null or empty text is one empty line.  A line's key is the line without white space at
    its ends, A-Z lower-cased.  Keys of ``least`` code points or more that two documents hold lose all their lines
    except in the document with the least id; other lines stay, joined by newlines.  Ids are whole numbers; rows
    with one id are one document, and rows without id are one document behind all others.  ``text_col`` becomes the kept
    text; ``n_lines`` (before dropping) and ``n_dropped`` are added and replace columns of these names, all others pass
    through.  An empty table gives an empty one.  Whole texts pass one shuffle, to meet the ordinals of their dropped lines.
    """
    given = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    packed = F.struct(*[F.col(f"`{c}`") for c in given]) if given else F.struct(F.lit(None).alias("none"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = bounded(docs).select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST_ID)).alias("owner"), F.xxhash64(text).alias("text_hash"),
                                text.alias("text"), packed.alias("rest"))
    probes = materialize(_probes(rows, least), "line-probes")
    lost = marked_lines(probes, build_index(probes))
    met = rows.join(lost, ["owner", "text_hash"], "left").select("rest", "text", F.coalesce("ordinals", F.array().cast("array<int>")).alias("ordinals"))
    schema = StructType([met.schema["rest"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sub_batches(whole, 1)):
            texts, n, dropped = without(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=schema.fieldNames())

    kept = met.mapInArrow(run, schema)
    return kept.select(*[F.col(f"rest.`{c}`").alias(c) for c in given], F.col("text").alias(text_col), "n_lines", "n_dropped")


def without(texts: pa.Array, ordinals: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without the lines of the given ordinals, their number of lines, and how many were dropped."""
    lines, parent, _ = split(texts)
    n = np.bincount(parent, minlength=len(texts))
    start = np.cumsum(n) - n
    stay = np.ones(len(parent), bool)
    if len(texts):
        stay[start[pc.list_parent_indices(ordinals).to_numpy()] + pc.list_flatten(ordinals).to_numpy()] = False
    left = np.bincount(parent[stay], minlength=len(texts))
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int64()), lines.filter(pa.array(stay)))
    return pc.binary_join(lists, "\n"), n, n - left
