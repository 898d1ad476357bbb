"""MinHash near-duplicates with two permutations, one of them shifted around the circle (C-MinHash).

Every shingle is placed on a circle of 2^32 positions by the first permutation.  Coordinate k of a signature is the
least value of the second permutation over the document's positions, all moved on by k.  So two permutations give every
coordinate; no table of random numbers is kept.  Bands of ``ROWS`` coordinates make buckets; candidates are confirmed on
the whole shingle sets.

Whatever has the same shingle set is one node, so copies are never paired.  Within a bucket every node meets the
bucket's most central node first.  Once the links found so have been joined to components, only pairs of a bucket that
lie in different components can still join anything; of these, all that can meet the threshold by the places of their
first shared shingle are confirmed.  So no bucket of near copies is expanded to all its pairs, and no link that could
join two components is left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from kinweave.llm.components import component_labels
from kinweave.llm.words import WordHasher, bounded, chain, mix64, slabs, sub_batches, white_space
from kinweave.operators.skew import pairs_within
from kinweave.sources.staging import broadcast_if_small, materialize

WORDS = 5
ROWS = 5
MISS = 1e-5


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands with which a pair at the threshold shares no bucket with a probability of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold ** rows))


def batch_sets(hasher: WordHasher, texts: pa.Array) -> list[np.ndarray]:
    return [s for _, part in slabs(texts) for s in shingle_sets(*hasher(part))]


def shingle_sets(hashes: np.ndarray, at: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Distinct shingles of each row as sorted 64-bit hashes; fewer words than ``words`` make one shingle."""
    n = len(hashes)
    full = chain([hashes[j:n - words + 1 + j] for j in range(words)], words) if n >= words else np.empty(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(full[a:b - words + 1]))
        elif b > a:
            out.append(chain([hashes[j:j + 1] for j in range(a, b)], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of the 32-bit numbers; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of a non-empty set; long sets go through in slices."""
    places = (mix64(shingles + np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 1024):
        np.minimum(out, second_permutation(places[None, i:i + 1024] + shifts).min(axis=1), out=out)
    return out


def _keys(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, bands): ``node`` names the shingle set, null without one; one hash per band."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("text_key", LongType()),
                         StructField("n_shingles", LongType()), StructField("node", BinaryType()), StructField("bands", ArrayType(LongType()))])

    def run(batches):
        hasher = WordHasher(white_space(), fold=True)
        for batch in (part for whole in batches for part in sub_batches(whole, 2)):
            counts, nodes, found = [], [], []
            for s in batch_sets(hasher, batch.column(2)):
                counts.append(len(s))
                nodes.append(_keys(s) if len(s) else None)
                if len(s):
                    folded = signature(s, bands * rows).reshape(bands, rows).astype(np.uint64)
                    found.append(chain([np.arange(bands, dtype=np.uint64), *folded.T], 77).view(np.int64))
                else:
                    found.append(np.empty(0, np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), flat],
                                             names=["doc_id", "text_key", "n_shingles", "node", "bands"])

    return bounded(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = StructType([StructField("node", BinaryType()), StructField("shingles", ArrayType(LongType()))])

    def run(batches):
        hasher = WordHasher(white_space(), fold=True)
        for batch in (part for whole in batches for part in sub_batches(whole, 0)):
            sets = batch_sets(hasher, batch.column(0))
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()),
                                            pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_keys(s) for s in sets], pa.binary()), flat], names=["node", "shingles"])

    return bounded(docs).select(F.col(text_col).alias("text")).mapInArrow(run, schema)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets meet the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                    rows: int = ROWS) -> DataFrame:
    """One row per document: (doc_id, text_key, n_shingles, node, label, component_id, kept).

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of distinct five-word shingles.
    ``component_id`` is the least doc_id reachable, ``kept`` marks the rows that hold it.  Null and empty texts and
    texts of white space only have no set and stay alone.  Rows with one doc_id and different texts are linked by their
    texts only; ``label`` names the component of the texts, null without a set.  A null doc_id never becomes a component_id unless the component has no other.  An empty table gives
    an empty table.  Other columns of ``docs`` are not looked at, so their names do not matter.
    """
    rows_of = materialize(signatures(docs, id_col, text_col, bands_for(percent / 100, rows), rows), "signatures")
    nodes = materialize(rows_of.where("node is not null").groupBy("node")
                        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    exploded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = exploded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    # a node's popularity: how many others its buckets hold; the most popular one is the bucket's centre
    shared = materialize(exploded.join(sizes, "bucket").select("bucket", "size", "node", "n"), "buckets")
    popular = shared.groupBy("node").agg(F.sum("size").alias("popular"))
    members = materialize(shared.drop("size").join(popular, "node"), "members")
    held = broadcast_if_small(materialize(members.select("node").distinct().join(nodes.select("node", "doc_id"), "node").select(F.col("doc_id").alias("_held")).distinct(), "candidates"))
    known = F.col(id_col).eqNullSafe(F.col("_held"))
    chosen = docs.select(F.col(id_col), F.col(text_col)).join(held, known, "left_semi")
    wanted = members.select("node").distinct()
    sets = materialize(_sets(chosen, id_col, text_col).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    centres = members.groupBy("bucket").agg(F.max(F.struct("popular", "node", "n")).alias("m")).select("bucket", F.col("m.node").alias("centre"), F.col("m.n").alias("size"))
    fits = 100 * F.least("n", "size") >= percent * F.greatest("n", "size")
    pairs = (members.join(centres, "bucket").where((F.col("node") != F.col("centre")) & fits)
             .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    links = materialize(_confirm(pairs, sets, percent), "links")
    labels = materialize(wanted.join(component_labels(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    now = members.join(labels, "node")
    apart = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    left = materialize(now.join(apart, "bucket").groupBy("node", "label", "n").agg(F.collect_list("bucket").alias("buckets")), "left")
    more = materialize(_confirm(_bucket_mates(left, sets, percent), sets, percent), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = wanted.join(component_labels(links), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return _per_document(rows_of, nodes, labels)


def _bucket_mates(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a bucket, lie in different components and can still meet the threshold.

    Sets of n and m shingles that meet it share at least  need = percent * (n + m) / (100 + percent).  With all shingles in
    one order, rarest first, the first shared one then stands among the first n - need + 1 of one set and the first
    m - need + 1 of the other.  What tells copies of one text apart, their own changes, is rare and stands first, so a
    bucket of thousands of copies that are too far from each other gives few pairs; none that meets the threshold is lost.
    """
    tokens = sets.join(left.select("node", "label", "n"), "node").select("node", "label", "n", F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("f"), (F.min("label") != F.max("label")).alias("across")).where("f > 1")
    ordered = (tokens.join(common, "token").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("f", "token", "across"))).alias("t"))
               .select("node", "label", "n", F.size("t").alias("known"), F.posexplode("t").alias("at", "t")))
    # shingles of one set only stand before the others
    placed = ordered.select("node", "label", "n", (F.col("n") - F.col("known") + F.col("at") + 1).alias("place"), F.col("t.token").alias("token"), F.col("t.across").alias("across"))
    first = materialize(placed.where((F.col("place") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1) & F.col("across")).drop("across"), "prefixes")
    need = F.ceil(F.lit(percent) * (F.col("n_i") + F.col("n_j")) / F.lit(100 + percent))
    met = pairs_within(first, ["token"], "node", ["label", "n", "place"]).where(
        (F.col("label_i") != F.col("label_j")) & (F.col("place_i") <= F.col("n_i") - need + 1) & (F.col("place_j") <= F.col("n_j") - need + 1))
    pairs = met.select(F.col("i").alias("a"), F.col("j").alias("b")).distinct()
    own = lambda c: left.select(F.col("node").alias(c), F.col("buckets").alias(f"in_{c}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").where(F.arrays_overlap("in_a", "in_b")).select("a", "b")


def _per_document(rows_of: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    labelled = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = broadcast_if_small(materialize(labelled.join(least, "label").select("node", "label", "component_id"), "components"))
    own = F.coalesce("component_id", "doc_id")
    return (rows_of.drop("bands").join(of_node, "node", "left")
            .select("doc_id", "text_key", "n_shingles", "node", "label", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Keep one document of each group of linked texts, with all its columns; rows that repeat id and text stay once.

    Of a group's rows the least doc_id is taken, then the least text_key.  Groups are told apart by their label: unlinked
    texts that share a doc_id, or have none, are groups of their own.
    """
    kept = materialize(near_duplicates(docs, id_col, text_col, percent).where("kept"), "kept")
    alone = kept.where("node is null").select("doc_id", "text_key")
    # rows of a component that are kept have one doc_id
    chosen = kept.where("node is not null").groupBy("label", "doc_id").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key")
    ids = broadcast_if_small(materialize(alone.unionByName(chosen).distinct().toDF("_kept", "_key"), "kept"))
    rows = docs.join(ids, F.col(id_col).eqNullSafe(F.col("_kept")) & (F.xxhash64(text_col) == F.col("_key")), "left_semi")
    once = kept.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    return rows if once else rows.dropDuplicates([id_col, text_col])
