"""Hard negatives by bounds along spanning trees of anchors.

Anchors are packed into blocks of a few hundred, and each block carries a minimum spanning tree of its vectors.  Rows are packed
into blocks, too, and every block of anchors meets every block of rows by an equality join on the row block's number.  In such
a tile the root's scores are exact.  For a child c of p and a row x, <c, x> lies within |c - p| |x| of <p, x>, so the
interval known at the parent, widened by the edge, bounds the child's score.  Only rows whose interval reaches what the
anchor looks for are scored again, which makes their intervals exact for the child's own children.

Two passes: the positives of each anchor (the threshold is the k-th best lower bound), then the negatives (the
windows are given by the scores of the positives).  A tile sends k rows per anchor or window at most, and ranks are cut to k per
task before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from kinweave.sources.staging import materialize

ANCHORS, ROWS, TILE_ROWS = 512, 8192, 4096
PACK = StructType([StructField("dim", LongType()), StructField("width", IntegerType()), *[StructField(c, BinaryType()) for c in ("uid", "vec_id", "label", "v")]])
TREE = StructType([*PACK, StructField("order", ArrayType(IntegerType())), StructField("parent", ArrayType(IntegerType())),
                   StructField("windows", ArrayType(ArrayType(LongType())))])
FOUND = StructType([StructField(c, LongType()) for c in ("anchor", "wanted", "row", "vec_id", "score")])


def whole_rows(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x); rows without id, label or vector, or with a null or non-finite component, are left out."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(F.coalesce(finite, F.lit(False)))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), whole.alias("v"))


# --- packs ---------------------------------------------------------------------------------

def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), size)


def _packed(table: pa.Table) -> tuple[dict, np.ndarray]:
    size = len(table["v"][0])
    v = _matrix(table["v"], size)
    reach = max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))
    width = 2 if reach < 1 << 15 else 4 if reach < 1 << 31 else 8
    row = {"dim": size, "width": width, "v": v.astype(f"<i{width}").tobytes(), **{c: table[c].to_numpy().astype("<i8").tobytes() for c in ("uid", "vec_id", "label")}}
    return row, v


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning tree of rows by distance: the rows in an order that puts parents first, and each row's parent (-1: the root)."""
    points, n = v.astype(np.float64), len(v)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    open_, order, at = np.ones(n, bool), [], 0
    for _ in range(n):
        order.append(at)
        open_[at] = False
        distance = np.square(points - points[at]).sum(axis=1)
        closer = open_ & (distance < near)
        near[closer], parent[closer] = distance[closer], at
        at = int(np.argmin(np.where(open_, near, np.inf)))
    return np.array(order), parent


def _pack_rows(key: tuple, table: pa.Table) -> pa.Table:
    row, _ = _packed(table.sort_by("label"))
    return pa.table({"dim": [row["dim"]], "width": [row["width"]], **{c: [row[c]] for c in PACK.names[2:]}, "block": [key[1].as_py()]},
                    schema=pa.schema([("dim", pa.int64()), ("width", pa.int32()), *[(c, pa.binary()) for c in PACK.names[2:]], ("block", pa.int64())]))


def _pack_anchors(key: tuple, table: pa.Table) -> pa.Table:
    row, v = _packed(table)
    order, parent = spanning_tree(v)
    fields = [("dim", pa.int64()), ("width", pa.int32()), *[(c, pa.binary()) for c in PACK.names[2:]], ("order", pa.list_(pa.int32())),
              ("parent", pa.list_(pa.int32())), ("windows", pa.list_(pa.list_(pa.int64())))]
    return pa.table({"dim": [row["dim"]], "width": [row["width"]], **{c: [row[c]] for c in PACK.names[2:]}, "order": [order.tolist()],
                     "parent": [parent.tolist()], "windows": [table["windows"].to_pylist()]}, schema=pa.schema(fields))


def row_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """One row per block of vectors of one length, in ``blocks`` blocks dealt by a hash."""
    dealt = rows.withColumn("size", F.size("v")).withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("bigint"))
    return dealt.groupBy("size", "block").applyInArrow(_pack_rows, StructType([*PACK, StructField("block", LongType())]))


def anchor_blocks(anchors: DataFrame, number: int) -> DataFrame:
    """One row per block of anchors of one length with their tree; anchors of one label lie together, in as many blocks as they need."""
    buckets = max(1, -(-number // ANCHORS))
    dealt = anchors.withColumn("size", F.size("v")).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)))
    parts = dealt.groupBy("size", "bucket").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("parts"))
    cut = dealt.join(parts, ["size", "bucket"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
    return cut.groupBy("size", "bucket", "part").applyInArrow(_pack_anchors, TREE)


# --- tiles ---------------------------------------------------------------------------------

class Block:
    def __init__(self, row: dict):
        self.uid, self.ids, self.label = (np.frombuffer(row[c], "<i8") for c in ("uid", "vec_id", "label"))
        self.v = np.frombuffer(row["v"], f"<i{row['width']}").reshape(len(self.uid), row["dim"])
        self.order, self.parent, self.windows = row.get("order"), row.get("parent"), row.get("windows")


def _kind(x: np.ndarray, a: np.ndarray) -> type:
    """A type in which the inner products are exact."""
    largest = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(a.astype(np.float64)).max(initial=0)) * max(1, x.shape[1])
    return np.float64 if largest < 2.0 ** 52 else np.int64 if largest < 2.0 ** 62 else object


def _first(scores: np.ndarray, ids: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((uid[some], ids[some], -scores[some]))[:k]]
    return np.lexsort((uid, ids, -scores))[:k]


def tile(anchors: Block, rows: Block, a: int, b: int, k: int, percent: int, counts: dict | None = None) -> Iterator[tuple]:
    """(anchor, wanted, row positions, scores) over rows a to b: the k best rows of an anchor's own label (no windows given), or
    the k best of other labels in each window; ``wanted`` is the positive's score that a window belongs to, or 0."""
    kind = _kind(rows.v[a:b], anchors.v)
    x, points = rows.v[a:b].astype(kind), anchors.v.astype(kind)
    flat, far = x.astype(np.float64), anchors.v.astype(np.float64)
    length = np.sqrt(np.square(flat).sum(axis=1)) * (1 + 1e-9)
    low, high = {}, {}
    left = np.bincount([p for p in anchors.parent if p >= 0], minlength=len(points)).tolist()
    for at in anchors.order:
        p, point = anchors.parent[at], points[at]
        if p < 0:
            lowest = (x @ point).astype(np.float64)
            highest = lowest.copy()
            exact = np.ones(b - a, bool)
        else:
            reach = length * (np.sqrt(np.square(far[at] - far[p]).sum()) * (1 + 1e-9))
            slack = 1e-9 * (np.abs(low[p]) + np.abs(high[p]) + reach) + 1e-6
            lowest, highest = low[p] - reach - slack, high[p] + reach + slack
            exact = np.zeros(b - a, bool)
            left[p] -= 1
            if not left[p]:
                del low[p], high[p]
        same = rows.label[a:b] == anchors.label[at]
        windows = anchors.windows[at]
        if windows is None:
            allowed = same & (rows.uid[a:b] != anchors.uid[at])
            bound = lowest[allowed]
            allowed &= highest >= (np.partition(bound, len(bound) - k)[len(bound) - k] if len(bound) > k else -np.inf)
        else:
            allowed, inside = ~same, np.zeros(b - a, bool)
            for top in windows:
                inside |= (highest >= top * percent / 100 - 1e-6 * (1 + abs(top))) & (lowest <= top + 1e-6 * (1 + abs(top)))
            allowed &= inside
        again = np.flatnonzero(allowed & ~exact)
        if counts is not None:
            counts["pairs"] = counts.get("pairs", 0) + b - a
            counts["scored"] = counts.get("scored", 0) + (len(again) if p >= 0 else b - a)
        score = x[again] @ point if p >= 0 else None
        if score is not None and len(again):
            lowest[again] = highest[again] = score.astype(np.float64)
        chosen = np.flatnonzero(allowed)
        if p < 0:
            score = x[chosen] @ point
        if left[at]:
            low[at], high[at] = lowest, highest
        if not len(chosen):
            continue
        score, ids, uid = score.astype(np.int64), rows.ids[a:b][chosen], rows.uid[a:b][chosen]
        if windows is None:
            best = _first(score, ids, uid, k)
            yield at, 0, a + chosen[best], score[best]
            continue
        for top in windows:
            fits = np.flatnonzero((100 * score.astype(object) >= percent * top) & (score <= top) if abs(top) > 1 << 55 else (100 * score >= percent * top) & (score <= top))
            best = fits[_first(score[fits], ids[fits], uid[fits], k)]
            yield at, top, a + chosen[best], score[best]


def _search(anchors: DataFrame, rows: DataFrame, blocks: int, k: int, percent: int) -> DataFrame:
    """What every tile finds; each anchor block is copied to every row block, the rows stay where they are."""
    sent = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    sides = [c for c in TREE.names if c != "dim"]
    left = sent.select("dim", "block", F.struct(*sides).alias("a"))
    right = rows.select("dim", "block", F.struct(*PACK.names[1:]).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column(0)[i].as_py()
                one, other = (Block({"dim": size, **batch.column(c)[i].as_py()}) for c in (1, 2))
                out = []
                for first in range(0, len(other.uid), TILE_ROWS):
                    for at, wanted, chosen, score in tile(one, other, first, min(first + TILE_ROWS, len(other.uid)), k, percent):
                        out.append((np.full(len(chosen), one.uid[at]), np.full(len(chosen), wanted), other.uid[chosen], other.ids[chosen], score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=FOUND.names)

    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = right.repartition(width, "dim", "block").join(left, ["dim", "block"])
    return met.select("dim", "a", "r").mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, id_col: str = "vec_id",
         label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and each of its positives.

    Scores are inner products of the components as floor(scale * x); higher scores come first, ties by smaller id.  Positives
    are the anchor's first ``positives`` other rows of its label; negatives the first ``negatives`` rows of other labels whose score
    is no higher than the positive's and at least ``percent`` percent of it (none, if that is negative).  ``is_anchor`` is a
    condition on vec_id.  Ids and labels are whole numbers; rows without id, label or vector, or with a null or non-finite
    component, take no part.  Only vectors of the same length meet.  Rows that share an id are rows of their own.  Empty
    tables give an empty one.  Scores beyond 64 bits are an error.
    """
    rows = materialize(whole_rows(vectors, id_col, label_col, vector_col, scale), "rows")
    # numbers of a written table's rows: a task that is run again gives the same ones
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    anchors = rows.where(is_anchor)
    blocks, number = max(1, -(-rows.count() // ROWS)), anchors.count()
    packed = materialize(row_blocks(rows, blocks), "row-blocks")
    plain = anchors.withColumn("windows", F.lit(None).cast("array<bigint>"))
    near = materialize(_ranked(_search(anchor_blocks(plain, number), packed, blocks, positives, percent), positives), "positives")
    wanted = near.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("windows"))
    aimed = anchors.join(wanted, F.col("uid") == F.col("anchor")).drop("anchor")
    hard = _ranked(_search(anchor_blocks(aimed, number), packed, blocks, negatives, percent), negatives)
    named = near.join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    named = named.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("wanted"))
    hard = hard.select("anchor", "wanted", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(hard, ["anchor", "wanted"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                                                         F.col("wanted").alias("positive_score"), "negative_score")
