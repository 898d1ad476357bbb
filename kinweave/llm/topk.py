"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's dimensions are dealt to ``SLICES`` lists that lie apart, as tables of their own; an entry of a list is the part
of a score that its dimensions give.

1. Every list gives its best entries per query.  The exact scores of the vectors gathered give the k-th best so far, t.
2. The uniform cutoff t / SLICES goes to all lists, with the queries' blocks.  A vector whose parts all lie below it scores
   below t, so the entries at or above it are sufficient: the lists collect these.  A vector whose known parts, with every
   missing one counted as the cutoff, cannot reach t goes.
3. Only the missing parts of the vectors left are fetched, and their scores are exact.

Equal vectors are one class with its first k + 1 ids, so a group of copies is one entry.  Queries, cutoffs and entries are tables;
a block of queries meets a block of a list by an equality join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from kinweave.llm.negatives import _kind, _matrix
from kinweave.sources.staging import materialize

SLICES = 2
#: Rows and queries of a block.
ROWS, QUERIES = 8192, 512
#: Stands for a query that has no cutoff: fewer than k vectors were gathered, so every entry is sufficient.
NO_CUT = -(1 << 63)
BLOCK = StructType([StructField("slice", LongType()), StructField("dim", LongType()), StructField("block", LongType()), StructField("size", LongType()), StructField("width", IntegerType()),
                    *[StructField(c, BinaryType()) for c in ("ids", "cuts", "v")]])
ENTRY = StructType([StructField(c, LongType()) for c in ("query", "slice", "cls", "part")])


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x).

    Rows without id, null vectors and vectors with a null or non-finite component are left out.  An id names one vector:
    of several, the least in array order counts.
    """
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(F.coalesce(finite, F.lit(False)))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    size = len(table["v"][0])
    v = _matrix(table["v"], size)
    reach = max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))
    width = 2 if reach < 1 << 15 else 4 if reach < 1 << 31 else 8
    row = [k.as_py() for k in key] + [size, width, table["id"].to_numpy().astype("<i8").tobytes(), table["cut"].to_numpy().astype("<i8").tobytes(), v.astype(f"<i{width}").tobytes()]
    types = [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 3
    return pa.table({f: pa.array([x], t) for f, x, t in zip(BLOCK.names, row, types, strict=True)})


def _blocks(classes: DataFrame, rows: int, number: int) -> DataFrame:
    """One row per list and block of vectors (id, cut, v) of one length: a list holds every ``SLICES``-th dimension."""
    sliced = classes.withColumn("dim", F.size("v").cast("bigint")).withColumn("slice", F.explode(F.array(*[F.lit(s).cast("bigint") for s in range(SLICES)])))
    part = F.filter("v", lambda x, i: i % SLICES == F.col("slice"))
    dealt = sliced.select("slice", "dim", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-number // rows)))).cast("bigint").alias("block"), "id", "cut", part.alias("v"))
    return dealt.groupBy("slice", "dim", "block").applyInArrow(_pack, BLOCK)


def _entries(queries: DataFrame, lists: DataFrame, blocks: int, k: int | None) -> DataFrame:
    """Entries (query, slice, cls, part) of every list: each query's ``k`` best of a block, or all at its cutoff or above."""
    sides = ["size", "width", "ids", "cuts", "v"]
    left = (queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
            .select("slice", "dim", "block", F.struct(*sides).alias("q")))
    right = lists.select("slice", "dim", "block", F.struct(*sides).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, r = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                (q_ids, x), (r_ids, y) = ((np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["v"], f"<i{b['width']}").reshape(len(b["ids"]) // 8, b["size"])) for b in (q, r))
                kind = _kind(y, x)
                parts = (x.astype(kind) @ y.astype(kind).T).astype(np.int64) if x.shape[1] else np.zeros((len(x), len(y)), np.int64)
                if k is None:
                    cuts = np.frombuffer(q["cuts"], "<i8")
                    # least whole part p with SLICES * p >= cutoff
                    least = np.where(cuts == NO_CUT, NO_CUT, -(-cuts // SLICES))
                    row, at = np.nonzero(parts >= least[:, None])
                elif parts.shape[1] > k:
                    at = np.argpartition(-parts, k - 1, axis=1)[:, :k].ravel()
                    row = np.repeat(np.arange(len(x)), k)
                else:
                    row, at = np.indices(parts.shape).reshape(2, -1)
                if len(row):
                    made = (q_ids[row], np.full(len(row), batch.column(0)[i].as_py()), r_ids[at], parts[row, at])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=ENTRY.names)

    width = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = right.repartition(width, "slice", "dim", "block").join(left, ["slice", "dim", "block"])
    return met.select("slice", "q", "r").mapInArrow(run, ENTRY)


def _score(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def _resolved(pairs: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """Exact scores (query, cls, score) of pairs."""
    with_rows = pairs.join(classes.select(F.col("id").alias("cls"), F.col("v").alias("_r")), "cls")
    return with_rows.join(queries.select(F.col("id").alias("query"), F.col("v").alias("_q")), "query").select("query", "cls", _score(F.col("_q"), F.col("_r")).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest scores, all if there are fewer.

    ``rows`` and ``queries`` are tables of ``whole_vectors``.  Only vectors of the query's length are compared, and none
    with the query's id.  Ties go to the smaller vec_id.  No queries or no rows: an empty table.  Scores beyond 64 bits
    are an error.
    """
    first_ids = Window.partitionBy("v").orderBy("vec_id")
    # of equal vectors no more than k and the query itself can be among the best
    some = rows.select("vec_id", "v").withColumn("n", F.row_number().over(first_ids)).where(F.col("n") <= k + 1)
    none = F.lit(NO_CUT).cast("bigint").alias("cut")
    classes = materialize(some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("id"), none, "v", "ids"), "classes")
    asked = materialize(queries.select("vec_id", "v"), "queries")
    askers = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("id")).select("id", none, "v"), "askers")
    n_rows, n_asked = classes.count(), askers.count()
    blocks = max(1, -(-n_rows // ROWS))
    lists = materialize(_blocks(classes, ROWS, n_rows), "lists")

    gathered = _entries(_blocks(askers, QUERIES, n_asked), lists, blocks, k + 1)
    in_list = Window.partitionBy("query", "slice").orderBy(F.desc("part"), "cls")
    gathered = gathered.withColumn("n", F.row_number().over(in_list)).where(F.col("n") <= k + 1).select("query", "cls").distinct()
    kth = _best(_resolved(gathered, askers, classes), k + 1).where(F.col("place") == k + 1).select(F.col("query").alias("id"), F.col("score").alias("cut"))
    cuts = materialize(askers.drop("cut").join(kth, "id", "left").select("id", F.coalesce("cut", none).alias("cut"), "v"), "cutoffs")

    collected = _entries(_blocks(cuts, QUERIES, n_asked), lists, blocks, None)
    known = collected.groupBy("query", "cls").agg(F.sum("part").alias("known"), F.count("*").alias("seen"))
    bound = known.join(cuts.select(F.col("id").alias("query"), "cut"), "query")
    reaches = F.when(F.col("cut") == NO_CUT, F.lit(True)).otherwise(F.col("known") * SLICES + (SLICES - F.col("seen")) * F.col("cut") >= F.col("cut") * SLICES)
    left = materialize(bound.where(reaches).select("query", "cls", "known", "seen"), "sufficient")
    whole = left.where(F.col("seen") == SLICES).select("query", "cls", F.col("known").alias("score"))
    scored = _best(whole.unionByName(_resolved(left.where(F.col("seen") < SLICES).select("query", "cls"), cuts, classes)), k + 1)

    listed = scored.join(classes.select(F.col("id").alias("cls"), F.explode("ids").alias("vec_id")), "cls").select("query", "vec_id", "score")
    named = asked.join(askers.select(F.col("id").alias("query"), "v"), "v").select(F.col("vec_id").alias("query_id"), "query")
    ranked = named.join(listed, "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
