"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated components are balanced bits that lie close
to the components.  Codes are cut into substrings; each substring is a table, and vectors that agree on one meet there.
Cosines of whole vectors in double precision decide.

Copies are one node with a count.  A bucket of any size is cut into blocks, and a task compares two blocks at a time as
one matrix product: it returns a link count per vector and a tree of links per connected piece, never the pairs.  A pair
that meets in several tables counts in the first only, which its two codes tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kinweave.llm.components import component_labels
from kinweave.sources.staging import broadcast_if_small, materialize

#: Vectors that the rotation is learned on at most; those of least hash.
SAMPLE = 8192
ROUNDS = 30
#: Least bits of a substring and least number of tables.  Substrings get longer with the logarithm of the vectors, so that a
#: bucket stays about as large; tables are added until planted pairs at the threshold are missed no more often than MISSED.
#: Where MOST tables do not get there, one table with one word compares all vectors of a group.
TABLE_BITS, TABLES, MOST, MISSED, BUCKET = 8, 12, 96, 0.003, 256
BLOCK = 1024
MADE = StructType([StructField("node", LongType()), StructField("links", LongType()), StructField("other", LongType())])


def learn_rotation(sample: np.ndarray, bits: int, seed: int = 7, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projections): columns are turned so that signs quantise the centred sample well.

    More bits than dimensions take several rotations, each from a start of its own.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    dims = centred.shape[1]
    _, axes = np.linalg.eigh(centred.T @ centred)
    rng, made = np.random.default_rng(seed), []
    while sum(m.shape[1] for m in made) < bits:
        width = min(dims, bits - sum(m.shape[1] for m in made))
        main = axes[:, ::-1][:, :dims]
        flat = centred @ main
        turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for _ in range(rounds):
            code = np.where(flat @ turn >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(code.T @ flat)
            turn = (u @ vt).T
        made.append((main @ turn)[:, :width])
    return mean, np.concatenate(made, axis=1)


def fit_tables(sample: np.ndarray, bits: int, threshold: float, tables: int = TABLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, projections, tables) for a sample of unit vectors: as few tables as catch planted pairs; no tables if MOST are not enough.

    A planted pair is a vector of the sample and another at cosine ``threshold`` in a drawn direction; the pairs of least
    cosine that the sample itself links must be caught as well.  If the vectors share a direction, what remains of them
    without it lies further apart, bits differ more often, and more tables are needed.
    """
    rng = np.random.default_rng(seed)
    x = sample[:2048]
    cosines = np.triu(x @ x.T, 1)
    a, b = np.nonzero((cosines >= threshold) & (cosines < 1 - 1e-9))
    least = np.argsort(cosines[a, b])[:2048]
    own = (x[a[least]], x[b[least]])
    drawn = rng.standard_normal(x.shape)
    drawn -= (drawn * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((drawn * drawn).sum(axis=1, keepdims=True))
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * drawn / np.where(length > 0, length, 1)
    while tables <= MOST:
        mean, projections = learn_rotation(sample, tables * bits, seed)
        missed = np.zeros(tables)
        for one, other in ((x, y), own):
            if len(one):
                same = ((one - mean) @ projections >= 0) == ((other - mean) @ projections >= 0)
                met = same.reshape(len(one), tables, bits).all(axis=2)
                missed = np.maximum(missed, 1 - np.logical_or.accumulate(met, axis=1).mean(axis=0))
        enough = np.flatnonzero(missed <= MISSED)
        if len(enough):
            tables = max(TABLES, int(enough[0]) + 1) if tables > TABLES else tables
            return mean, projections[:, :tables * bits], tables
        tables *= 2
    return mean, projections[:, :0], 0


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not zero, and hold no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a column of lists that all have ``width`` numbers."""
    return column.flatten().to_numpy().reshape(len(column), width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(nodes: DataFrame, size: int, mean: np.ndarray, projections: np.ndarray, tables: int, bits: int) -> DataFrame:
    """(node, group, v, code): one byte string of substrings per vector of ``size`` components."""
    schema = StructType([*nodes.select("node", "grp", "copies", "v").schema, StructField("code", StringType())])
    sent = nodes.sparkSession.sparkContext.broadcast((mean, projections))

    def run(batches):
        m, p = sent.value
        weights = 1 << np.arange(bits)
        for batch in batches:
            x = _unit(_matrix(batch.column(3), size))
            signs = ((x - m) @ p >= 0).reshape(len(x), tables, bits)
            words = (signs * weights).sum(axis=2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([" ".join(map(str, w)) for w in words.tolist()])], names=schema.names)

    return nodes.select("node", "grp", "copies", "v").mapInArrow(run, schema)


def local_trees(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of ``count`` indices by the links a - b."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(rows, table: int, low: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one cell: within a block (``low``), or between the blocks of side 0 and side 1."""
    node, side, copies, code, v = rows
    i, j = (np.arange(len(node)),) * 2 if low else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(i) or not len(j):
        return (np.empty(0, np.int64),) * 3
    near = v[i] @ v[j].T >= threshold
    if low:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = i[a], j[b]
    first = ~(code[a, :table] == code[b, :table]).any(axis=1)  # met in an earlier table: counted there
    a, b = a[first], b[first]
    links = np.zeros(len(node), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    root = local_trees(len(node), a, b)
    some = np.flatnonzero(links)
    return node[some], links[some], node[root[some]]


def links(coded: DataFrame, size: int, threshold: float, tables: int, block: int = BLOCK) -> DataFrame:
    """(node, links, other): what each cell found; ``links`` add up over cells, (node, other) connect the same nodes
    as all links do."""
    placed = coded.select("node", "grp", "copies", "v", F.split("code", " ").cast("array<int>").alias("code"))
    entries = placed.select("node", "grp", F.posexplode("code").alias("tab", "word"))
    sizes = entries.groupBy("grp", "tab", "word").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1").drop("size")
    placed_in = entries.join(sizes, ["grp", "tab", "word"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets itself and every other block of its bucket once
    cells = placed_in.select("node", "tab", "word", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("lo"), F.greatest("b", o).alias("hi"), (F.col("b") > o).cast("int").alias("side")))).alias("c"))
    held = placed.join(cells, "node").select("grp", "tab", "word", "c.lo", "c.hi", "c.side", "node", "copies", "code", "v")
    keys = ["grp", "tab", "word", "lo", "hi"]
    dealt = held.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        name = None

        def finish():
            if len(waiting) > 1:
                columns = list(zip(*waiting, strict=True))
                yield _compare((np.array(columns[1], np.int64), np.array(columns[0]), np.array(columns[2], np.int64), np.array(columns[3]), np.array(columns[4])),
                               name[1], name[3] == name[4], threshold)

        for batch in batches:
            found = []
            unit, code = _unit(_matrix(batch.column(9), size)), _matrix(batch.column(8), tables)
            keyed = zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True)
            more = zip(*[batch.column(c).to_pylist() for c in (5, 6, 7)], strict=True)
            for key, (side, node, copies), v, w in zip(keyed, more, unit, code, strict=True):
                if key != name:
                    found += finish()
                    waiting, name = [], key
                waiting.append((side, node, copies, w, v))
            if found:
                yield _made(found)
        last = list(finish())
        if last:
            yield _made(last)

    return dealt.mapInArrow(run, MADE)


def _made(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=MADE.names)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str | None = "label",
                    threshold: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Vectors of the same group (all, if ``group_col`` is None) and the same length are linked from cosine ``threshold``
    on.  ``component_id`` is the least vec_id reachable, ``kept`` marks the rows that hold it.  Vectors that are null or zero
    or hold null or non-finite components, and vectors without a group, link with nothing.  Repeated rows are vectors of
    their own and link with one another.  An empty table gives an empty one; names of other columns do not matter.
    """
    group = F.lit("") if group_col is None else F.col(group_col).cast("string")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), group.alias("grp"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")) & F.col("grp").isNotNull(), F.col("v")))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("grp"), F.transform("v", lambda x: x.cast("string"))), 256)))
    rows = materialize(rows, "vectors")
    classes = rows.where("v is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("grp").alias("grp"), F.first("v").alias("v"))
    # a class is named by a number of its own, read from the written table from here on
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("grp", F.concat_ws("|", F.size("v"), "grp")), "classes")
    sizes = {r.n: r["count"] for r in classes.select(F.size("v").alias("n")).groupBy("n").count().collect()}
    made = None
    for n in sorted(sizes):
        same = classes.where(F.size("v") == n)
        drawn = same.select("v", F.xxhash64("key", F.lit(n)).alias("h")).orderBy("h").limit(sample).select("v").collect()
        units, bits, tables = _unit(np.array([r.v for r in drawn], float)), max(TABLE_BITS, math.ceil(math.log2(sizes[n] / BUCKET))) + 2, 0
        while not tables and bits > TABLE_BITS + 1:
            bits -= 2
            mean, projections, tables = fit_tables(units, bits, threshold)
        tables, bits = (tables, bits) if tables else (1, 0)
        coded = materialize(codes(same, n, mean, projections, tables, bits), "codes")
        found = links(coded, n, threshold, tables)
        made = found if made is None else made.unionByName(found)
    if made is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    made = materialize(made, "links")
    counted = made.groupBy("node").agg(F.sum("links").alias("links"))
    labels = component_labels(made.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("key", "node", "copies", "least").join(counted, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = broadcast_if_small(materialize(named.join(least, "label").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"), "component_id"), "components"))
    own = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "key").join(of_class, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
