"""Presence/absence of items in sets and the hypergeometric sharing graph."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as arrow
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.hypergeom import log_upper_tail
from kinweave.operators.skew import pair_counts
from kinweave.sources.staging import broadcast_if_small, materialize, remove_stage, scratch_path


def presence_absence(hits: DataFrame, set_col: str = "query", item_col: str = "target") -> DataFrame:
    """Distinct (set, item) pairs; absent cells are simply not there."""
    return hits.select(F.col(set_col).alias("query"), F.col(item_col).alias("target")).distinct()


def merge_presence_absence(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables over the union of their items; gaps stay implicit."""
    return first.unionByName(second).distinct()


def ubiquity_filter(pa: DataFrame, max_freq: float = 0.8) -> DataFrame:
    """Keep the items that occur in at most ceil(max_freq * number of sets) sets."""
    return pa.join(frequent_items(pa, max_freq).select("target"), "target", "left_semi").select("query", "target")


def frequent_items(pa: DataFrame, max_freq: float) -> DataFrame:
    """(target, freq) of the items in at most ceil(max_freq * number of sets) sets."""
    n_sets = pa.agg(F.count_distinct("query").alias("n")).scalar()
    return item_frequency(pa).where(F.col("freq") <= F.ceil(F.lit(max_freq) * n_sets))


def set_size(pa: DataFrame) -> DataFrame:
    return pa.groupBy("query").agg(F.count("*").alias("size"))


def item_frequency(pa: DataFrame) -> DataFrame:
    return pa.groupBy("target").agg(F.count("*").alias("freq"))


def shared_item_pairs(pa: DataFrame) -> DataFrame:
    """(i, j, c): number of items two sets share, for i < j and c > 0."""
    return pair_counts(pa, "target", "query")


def min_occurrence_filter(pa: DataFrame, min_sets: int = 2, min_items: int = 1) -> DataFrame:
    """Keep items in at least ``min_sets`` sets, then sets with at least ``min_items`` items."""
    items = item_frequency(pa).where(F.col("freq") >= min_sets).select("target")
    kept = pa.join(items, "target", "left_semi").select("query", "target")
    if min_items <= 1:
        return kept
    sets = set_size(kept).where(F.col("size") >= min_items).select("query")
    return kept.join(sets, "query", "left_semi").select("query", "target")


#: Distinct set sizes, and triples of two sizes and a shared count, whose tails are formed before any pair is counted.
MAX_SIZES, MAX_TRIPLES = 2048, 1_000_000


def _tested_pairs(pa: DataFrame, items: DataFrame, universe: int, alpha: float) -> DataFrame:
    """Pairs with ln P[shared >= c] <= ln alpha as (source, target, c, a, b, log_p).

    ``items`` holds the kept items.  A pair is counted with the names and sizes of both sets, so nothing is looked up
    for it but its tail.  The tail is formed once per triple (a, b, c): of all that the sizes allow, or, if these
    are many, of those that occur.
    """
    rows = pa.join(items.select("target"), "target")
    sets = materialize(set_size(rows), "sets")
    counted = pair_counts(rows.join(sets, "query"), "target", "query", ["size"])
    pairs = counted.select(F.col("i").alias("source"), F.col("j").alias("target"), "c", F.col("size_i").alias("a"), F.col("size_j").alias("b"))
    c, a, b, u = F.col("c"), F.col("a"), F.col("b"), F.lit(universe).cast("bigint")
    sizes = materialize(sets.select("size").distinct(), "sizes")
    triples = None
    if sizes.count() <= MAX_SIZES:
        shapes = sizes.select(F.col("size").alias("a")).crossJoin(sizes.select(F.col("size").alias("b"))).withColumn("top", F.least("a", "b"))
        if (shapes.agg(F.sum("top")).first()[0] or 0) <= MAX_TRIPLES:
            lowest = F.greatest(F.lit(1).cast("bigint"), a + b - u)
            triples = shapes.where(lowest <= F.col("top")).select("a", "b", F.explode(F.sequence(lowest, F.col("top"))).alias("c"))
    if triples is None:
        pairs = materialize(pairs, "pairs")
        triples = pairs.select("a", "b", "c").distinct()
    # a sum of few terms for many triples: spread, or one small file of sizes would be one task
    tails = materialize(triples.repartition("a", "b", "c").withColumn("log_p", log_upper_tail(c, a, b, u)), "tails")
    significant = broadcast_if_small(tails.where(F.col("log_p") <= math.log(alpha)))
    return pairs.join(significant, ["a", "b", "c"]).select("source", "target", "c", "a", "b", "log_p")


def hypergeom_pairs(pa: DataFrame, alpha: float = 0.1, max_freq: float = 0.8) -> DataFrame:
    """Set pairs that share more items than chance allows: (source, target, c, a, b, log_p)."""
    pa = materialize(pa, "presence")
    items = materialize(frequent_items(pa, max_freq), "items")
    return _tested_pairs(pa, items, items.count(), alpha)


def pair_weight(weight: str = "neglog10") -> Column:
    """Weight of a tested pair: -log10 p, or the shared part c / min(a, b)."""
    if weight == "neglog10":
        return -F.col("log_p") / math.log(10.0)
    if weight == "ratio":
        return F.col("c") / F.least("a", "b")
    raise ValueError(f"unknown weight {weight!r}")


def hypergeom_edges(pa: DataFrame, alpha: float = 0.1, max_freq: float = 0.8, weight: str = "neglog10") -> DataFrame:
    """Sharing graph (source, target, weight) of the significant pairs."""
    return hypergeom_pairs(pa, alpha, max_freq).select("source", "target", pair_weight(weight).alias("weight"))


def hypergeom_edges_legacy(pa: DataFrame, alpha: float = 0.05, min_items: int = 1) -> DataFrame:
    """Older variant: universe of all items, sets of at least ``min_items``, weight -ln(p + 1e-15)."""
    pa = materialize(pa, "presence")
    universe = pa.agg(F.count_distinct("target")).first()[0]
    sets = set_size(pa).where(F.col("size") >= min_items).select("query")
    large = pa.join(sets, "query", "left_semi")
    tested = _tested_pairs(large, item_frequency(large), universe, alpha)
    return tested.select("source", "target", (-F.log(F.exp("log_p") + 1e-15)).alias("weight"))


#: Items and rows of a cover that one task goes on with by itself, at most.
COVER_ITEMS, COVER_ROWS = 1 << 18, 1 << 21
PICKS = "round int, position int, target string, freq bigint"


def hallmark_items(pa: DataFrame, top_n: int = 3) -> DataFrame:
    """Greedy cover: the ``top_n`` most frequent items, then again over the sets they miss.

    Frequencies only fall.  So the first items in order are gathered, as many as ``COVER_ITEMS`` and ``COVER_ROWS`` allow, and
    one task plays rounds on them as long as all picks come before the first item left out; then the rest is
    counted again and written.  Where these items are too large for a task, a round runs on all rows.  Picks are appended to a
    table of their own; the table a pass went on from is removed after the next is written.
    """
    spark = pa.sparkSession
    picks, before = scratch_path(spark, "picks"), None
    spark.createDataFrame([], PICKS).write.parquet(picks)
    remaining, round_no = pa, 0
    while True:
        counted = materialize(item_frequency(remaining).orderBy(F.desc("freq"), "target").limit(COVER_ITEMS + 1), "cover-items")
        # the first round runs on all rows: it is the one that meets items without a name
        chosen = None if round_no == 0 else _played(remaining, counted, top_n, round_no)
        if chosen is None:
            top = counted.orderBy(F.desc("freq"), "target").limit(top_n).collect()
            if not top:
                break
            names = [row["target"] for row in top]
            spark.createDataFrame([(round_no, n, row["target"], row["freq"]) for n, row in enumerate(top)], PICKS).coalesce(1).write.mode("append").parquet(picks)
            covered = remaining.where(F.col("target").isin(names)).select("query").distinct()
            left = remaining.join(covered, "query", "left_anti").where(~F.col("target").isin(names))
            round_no += 1
        else:
            chosen.write.mode("append").parquet(picks)
            chosen = spark.read.schema(PICKS).parquet(picks).where(F.col("round") >= round_no)
            round_no = chosen.agg(F.max("round")).first()[0] + 1
            names = broadcast_if_small(chosen.select("target"))
            covered = remaining.join(names, "target", "left_semi").select("query").distinct()
            left = remaining.join(covered, "query", "left_anti").join(names, "target", "left_anti").select(*remaining.columns)
        after = scratch_path(spark, "cover")
        left.write.parquet(after)
        if before is not None:
            remove_stage(spark, before)
        remaining, before = spark.read.schema(pa.schema).parquet(after), after
    return spark.read.schema(PICKS).parquet(picks)


def _played(remaining: DataFrame, counted: DataFrame, top_n: int, round_no: int) -> DataFrame | None:
    """Picks of the next rounds, played in one task on the first items; None if they are none or too large for it."""
    order = Window.orderBy(F.desc("freq"), "target")
    ranked = counted.select("target", "freq", F.row_number().over(order).alias("_at"), F.sum("freq").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_rows"))
    ranked = materialize(ranked, "cover-items")
    inside = (F.col("_at") <= COVER_ITEMS) & (F.col("_rows") <= COVER_ROWS)
    bound = ranked.where(~inside).orderBy("_at").first()
    kept = ranked.where(inside)
    if kept.count() < (top_n if bound else 1):
        return None
    rows = remaining.join(broadcast_if_small(kept.select("target")), "target").select("target", "query")
    return rows.groupBy(F.lit(0).alias("_all")).applyInArrow(_rounds(top_n, round_no, (bound["freq"], bound["target"]) if bound else None), PICKS)


def _rounds(top_n: int, round_no: int, bound: tuple[int, str] | None):
    """Rounds of the greedy cover on the rows (target, query) of some items, while all picks come before ``bound``."""
    def starts(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.argsort(code, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(code, minlength=n))])

    def run(rows: arrow.Table) -> arrow.Table:
        named, asked = (rows[c].combine_chunks().dictionary_encode() for c in ("target", "query"))
        item, names = named.indices.to_numpy(zero_copy_only=False), named.dictionary.to_pylist()
        # a row without a set goes with its item only, as if it were a set of its own
        alone = asked.is_null().to_numpy(zero_copy_only=False)
        member = asked.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        member[alone] = len(asked.dictionary) + np.arange(alone.sum())
        n_items, n_sets = len(names), len(asked.dictionary) + int(alone.sum())
        rank = np.empty(n_items, np.int64)
        rank[sorted(range(n_items), key=names.__getitem__)] = np.arange(n_items)
        (by_item, item_at), (by_set, set_at) = starts(item, n_items), starts(member, n_sets)
        freq, live = np.bincount(item, minlength=n_items), np.ones(n_sets, bool)
        made, turn = [], round_no
        while True:
            score = freq * n_items - rank
            top = np.argpartition(-score, top_n)[:top_n] if n_items > top_n else np.arange(n_items)
            top = [int(i) for i in top[np.argsort(-score[top])] if freq[i]]
            if not top or bound and (len(top) < top_n or (-freq[top[-1]], names[top[-1]]) >= (-bound[0], bound[1])):
                break
            made += [(turn, n, names[i], int(freq[i])) for n, i in enumerate(top)]
            turn += 1
            held = np.unique(np.concatenate([member[by_item[item_at[i]:item_at[i + 1]]] for i in top]))
            held = held[live[held]]
            live[held] = False
            gone = np.concatenate([by_set[set_at[k]:set_at[k + 1]] for k in held])
            freq -= np.bincount(item[gone], minlength=n_items)
        return arrow.table({c: [m[n] for m in made] for n, c in enumerate(("round", "position", "target", "freq"))},
                        schema=arrow.schema([("round", arrow.int32()), ("position", arrow.int32()), ("target", arrow.string()), ("freq", arrow.int64())]))

    return run


def edge_diagnostics(edges: DataFrame, n_sets: Column) -> DataFrame:
    """Number of possible, weighted and zero pairs."""
    n = n_sets.cast("bigint")
    total = (n * (n - 1) / 2).cast("bigint")
    return edges.agg(F.count(F.when(F.col("weight") > 0, 1)).alias("nonzero_pairs")).select(
        total.alias("total_pairs"), "nonzero_pairs", (total - F.col("nonzero_pairs")).alias("zero_pairs"))
