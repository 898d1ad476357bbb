"""Hit tables: thresholds, best hits, interval overlap, identity weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.columns import header_id
from kinweave.operators.skew import first_by
from kinweave.sources.staging import materialize

PAIR = ("query", "target")


def hit_threshold_filter(hits: DataFrame, evalue_max: float = 1e-5, bitscore_min: float = 50) -> DataFrame:
    return hits.where((F.col("evalue") <= evalue_max) & (F.col("bitscore") >= bitscore_min))


def best_hit(hits: DataFrame, evalue_max: float = 1e-5, bitscore_min: float = 50,
             keys: Sequence[str] = PAIR) -> DataFrame:
    """Per pair the hit of lowest e-value, then highest bitscore, after the thresholds."""
    return first_by(hit_threshold_filter(hits, evalue_max, bitscore_min), keys,
                    [F.col("evalue"), -F.col("bitscore")])


def best_hit_by_bitscore(hits: DataFrame, bitscore_min: float = 50, keys: Sequence[str] = PAIR) -> DataFrame:
    return first_by(hits.where(F.col("bitscore") >= bitscore_min), keys, [-F.col("bitscore")])


def keep_first(df: DataFrame, keys: Sequence[str], order: str = "row_no") -> DataFrame:
    """Drop later duplicates of the keys, by an explicit row number."""
    return first_by(df, keys, [F.col(order)])


def _overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start < other_end) & (other_start < end)


def greedy_overlap_filter(hits: DataFrame, group_rows: int = 1000) -> DataFrame:
    """Per pair, hits by pident * alnlen descending; keep those overlapping no kept one.

    Ties go by start, end and the other columns.  The hits of a pair with up to ``group_rows`` of them are folded in one
    expression; those of larger pairs are kept and dropped in rounds over coordinate bins (``_keep_by_rounds``), which gives
    the same hits and holds no pair in one place.
    """
    rank = -(F.col("pident") * F.col("alnlen"))
    rest = [c for c in hits.columns if c not in (*PAIR, "qstart", "qend")]
    large = materialize(hits.groupBy(*PAIR).agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select(*PAIR), "large-pairs")
    some = large.isEmpty()
    few = hits if some else hits.join(large.alias("l"), [hits[c].eqNullSafe(F.col(f"l.{c}")) for c in PAIR], "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("_rank"), "qstart", "qend", *rest)))
    listed = few.groupBy(*PAIR).agg(ordered.alias("_hits"))
    nothing = F.slice("_hits", 1, 0)
    kept = F.aggregate("_hits", nothing, lambda held, h: F.when(
        F.exists(held, lambda k: _overlap(h["qstart"], h["qend"], k["qstart"], k["qend"])), held).otherwise(F.concat(held, F.array(h))))
    folded = listed.select(*PAIR, F.explode(kept).alias("h")).select(*[F.col(c) if c in PAIR else F.col(f"h.{c}").alias(c) for c in hits.columns])
    if some:
        return folded
    many = hits.join(large.alias("l"), [hits[c].eqNullSafe(F.col(f"l.{c}")) for c in PAIR], "left_semi")
    return folded.unionByName(_keep_by_rounds(many.withColumn("_rank", rank)).select(*hits.columns))


def _keep_by_rounds(hits: DataFrame) -> DataFrame:
    """The greedy choice for pairs of any size, as rounds of local decisions.

    A forward hit lies in all bins it covers, a reverse hit (qstart >= qend), which only overlaps forward ones that span
    it, in the bin of its end.  A forward hit that comes before all live hits of its bins is kept; so is a reverse hit
    that comes before all live forward ones of its bin.  Then the hits that overlap a kept one go.  The first live hit of
    a pair is always kept, so rounds end; each keeps one forward hit a bin at most, so dropping is an equality join.
    """
    spark, rest = hits.sparkSession, [c for c in hits.columns if c not in (*PAIR, "_rank", "qstart", "qend")]
    once = first_by(hits.where("qstart < qend"), [*PAIR, "qstart", "qend"], [F.col("_rank")]).unionByName(hits.where("qstart >= qend"))
    numbered = materialize(once, "ranked").withColumn("_id", F.monotonically_increasing_id()).withColumn("_pair", F.struct(*PAIR)).withColumn("_forward", F.col("qstart") < F.col("qend"))
    numbered = materialize(numbered.withColumn("_order", F.struct("_rank", "qstart", "qend", *rest, "_id")), "numbered")
    widths = numbered.groupBy("_pair").agg(F.greatest(F.ceil(F.avg(F.when(F.col("_forward"), F.col("qend") - F.col("qstart")))), F.lit(1)).alias("_width"))
    placed = numbered.join(widths, [numbered["_pair"] == widths["_pair"]]).drop(widths["_pair"]).withColumn("_width", F.coalesce("_width", F.lit(1)))
    bin_of = lambda c: F.floor(c / F.col("_width")).cast("bigint")
    bins = F.when(F.col("_forward"), F.sequence(bin_of(F.col("qstart")), bin_of(F.col("qend") - 1))).otherwise(F.array(bin_of(F.col("qend"))))
    live = materialize(placed.select("_pair", "_id", "_order", "_forward", "qstart", "qend", F.explode(bins).alias("_bin")), "live")
    chosen = []
    while not live.isEmpty():
        firsts = live.groupBy("_pair", "_bin").agg(F.min(F.when(F.col("_forward"), F.col("_order"))).alias("_first"), F.min(F.when(~F.col("_forward"), F.col("_order"))).alias("_reverse"))
        before = F.when(F.col("_forward"), (F.col("_order") == F.col("_first")) & F.coalesce(F.col("_order") < F.col("_reverse"), F.lit(True))).otherwise(
            F.coalesce(F.col("_order") < F.col("_first"), F.lit(True)))
        kept = materialize(live.join(firsts, ["_pair", "_bin"]).groupBy("_id").agg(F.bool_and(before).alias("kept")).where("kept").select("_id"), "kept")
        chosen.append(kept)
        marked = materialize(live.join(kept.withColumn("_kept", F.lit(True)), "_id", "left"), "marked")
        taken = marked.where("_kept and _forward").select("_pair", "_bin", F.col("qstart").alias("_s"), F.col("qend").alias("_e"))
        left = marked.where("_kept is null").join(taken, ["_pair", "_bin"], "left")
        # kept reverse hits of a bin from the highest end down: one that ends behind a start and begins before an end overlaps
        spans = left.select("_pair", "_bin", "_id", "_order", "_forward", "qstart", "qend", "_s", "_e", F.when(F.col("_forward"), F.col("qstart")).otherwise(F.col("qend")).alias("_at"), F.lit(1).alias("_asks"))
        backs = marked.where("_kept and not _forward").select("_pair", "_bin", F.col("qend").alias("_at"), F.col("qstart").alias("_back"), F.lit(0).alias("_asks"))
        above = Window.partitionBy("_pair", "_bin").orderBy(F.desc("_at"), F.desc("_asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        swept = spans.unionByName(backs, allowMissingColumns=True).withColumn("_nearest", F.min("_back").over(above)).where("_asks = 1")
        hit = F.coalesce(_overlap(F.col("qstart"), F.col("qend"), F.col("_s"), F.col("_e")), F.lit(False)) | (F.col("_forward") & F.coalesce(F.col("_nearest") < F.col("qend"), F.lit(False)))
        gone = materialize(swept.where(hit).select("_id").distinct(), "gone")
        live = materialize(marked.where("_kept is null").drop("_kept").join(gone, "_id", "left_anti"), "live")
    ids = spark.createDataFrame([], "_id bigint")
    for kept in chosen:
        ids = ids.unionByName(kept)
    return numbered.join(ids, "_id", "left_semi")


def ani_simple(hits: DataFrame) -> DataFrame:
    """Mean identity by alignment length, spread over the longer sequence."""
    sums = hits.groupBy("query", "target").agg(
        F.sum(F.col("pident") * F.col("alnlen")).alias("w"), F.sum("alnlen").alias("aln"),
        F.min("qlen").alias("qlen"), F.min("tlen").alias("tlen"))
    ani = F.try_divide(F.col("w"), F.col("aln")) / F.greatest("qlen", "tlen") * F.col("aln")
    return sums.select("query", "target", ani.alias("ANI"))


def nonoverlap_weights(hits: DataFrame, alpha: float = 2.0, identity_scale: float = 1.0) -> DataFrame:
    """Both weights of non-overlapping hits from one scan: (source, target, identity, coverage).

    ``identity`` is the mean identity ** alpha, ``coverage`` that of the shorter sequence.
    """
    needed = ["query", "target", "pident", "alnlen", "qstart", "qend", "qlen", "tlen"]
    kept = greedy_overlap_filter(hits.select(*needed))
    sums = kept.groupBy("query", "target").agg(
        F.sum(F.col("pident") / identity_scale * F.col("alnlen")).alias("w"), F.sum("alnlen").alias("aln"),
        F.min(F.least("qlen", "tlen")).alias("shorter"))
    return sums.select(F.col("query").alias("source"), F.col("target"),
                       F.pow(F.try_divide(F.col("w"), F.col("aln")), F.lit(float(alpha))).alias("identity"),
                       F.try_divide(F.col("aln"), F.col("shorter")).alias("coverage"))


def ani_nonoverlap(hits: DataFrame, alpha: float = 2.0, len_weight: bool = False, min_ani: float = 0.0,
                   identity_scale: float = 1.0) -> DataFrame:
    """Pair weight from non-overlapping hits: mean identity ** alpha, or coverage of the shorter one."""
    weight = F.col("coverage" if len_weight else "identity")
    return nonoverlap_weights(hits, alpha, identity_scale).select(
        "source", "target", F.greatest(weight, F.lit(float(min_ani))).alias("weight"))


def ani_weight(pairs: DataFrame, use_fractions: bool = True) -> DataFrame:
    """Rename sketch-comparison output to edges; identity, weighted by the larger aligned fraction."""
    fraction = F.greatest("Align_fraction_query", "Align_fraction_ref")
    weight = F.col("ANI") * fraction / 10000 if use_fractions else F.col("ANI")
    dropped = ("Ref_file", "Query_file", "Align_fraction_query", "Align_fraction_ref", "ANI", "Query_name", "Ref_name")
    rest = [c for c in pairs.columns if c not in dropped]
    return pairs.select(header_id("Query_name").alias("source"), header_id("Ref_name").alias("target"),
                        weight.alias("weight"), *rest)
