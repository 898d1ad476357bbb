"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key  -ln(u) / quality  with u from its id, so documents of higher quality come earlier and a
retried task draws the same.  A source's target is split into complete epochs, which take every document, and a rest,
which takes documents in key order until their prefix sum of words reaches it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.skew import running_total
from kinweave.sources.staging import broadcast_if_small, materialize

#: Rows of a source that share one bucket of the prefix sum, about.
BUCKET_ROWS = 20_000
BITS = 13 * 4


def word_count(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def uniform(salt: str, *keys: str) -> Column:
    """Number inside (0, 1) that depends on the keys only."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return (F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") + 0.5) / F.lit(float(1 << BITS))


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of a table with one row per source: adds ``weight`` and ``target``.

    Sources take the weights in turn by code point, null last.  ``share`` times all sizes is dealt out by weight; what
    a source would get beyond ``most`` times its size goes to the others by weight until none is above.  Sources in the
    order of size over weight reach their limit one after the other, so the common level follows from two running sums
    over the table of sources; the table has one row per source and none per document.  ``share`` must not exceed
    ``most``.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limited = sources.withColumn("weight", weight).withColumn("_limit", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = F.coalesce(F.sum("_limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    leveled = limited.withColumn("_level", (budget - earlier) / later).withColumn("_place", F.row_number().over(fill))
    # the level of the first source that stays under its limit holds for it and all after it
    free = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.struct("_place", F.col("_level").alias("v")))).over(Window.partitionBy())
    level = free["v"]
    return leveled.withColumn("target", F.when(level.isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), level * F.col("weight")))).drop("_limit", "_level", "_place")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None,
        weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, salt: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken.

    ``size`` counts words, ``taken`` the words that the mix takes, repeats counted.  Every document of a source is
    taken ``epochs`` times; the rest goes to documents in key order, and the document at which it runs out gives as
    many words as are left.  So the words taken of a source are its target rounded down.

    ``quality`` (id, weight) gives the weights of the keys; the highest of several counts, documents without one or with
    none above zero weigh 1.  Null sources are a source of their own.  Documents without words, null texts included,
    take nothing.  Rows with the same id draw the same key and follow one another by size; an empty table gives an
    empty one.  Names of other columns do not matter.

    No task sorts a whole source: keys are cut into buckets of about ``BUCKET_ROWS`` rows, bucket sums give the offsets.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    if quality is not None:
        best = quality.toDF("_id", "_quality").where("_id is not null").groupBy("_id").agg(F.max("_quality").cast("double").alias("_quality"))
        slim = slim.join(best, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    else:
        slim = slim.withColumn("_quality", F.lit(1.0))
    slim = materialize(slim.withColumn("_quality", F.when(F.col("_quality") > 0, F.col("_quality")).otherwise(F.lit(1.0))), "sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    known = (targets(sources, weights, share, most).withColumnRenamed("source", "_source")
             .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
             .withColumn("_rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")))
    known = broadcast_if_small(materialize(known, "targets"))
    rows = slim.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_key", -F.log(uniform(salt, "doc_id")) / F.col("_quality"))
    # grows with the key: the share of the source's keys expected below it
    bucket = F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * F.ceil(F.col("_rows") / BUCKET_ROWS))
    placed = running_total(rows.withColumn("_named", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))), ["_named"],
                           bucket, ["_key", "doc_id", "size"], F.col("size"), "_before")
    fraction = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before"))).cast("bigint")
    return placed.select("doc_id", "source", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "epochs",
                         (F.col("epochs") * F.col("size") + fraction).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that the mix takes, whole, each as many times as it is taken; all columns are kept.

    The document at which a source's rest runs out comes whole.  Rows that share an id are taken as often as the row
    of that id that is taken most.
    """
    taken = mix(docs, id_col, **options).where("taken > 0").groupBy(F.col("doc_id").alias("_taken")).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("_copies"))
    taken = broadcast_if_small(materialize(taken, "taken"))
    return (docs.join(taken, F.col(id_col).eqNullSafe(F.col("_taken")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns]))
