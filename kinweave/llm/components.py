"""Connected components of a link table that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.sources.staging import materialize


def component_labels(links: DataFrame) -> DataFrame:
    """Label every node of ``links`` (columns a, b) with one node of its component: (node, label).

    Every round each node joins the neighbour of least priority (a hash that changes by round, so chains shrink by a
    constant share whatever the ids are), links are moved to the joined nodes and made distinct.  A round is two
    map-side combined aggregates and equality joins; its tables are written to the shared folder, so the lineage stays
    one round long and a lost executor costs one round.  No link: an empty table.
    """
    links = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    turn = 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: E731,B023
        step = materialize(both.groupBy("a").agg(F.min(rank("b")).alias("m"))
                           .select(F.col("a").alias("from"), F.least(rank("a"), F.col("m"))["n"].alias("to")), "hook")
        moved = (links.join(step.select(F.col("from").alias("a"), F.col("to").alias("x")), "a")
                 .join(step.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
                 .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        links = materialize(moved, "links")
        labels = materialize(labels.join(step.select(F.col("from").alias("label"), "to"), "label", "left")
                             .select("node", F.coalesce("to", "label").alias("label")), "labels")
        turn += 1
    return labels
