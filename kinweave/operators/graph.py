"""Weighted graphs: cleaning, undirected form, node ids, adjacency, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.columns import pair_high, pair_low, strip_version, to_weight
from kinweave.functions.rng import hash_order
from kinweave.operators.skew import running_total, with_ordinal

WEIGHT_SCALE = 1_000_000_000


def strip_edge_versions(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"source": strip_version("source"), "target": strip_version("target")})


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source <> target")


def canonical_pair(edges: DataFrame) -> DataFrame:
    """Unordered pair key (u, v), u <= v."""
    return edges.withColumns({"u": pair_low("source", "target"), "v": pair_high("source", "target")})


def edge_threshold(edges: DataFrame, threshold: float = 0.1) -> DataFrame:
    return edges.where((F.col("source") < F.col("target")) & (F.col("weight") > threshold))


def minmax_rescale(edges: DataFrame) -> DataFrame:
    """Weights to [0, 1]; a flat column becomes 1 above 0.5 and 0 below; NULL stays NULL."""
    ends = edges.agg(F.struct(F.min("weight").alias("low"), F.max("weight").alias("high"))).scalar()
    low, high = ends.getField("low"), ends.getField("high")
    w = F.col("weight")
    flat = F.when(high > 0.5, 1.0).otherwise(0.0)
    return edges.withColumn("weight", F.when(w.isNotNull(), F.when(
        high - low > 1e-9, F.try_divide(w - low, high - low)).otherwise(flat)))


def undirected_max(edges: DataFrame) -> DataFrame:
    """Largest weight of each unordered pair."""
    return (drop_self_loops(edges).groupBy(pair_low("source", "target").alias("source"),
                                           pair_high("source", "target").alias("target"))
            .agg(F.max("weight").alias("weight")))


def node_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def union_edges(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def symmetrize_with_loops(edges: DataFrame, empty: str = "empty") -> DataFrame:
    """Undirected maximum, its reverse, and one loop per node at the largest weight.

    A table of self-loops only gives loops only.  ``empty='dummy'`` turns an
    empty table into one loop of a placeholder node.
    """
    edges = edges.select("source", "target", to_weight("weight").alias("weight"))
    apart = F.col("source") != F.col("target")
    facts = edges.agg(F.struct(
        F.count(F.when(apart, 1)).alias("pairs"), F.max(F.when(apart, F.col("weight"))).alias("top"),
        F.max("weight").alias("top_loop"), F.count("*").alias("rows"))).scalar()
    n_pairs = facts.getField("pairs")
    weight = F.coalesce(F.when(n_pairs > 0, facts.getField("top")).otherwise(facts.getField("top_loop")), F.lit(0.0))
    nodes = node_set(edges.where(apart | (n_pairs == 0)))
    loops = nodes.select(F.col("node").alias("source"), F.col("node").alias("target"), weight.alias("weight"))
    both = F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target"))))
    out = undirected_max(edges).select(both.alias("e"), "weight").select("e.source", "e.target", "weight").union(loops)
    if empty == "dummy":
        dummy = edges.sparkSession.createDataFrame([("_dummy", "_dummy", 1.0)], out.schema)
        out = out.union(dummy.where(facts.getField("rows") == 0))
    return out


def topk_neighbors(edges: DataFrame, k: int = 50) -> DataFrame:
    """The k heaviest neighbours of each node, without itself: (node, neighbor, weight, rank).

    The rank filter becomes a per-task limit before the shuffle, so a hub sends
    k rows per task only.
    """
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbor"), "weight").union(
        edges.select(F.col("target"), F.col("source"), "weight"))
    best = (both.where("node <> neighbor and weight is not null")
            .groupBy("node", "neighbor").agg(F.max("weight").alias("weight")))
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "neighbor")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def index_nodes(edges: DataFrame, salt: str = "node") -> DataFrame:
    """Dense id of every label: (node, node_id)."""
    return with_ordinal(node_set(edges), ["node"], salt=salt, name="node_id")


def relabel_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges with node ids in place of labels."""
    s = index.select(F.col("node").alias("source"), F.col("node_id").alias("source_id"))
    t = index.select(F.col("node").alias("target"), F.col("node_id").alias("target_id"))
    return edges.join(s, "source").join(t, "target").select("source_id", "target_id", "weight")


def adjacency(edges: DataFrame, node: str = "source", neighbor: str = "target") -> DataFrame:
    """Neighbour lists in long form: position, fixed-point weight and weight before it.

    Columns (node, neighbor, mass, before, degree, total).  Weights become
    integers of 1e-9 of the node's heaviest edge, at least 1, so sums do not depend
    on the order of rows, weights of any size keep their ratio, and every positive
    weight can be drawn.  Hubs are split by ``running_total``.
    """
    best = (edges.select(F.col(node).alias("node"), F.col(neighbor).alias("neighbor"), F.col("weight").cast("double"))
            .where("weight > 0 and not isnan(weight)").groupBy("node", "neighbor").agg(F.max("weight").alias("weight")))
    heaviest = best.groupBy("node").agg(F.max("weight").alias("_heaviest"))
    mass = F.greatest(F.round(F.col("weight") / F.col("_heaviest") * WEIGHT_SCALE), F.lit(1.0)).cast("bigint")
    # dealt out by (node, slot): after a join by node alone a hub would be summed in one task
    rows = (best.join(heaviest, "node").withColumn("_hash", hash_order("adj", "neighbor"))
            .select("node", "neighbor", mass.alias("mass"), "_hash", F.substring("_hash", 1, 2).alias("_slot"))
            .repartition("node", "_slot"))
    placed = running_total(rows, ["node"], F.col("_slot"), ["_hash", "neighbor"], F.col("mass"), "before")
    totals = rows.groupBy("node").agg(F.count("*").alias("degree"), F.sum("mass").alias("total"))
    return placed.join(totals, "node").select("node", "neighbor", "mass", "before", "degree", "total")


def draw_table(adj: DataFrame) -> DataFrame:
    """Adjacency cut into cells of equal mass, for draws by equality join.

    A node of degree d gets up to d cells, so a cell meets two neighbours on
    average and a hub's draws spread over its cells: (node, cell, neighbor, before, mass).
    """
    return adj.select("node", "neighbor", "before", "mass", F.explode(F.sequence(
        cell_of(F.col("before")), cell_of(F.col("before") + F.col("mass") - 1))).alias("cell"))


def cell_of(position):
    return F.floor(position * (F.col("degree") / F.col("total"))).cast("bigint")


def weighted_draw(draws: DataFrame, adj: DataFrame) -> DataFrame:
    """Neighbour for each draw (id, node, u): inverse cumulative weight at u.

    A node without positive weight gives no row.
    """
    totals = adj.select("node", "degree", "total").distinct()
    placed = (draws.join(totals, "node").withColumn("r", F.floor(F.col("u") * F.col("total")).cast("bigint"))
              .withColumn("cell", cell_of(F.col("r"))))
    met = placed.join(draw_table(adj), ["node", "cell"]).where("r >= before and r < before + mass")
    return met.select("id", "node", "neighbor")


def restrict_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in a node table (column ``node``)."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return edges


def semi_filter(df: DataFrame, ids: DataFrame, key: str, id_col: str, negate: bool = False) -> DataFrame:
    """Rows whose key is (or is not) among the ids."""
    return df.join(ids.select(F.col(id_col).alias(key)), key, "left_anti" if negate else "left_semi")


def edge_first_sample(edges: DataFrame, n_nodes: int = 1000, salt: str = "sample") -> DataFrame:
    """Edges in a fixed shuffle until ``n_nodes`` nodes are met.

    A node is met at its earliest edge; the n-th smallest of these positions is
    where the sample ends.
    """
    ranked = edges.withColumn("_hash", hash_order(salt, *edges.columns))
    met = ranked.select("_hash", F.explode(F.array("source", "target")).alias("node"))
    first = met.groupBy("node").agg(F.min("_hash").alias("first"))
    last = first.orderBy("first").limit(n_nodes).agg(F.max("first")).scalar()
    return ranked.where(F.col("_hash") <= last).drop("_hash")


def sample_nodes(edges: DataFrame, n_nodes: int, salt: str = "nodes") -> DataFrame:
    """``n_nodes`` nodes by a fixed shuffle."""
    return (node_set(edges).withColumn("_hash", hash_order(salt, "node"))
            .orderBy("_hash", "node").limit(n_nodes).select("node"))


def induced_subgraph(edges: DataFrame, nodes: DataFrame, meta: DataFrame, level: str) -> DataFrame:
    """Edges inside a node sample with line widths and the taxon of both ends."""
    inside = undirected_max(restrict_edges(edges, nodes))
    top = inside.agg(F.max("weight")).scalar()
    value = F.trim(F.col(level))
    taxa = meta.select(F.col("Accession").alias("node"),
                       F.when(value != "", value).alias("taxon"))

    def side(end):
        return taxa.select(F.col("node").alias(end), F.col("taxon").alias(f"{end}_taxon"))

    joined = inside.join(side("source"), "source", "left").join(side("target"), "target", "left")
    return joined.select("source", "target", "weight", F.try_divide(F.col("weight") * 0.2, top).alias("width"),
                         F.coalesce("source_taxon", F.lit("Unknown")).alias("source_taxon"),
                         F.coalesce("target_taxon", F.lit("Unknown")).alias("target_taxon"))
