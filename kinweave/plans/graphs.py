"""Hit tables to weighted graphs, and the marker-gene network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.columns import header_id, pair_high, pair_low, strip_version
from kinweave.operators.graph import drop_self_loops, edge_threshold, strip_edge_versions, undirected_max
from kinweave.operators.hits import ani_nonoverlap, ani_weight, best_hit_by_bitscore, hit_threshold_filter
from kinweave.operators.sharing import (
    hallmark_items, hypergeom_edges, hypergeom_edges_legacy, min_occurrence_filter, presence_absence,
)
from kinweave.operators.sketch import aligned_identity_distance, average_distance_matrices, kmer_sets, sequence_slice, sketch_ani
from kinweave.plans.params import WorkflowParams
from kinweave.sources.staging import materialize


def gene_graph(protein_hits: DataFrame, params: WorkflowParams) -> DataFrame:
    """Protein hits to the gene-sharing graph: presence, tested pairs above 0.

    A pair has a best hit if any of its hits passes the thresholds, and presence asks no
    more than that, so the best hit itself is not looked for.
    """
    found = hit_threshold_filter(protein_hits, params.evalue_max, params.bitscore_min)
    pa = presence_absence(found.withColumn("query", strip_version("query")))
    return edge_threshold(hypergeom_edges(pa, params.hypergeom_alpha, params.max_freq, params.weight), 0.0)


def identity_graph(genome_hits: DataFrame, params: WorkflowParams) -> DataFrame:
    """Genome hits to the identity graph, from non-overlapping hits of genomes without their version."""
    bare = genome_hits.withColumns({c: strip_version(c) for c in ("query", "target")})
    return ani_nonoverlap(bare, params.ani_alpha, params.len_weight, params.min_ani, params.identity_scale)


def sketch_graph(genomes: DataFrame, params: WorkflowParams) -> DataFrame:
    """Genomes (id, seq) to the identity graph by shared k-mers: exact sets, pair identity, fraction weight.

    The weight is that of either order, so each pair is formed once; the largest weight of a pair of names is
    looked for only if ids share a name.
    """
    pairs = ani_weight(sketch_ani(kmer_sets(genomes, params.sketch_k), None, params.sketch_k), params.ani_fractions)
    edges = strip_edge_versions(pairs.select("source", "target", "weight"))
    ids = genomes.where("id is not null").select("id").distinct()
    names, n = ids.agg(F.count_distinct(strip_version(header_id("id"))), F.count("*")).first()
    if names < n:
        return undirected_max(edges)
    return drop_self_loops(edges).select(pair_low("source", "target").alias("source"), pair_high("source", "target").alias("target"), "weight")


def build_graphs(protein_hits: DataFrame, genome_hits: DataFrame | None, params: WorkflowParams,
                 genomes: DataFrame | None = None) -> DataFrame:
    """Both graphs in one table (graph, source, target, weight); the identity graph comes from sketches if there are no hits."""
    columns = ["graph", "source", "target", "weight"]
    gene = gene_graph(protein_hits, params).withColumn("graph", F.lit("gene")).select(*columns)
    identity = sketch_graph(genomes, params) if genome_hits is None else identity_graph(genome_hits, params)
    ani = identity.withColumn("graph", F.lit("ani")).select(*columns)
    return gene.unionByName(ani)


def hallmark_network(hits: DataFrame, sequences: DataFrame, bitscore_min: float = 50, min_sets: int = 2,
                     alpha: float = 0.05, top_n: int = 3) -> DataFrame:
    """Genome pairs that share genes, with their mean distance over the marker genes.

    Genes are the queries, genomes the targets of the hits.  The distance is formed
    for pairs of the sharing graph only: (source, target, weight, dist, dist_weight).
    """
    best = materialize(best_hit_by_bitscore(hits, bitscore_min), "best")
    pa = materialize(min_occurrence_filter(presence_absence(best, "target", "query"), min_sets), "presence")
    shared = materialize(hypergeom_edges_legacy(pa, alpha), "shared")
    markers = hallmark_items(pa, top_n).select(F.col("target").alias("query"))
    slices = sequence_slice(best.join(markers, "query", "left_semi"), sequences).where("found")
    aligned = slices.select(F.col("query").alias("gene"), F.col("target").alias("id"), F.col("fragment").alias("seq"))
    pairs = shared.select(F.col("source").alias("a"), F.col("target").alias("b"))
    mean = average_distance_matrices(aligned_identity_distance(aligned, pairs))
    return shared.join(mean.select(F.col("a").alias("source"), F.col("b").alias("target"), "dist",
                                   F.col("weight").alias("dist_weight")), ["source", "target"], "left").select(
        "source", "target", "weight", F.coalesce("dist", F.lit(1.0)).alias("dist"),
        F.coalesce("dist_weight", F.lit(0.0)).alias("dist_weight"))
