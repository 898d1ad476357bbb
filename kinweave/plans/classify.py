"""Label transfer to query genomes and evaluation of a reference database."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.columns import pair_high, pair_low, strip_version
from kinweave.functions.ordinal import argmax
from kinweave.functions.rng import uniform
from kinweave.operators.graph import minmax_rescale, strip_edge_versions, symmetrize_with_loops, union_edges
from kinweave.operators.metrics import confusion_matrix, hierarchical_metrics, interval_hit_point_accuracy
from kinweave.operators.model import (
    TriangleModel, choose_interval_fit, ordinal_interval_fit, predict_rank, triangle_refine,
)
from kinweave.operators.neighbors import classification_report, fuse_embeddings, select_two_neighbors
from kinweave.operators.sharing import hypergeom_edges, merge_presence_absence
from kinweave.operators.skew import with_ordinal
from kinweave.operators.taxonomy import first_by_accession, rank_profile, relationship_bounds, validate_unique_ids
from kinweave.operators.triangles import enough_nodes, sample_triangles, seeded_split, triangle_features
from kinweave.operators.embeddings import node_embeddings
from kinweave.plans.params import WorkflowParams
from kinweave.sources.staging import Stages, materialize, stages_for
from kinweave.sources.writers import write_results


def prepared_graphs(pa: DataFrame, ani_edges: DataFrame, params: WorkflowParams, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Undirected identity and gene-sharing graphs with loops, written once."""
    def identity() -> DataFrame:
        ani = symmetrize_with_loops(strip_edge_versions(ani_edges))
        return minmax_rescale(ani) if params.rescale_ani else ani

    def sharing() -> DataFrame:
        return symmetrize_with_loops(hypergeom_edges(pa, params.hypergeom_alpha, params.max_freq, params.weight))

    return stages.table("ani-graph", identity), stages.table("gene-graph", sharing)


def fused_embeddings(ani: DataFrame, hyp: DataFrame, params: WorkflowParams, stages: Stages) -> DataFrame:
    """Vectors of both graphs side by side; the graphs do not depend on one another, so their jobs run at once."""
    def embed(graph: DataFrame) -> DataFrame:
        return materialize(node_embeddings(graph.where("weight > 0"), params.dim, params.window, params.epochs,
                                           params.walk_length, params.p, params.q, params.walks_per_node, params.seed), "vectors")

    def both() -> DataFrame:
        with ThreadPoolExecutor(2) as pool:
            return fuse_embeddings(*pool.map(embed, (ani, hyp)), params.dim)

    return stages.table("embeddings", both)


def training_pairs(nodes: DataFrame, graphs: list[DataFrame], seed: int, partners_per_node: int = 4) -> DataFrame:
    """Node pairs to learn from: the graphs' edges and a few random partners per node.

    Edges supply related pairs, random partners the unrelated ones; both grow
    with the graph, not with the square of the nodes.
    """
    numbered = with_ordinal(nodes.select("node"), ["node"], salt="partner", digits=3)
    n = nodes.agg(F.count("*")).scalar()
    draws = (numbered.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(partners_per_node - 1))))
             .withColumn("other", F.floor(uniform("ordinal", "t", seed) * n).cast("bigint")))
    partners = draws.join(numbered.select(F.col("node").alias("mate"), F.col("ordinal").alias("other")), "other")
    pairs = partners.select(F.col("node").alias("source"), F.col("mate").alias("target"))
    for graph in graphs:
        pairs = pairs.unionByName(graph.select("source", "target"))
    return pairs.where("source <> target").select(
        pair_low("source", "target").alias("source"), pair_high("source", "target").alias("target")).distinct()


def _rows(nodes, bounds, n, k_classes, seed, emb, ani, hyp, dim, label, stages):
    if label != "train" and not enough_nodes(nodes):
        return None  # too few nodes are held out to form a triangle
    return stages.table(label, lambda: triangle_features(sample_triangles(nodes, bounds, n, k_classes, seed), emb, ani, hyp, dim))


def _fit(train: DataFrame, val: DataFrame | None, k_classes: int, params: WorkflowParams) -> TriangleModel:
    first = ordinal_interval_fit(train, k_classes) if val is None else choose_interval_fit(train, val, k_classes)
    return triangle_refine(train, first, params.gate, params.max_recycles)


def classify_queries(pa: DataFrame, ani_edges: DataFrame, meta: DataFrame, queries: DataFrame,
                     params: WorkflowParams, folder: str | None = None) -> DataFrame:
    """Predict the lineage of query genomes from their nearest references.

    ``pa`` and ``ani_edges`` cover references and queries together, ``queries`` has the
    full accession in ``query``.  Ends in the classification report.  A query accession
    that occurs twice is an error.  With a ``folder`` a run that was broken off is taken up
    where it ended, and one on the same contents and settings that ended is not repeated.
    """
    stages = stages_for(pa.sparkSession, folder, [pa, ani_edges, meta, queries] if folder else [], ("classify", params))
    return stages.result("report", lambda: _classified(pa, ani_edges, meta, queries, params, stages))


def _classified(pa: DataFrame, ani_edges: DataFrame, meta: DataFrame, queries: DataFrame, params: WorkflowParams, stages: Stages) -> DataFrame:
    repeated = validate_unique_ids(queries.select(strip_version("query").alias("id")))
    if not repeated.isEmpty():
        raise ValueError(f"accessions of queries must be unique, e.g. {repeated.first()['id']} is not")
    profile = rank_profile(params.levels)
    ranks = [r for r in sorted(profile, key=profile.get) if r != "NR"]
    k_classes, dim = max(profile.values()) + 1, 2 * params.dim
    ani, hyp = prepared_graphs(pa, ani_edges, params, stages)
    emb = fused_embeddings(ani, hyp, params, stages)
    asked = queries.select(strip_version("query").alias("node")).distinct()
    known = first_by_accession(meta.withColumn("Accession", strip_version("Accession")))
    db_nodes = materialize(known.select(F.col("Accession").alias("node")).distinct().join(
        emb.select("node"), "node", "left_semi").join(asked, "node", "left_anti"), "references")
    known = known.join(db_nodes.withColumnRenamed("node", "Accession"), "Accession", "left_semi")
    pairs = training_pairs(db_nodes, [ani, hyp], params.seed, params.random_partners)
    bounds = stages.table("bounds", lambda: relationship_bounds(pairs, known, ranks))

    split = seeded_split(db_nodes, 0.9, 0.1, min_nodes=20, keep_val=True)
    parts = {}
    for offset, (name, n) in enumerate((("train", params.triangles_train), ("val", params.triangles_eval))):
        nodes = split.where((F.col("split") == "train") == (name == "train")).select("node")
        parts[name] = _rows(nodes, bounds, n, k_classes, params.seed + offset, emb, ani, hyp, dim, name, stages)
    val = None if parts["val"] is None or parts["val"].isEmpty() else parts["val"]
    model = _fit(parts["train"], val, k_classes, params)

    selected = stages.table("selected", lambda: select_two_neighbors(asked.join(emb, "node", "left_semi"), hyp, ani, db_nodes, emb,
                                                                     params.dim, params.neighbors))
    tri = selected.where("r_h is not null and r_a is not null").select(
        F.monotonically_increasing_id().alias("id"), F.col("node").alias("q"), F.col("r_h").alias("r1"),
        F.col("r_a").alias("r2"), *[F.lit(0).alias(c) for c in ("lo1", "up1", "lo2", "up2", "lo3", "up3")])
    tri = materialize(tri, "query-triangles")
    predicted = predict_rank(model, triangle_features(tri, emb, ani, hyp, dim))
    predictions = predicted.join(tri.select("id", F.col("q").alias("node")), "id").drop("id")
    return classification_report(queries, selected, predictions, known, profile, ani, hyp, emb)


def classify_new(reference_pa: DataFrame, query_pa: DataFrame, edge_parts: list[DataFrame], meta: DataFrame,
                 queries: DataFrame, path: str, params: WorkflowParams, folder: str | None = None) -> DataFrame:
    """From the tables of references and of new genomes to the written result table, which is returned as read back.

    ``edge_parts`` are the identity edges among references, among queries and between
    both.  Accessions lose their version before the presence tables are merged.
    """
    bare = [pa.withColumn("query", strip_version("query")) for pa in (reference_pa, query_pa)]
    report = classify_queries(merge_presence_absence(*bare), union_edges(*edge_parts), meta, queries, params, folder)
    write_results(report, path, rank_profile(params.levels))
    return meta.sparkSession.read.option("header", True).csv(path)


def evaluate_database(pa: DataFrame, ani_edges: DataFrame, meta: DataFrame, params: WorkflowParams, folder: str | None = None) -> DataFrame:
    """Train on 80 % of the nodes, report on all splits: accuracy and per-class scores.

    Rows (split, cls, precision, recall, f1, support, spearman_rho, kendall_tau,
    hit_rate, point_accuracy).  ``folder`` as for ``classify_queries``.
    """
    stages = stages_for(pa.sparkSession, folder, [pa, ani_edges, meta] if folder else [], ("evaluate", params))
    return stages.result("scores", lambda: _evaluated(pa, ani_edges, meta, params, stages))


def _evaluated(pa: DataFrame, ani_edges: DataFrame, meta: DataFrame, params: WorkflowParams, stages: Stages) -> DataFrame:
    profile = rank_profile(params.levels)
    ranks = [r for r in sorted(profile, key=profile.get) if r != "NR"]
    k_classes, dim = max(profile.values()) + 1, 2 * params.dim
    ani, hyp = prepared_graphs(pa, ani_edges, params, stages)
    emb = fused_embeddings(ani, hyp, params, stages)
    known = first_by_accession(meta.withColumn("Accession", strip_version("Accession")))
    split = materialize(seeded_split(emb.select("node"), 0.8, 0.1), "split")
    pairs = training_pairs(split.select("node"), [ani, hyp], params.seed, params.random_partners)
    bounds = stages.table("bounds", lambda: relationship_bounds(pairs, known, ranks))
    parts = {}
    for offset, name in enumerate(("train", "val", "test")):
        nodes = split.where(F.col("split") == name).select("node")
        n = params.triangles_train if name == "train" else params.triangles_eval
        parts[name] = _rows(nodes, bounds, n, k_classes, params.seed + offset, emb, ani, hyp, dim, name, stages)
    model = _fit(parts["train"], parts["val"], k_classes, params)
    out = None
    for name, rows in parts.items():
        if rows is None:
            continue
        scored = materialize(model.transform(rows).where("side = 1").select(
            argmax(F.col("probs")).alias("pred"), "lower", "upper"), "scored")
        accuracy = interval_hit_point_accuracy(scored)
        exact = scored.where("lower = upper").withColumn("truth", F.col("lower"))
        table = hierarchical_metrics(confusion_matrix(exact, k_classes), k_classes, profile["NR"]).withColumns({
            "split": F.lit(name), "hit_rate": accuracy.select("hit_rate").scalar(),
            "point_accuracy": accuracy.select("point_accuracy").scalar()})
        out = table if out is None else out.unionByName(table)
    return out
