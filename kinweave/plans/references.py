"""Reference sets: which records to keep, their lineage, their sequences; scoring of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.metrics import LABEL_RANKS, label_prf, macro_prf, pred_vs_truth
from kinweave.operators.taxonomy import (
    assembly_to_accession, class_by_any_rank, first_per_assembly, head_n_per_group, hierarchical_fill,
)


def class_reference_set(meta: DataFrame, taxonomy: DataFrame, accession_map: DataFrame, n: int = 50) -> DataFrame:
    """At most n assemblies per class, opened to their accessions."""
    classed = class_by_any_rank(meta, taxonomy, unknown=None).where("Class is not null or Genus is not null")
    kept = head_n_per_group(classed, n=n).withColumn("Class", F.coalesce("Class", F.lit("Unknown")))
    return assembly_to_accession(kept, accession_map)


def enriched_metadata(meta: DataFrame, taxonomy: DataFrame, ranks: Sequence[str],
                      fallback: tuple[str, str] | None = None) -> DataFrame:
    """One row per assembly with its lineage filled from the taxonomy."""
    return hierarchical_fill(first_per_assembly(meta), taxonomy, ranks, fallback=fallback)


def prepare_reference_set(meta: DataFrame, taxonomy: DataFrame, accession_map: DataFrame, ranks: Sequence[str],
                          fallback: tuple[str, str] | None = None, n: int = 50) -> DataFrame:
    """The class reference set with the enriched lineage of its assemblies."""
    chosen = class_reference_set(meta.drop("Accession"), taxonomy, accession_map, n).select(
        "Assembly", "Accession", F.col("Class").alias("chosen_class"))
    lineage = enriched_metadata(meta, taxonomy, ranks, fallback).select("Assembly", *ranks)
    return chosen.join(lineage, "Assembly")


def score_predictions(pred: DataFrame, truth: DataFrame, ranks: Sequence[str] = LABEL_RANKS) -> DataFrame:
    """Macro scores per rank over the labels of classified rows."""
    return macro_prf(label_prf(pred_vs_truth(pred, truth, ranks), ranks))
