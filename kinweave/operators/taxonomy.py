"""Lineage tables: enrichment, class lookup, assemblies, relationship bounds, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.columns import (
    known_assembly, known_enrich_value, known_reconcile_value, known_relation_rank, strip_version,
)
from kinweave.operators.hits import keep_first
from kinweave.operators.skew import first_by, running_total

LOOKUP_KEYS = ("Species", "Genus", "Family")
PIECE_CHARS = 1 << 26


def rank_profile(levels: dict[str, bool]) -> dict[str, int]:
    """Enabled levels in listed order as codes 0, 1, ..."""
    return {name: code for code, name in enumerate(n for n, on in levels.items() if on)}


def rank_profile_table(spark, profile: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(sorted(profile.items(), key=lambda x: x[1]), "level string, code int")


def enrich_by_genus_family(meta: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Add taxonomy columns by genus; rows with a family but no genus take them by family.

    Only the first taxonomy row of a genus (or family) can win, so the taxonomy
    is reduced to one row per key and the row count stays.  The taxonomy's family
    goes before the row's own.
    """
    extra = [c for c in taxonomy.columns if c not in ("Species", "Genus", "Family", "row_no") and c not in meta.columns]
    by_genus = keep_first(taxonomy.where("Genus is not null"), ["Genus"]).select(
        "Genus", F.col("Family").alias("_family"), *extra)
    by_family = keep_first(taxonomy.where("Family is not null"), ["Family"]).select("Family", *extra)
    rows = meta.withColumns({"Genus": F.coalesce("Genus", F.lit("Unknown")),
                             "Family": F.coalesce("Family", F.lit("Unknown"))})
    family_only = (F.col("Family") != "Unknown") & (F.col("Genus") == "Unknown")
    rest = (rows.where(~family_only).join(by_genus, "Genus", "left")
            .withColumn("Family", F.coalesce("_family", "Family")).drop("_family"))
    out = rest.select(*meta.columns, *extra).unionByName(
        rows.where(family_only).join(by_family, "Family", "left").select(*meta.columns, *extra))
    return keep_first(out, ["Accession"])


def _clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: known_enrich_value(c) for c in columns if c in df.columns})


def hierarchical_fill(meta: DataFrame, taxonomy: DataFrame, ranks: Sequence[str],
                      keys: Sequence[str] = LOOKUP_KEYS, fallback: tuple[str, str] | None = None) -> DataFrame:
    """Fill unknown ranks from a taxonomy, most specific key first.

    ``ranks`` run general to specific.  For each key the first known value per
    target at the same or a more general level is one aggregated column, so all
    targets of a key are filled by one left join.  ``fallback`` = (level, taxon)
    fills what is left at that level and above; the rest becomes 'Unknown'.
    """
    tax = _clean(taxonomy, ranks)
    out = _clean(meta, ranks)
    for rank in ranks:
        if rank not in out.columns:
            out = out.withColumn(rank, F.lit(None).cast("string"))
    for key in [k for k in keys if k in meta.columns and k in ranks]:
        targets = list(ranks[:list(ranks).index(key)])
        if not targets:
            continue
        found = tax.where(F.col(key).isNotNull()).groupBy(key).agg(
            *[F.min_by(t, F.when(F.col(t).isNotNull(), F.col("row_no"))).alias(f"_{t}") for t in targets])
        out = out.join(found, key, "left").withColumns({t: F.coalesce(t, f"_{t}") for t in targets}).drop(
            *[f"_{t}" for t in targets])
    if fallback is not None:
        out = lineage_fallback(out, taxonomy, ranks, *fallback)
    extra = [r for r in ranks if r not in meta.columns]
    return out.withColumns({r: F.coalesce(r, F.lit("Unknown")) for r in ranks}).select(*meta.columns, *extra)


def lineage_fallback(meta: DataFrame, taxonomy: DataFrame, ranks: Sequence[str], level: str, taxon: str) -> DataFrame:
    """Fill NULLs at ``level`` and above from the first taxonomy row of one taxon."""
    if level not in ranks:
        return meta
    fill = list(ranks[:list(ranks).index(level) + 1])
    reference = _clean(taxonomy, ranks).where(F.col(level) == taxon.strip().lower())
    lineage = reference.agg(F.min_by(F.struct(*fill), "row_no")).scalar()
    return meta.withColumns({r: F.coalesce(F.col(r), lineage.getField(r)) for r in fill})


def class_by_any_rank(meta: DataFrame, taxonomy: DataFrame, unknown: str | None = "Unknown") -> DataFrame:
    """Class by family, else genus, else species; the last taxonomy row of a key wins."""
    out = meta
    for key in ("Family", "Genus", "Species"):
        last = taxonomy.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.max_by("Class", "row_no").alias(f"_{key}"))
        out = out.join(last, key, "left")
    value = F.coalesce("_Family", "_Genus", "_Species", *([F.lit(unknown)] if unknown else []))
    return out.select(*meta.columns, value.alias("Class"))


def head_n_per_group(rows: DataFrame, group: str = "Class", fallback_group: str = "Genus", n: int = 50,
                     order: str = "row_no") -> DataFrame:
    """First n rows per group, and the first n one-per-genus rows of those without a group."""
    position = Window.partitionBy(group).orderBy(order)
    known = rows.where(F.col(group).isNotNull()).withColumn("_n", F.row_number().over(position)).where(
        F.col("_n") <= n).drop("_n")
    loose = keep_first(rows.where(F.col(group).isNull() & F.col(fallback_group).isNotNull()), [fallback_group], order)
    return known.unionByName(loose.orderBy(order).limit(n))


def assembly_to_accession(assemblies: DataFrame, accession_map: DataFrame) -> DataFrame:
    """One row per accession of an assembly; assemblies without one stay."""
    return assemblies.join(accession_map, "Assembly", "left")


def validate_unique_ids(records: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that occur more than once, with their counts; empty if all is well."""
    return records.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def concat_by_group(meta: DataFrame, sequences: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Sequences of an assembly concatenated in row order under its first accession.

    Rows (id, assembly, n_parts, piece, seq).  Rows without an assembly, or alone
    in it, pass unchanged.  A record longer than ``piece_chars`` comes out as
    consecutive pieces (joined in order they are the record), so no task ever
    builds an unbounded string.
    """
    rows = meta.select(
        "Accession", "row_no", known_assembly("Assembly").alias("assembly"),
        strip_version("Accession").alias("base"))
    rows = rows.withColumn("grp", F.coalesce(F.concat(F.lit("A|"), "assembly"), F.concat(F.lit("R|"), "Accession")))
    seqs = sequences.select(strip_version("id").alias("base"), F.col("id").alias("record"), "seq")
    parts = rows.join(seqs, "base")
    heads = parts.groupBy("grp").agg(F.min_by("record", "row_no").alias("id"), F.count("*").alias("n_parts"),
                                     F.first("assembly").alias("assembly"))
    placed = running_total(parts.select("grp", "row_no", "seq"), ["grp"], F.floor(F.col("row_no") / 100_000),
                           ["row_no"], F.length("seq").cast("bigint"), "before")
    pieces = placed.groupBy("grp", F.floor(F.col("before") / piece_chars).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "seq"))), lambda x: x["seq"]), "")
        .alias("seq"))
    return pieces.join(heads, "grp").select("id", "assembly", "n_parts", "piece", "seq")


def first_per_assembly(meta: DataFrame) -> DataFrame:
    """Metadata with one row per assembly; rows without one all stay."""
    key = F.coalesce(F.concat(F.lit("A|"), known_assembly("Assembly")), F.concat(F.lit("R|"), "Accession"))
    return keep_first(meta.withColumn("_key", key), ["_key"]).drop("_key")


def merge_datasets(seqs1: DataFrame, meta1: DataFrame, seqs2: DataFrame, meta2: DataFrame
                   ) -> tuple[DataFrame, DataFrame]:
    """Two (sequences, metadata) pairs as one; the first occurrence of an accession wins.

    Only columns both metadata tables have are kept, and only rows whose
    accession has a sequence.  Sequences carry ``row_no`` for their file order.
    """
    seqs = seqs1.withColumn("part", F.lit(1)).unionByName(seqs2.withColumn("part", F.lit(2)))
    seqs = (seqs.withColumn("base", strip_version("id")).groupBy("base")
            .agg(F.min_by(F.struct("id", "seq"), F.struct("part", "row_no")).alias("r"))
            .select("base", "r.id", "r.seq"))
    shared = [c for c in meta1.columns if c in meta2.columns]
    rows = meta1.select(*shared).withColumn("_part", F.lit(1)).unionByName(
        meta2.select(*shared).withColumn("_part", F.lit(2)))
    rows = rows.join(seqs.select(F.col("base").alias("Accession")), "Accession", "left_semi")
    kept = rows.groupBy("Accession").agg(
        F.min_by(F.struct(*[c for c in shared if c != "Accession"]), F.struct("_part", "row_no")).alias("r"))
    return seqs.drop("base"), kept.select("Accession", *[F.col(f"r.{c}").alias(c) for c in shared if c != "Accession"])


def first_by_accession(meta: DataFrame, id_col: str = "Accession", columns: Sequence[str] | None = None) -> DataFrame:
    """One metadata row per accession: the first by ``row_no``, or the least where rows are not numbered."""
    order = [F.col("row_no")] if "row_no" in meta.columns else []
    wanted = meta if columns is None else meta.select(id_col, *[c for c in meta.columns if c in (*columns, "row_no") and c != id_col])
    return first_by(wanted, [id_col], order)


# --- relationship bounds -------------------------------------------------------------------

def bound_columns(ranks: Sequence[str], left: str = "l_", right: str = "r_") -> tuple[Column, Column]:
    """(lower, upper) codes of two lineages, ranks general to specific, 0 = no relationship.

    Upper is the last rank before the first one known on both sides and
    different; lower is the last rank before it known on both sides.
    """
    lower, upper = F.lit(0), F.lit(0)
    differs = F.lit(False)
    for code, rank in enumerate(ranks, start=1):
        a, b = F.col(left + rank), F.col(right + rank)
        both = a.isNotNull() & b.isNotNull()
        differs = differs | (both & (a != b))
        lower = F.when(both & ~differs, code).otherwise(lower)
        upper = F.when(~differs, code).otherwise(upper)
    return lower, upper


def relationship_bounds(pairs: DataFrame, meta: DataFrame, ranks: Sequence[str], drop_nr: bool = False,
                        id_col: str = "Accession") -> DataFrame:
    """Relationship bounds of node pairs: (source, target, lower, upper).

    All pairs of n nodes would be n * n / 2 rows; nothing downstream needs them, so
    the lineages are joined to the pairs in question (edges, triangle sides, draws)
    and the work grows with these.  Of rows that share an accession the first counts.
    """
    known = first_by_accession(meta, id_col, ranks).select(id_col, *[known_relation_rank(r).alias(r) for r in ranks])

    def side(end: str, prefix: str) -> DataFrame:
        return known.select(F.col(id_col).alias(end), *[F.col(r).alias(prefix + r) for r in ranks])

    met = pairs.join(side("source", "l_"), "source").join(side("target", "r_"), "target")
    lower, upper = bound_columns(ranks)
    out = met.select("source", "target", lower.alias("lower"), upper.alias("upper"))
    return out.where("not (lower = 0 and upper = 0)") if drop_nr else out


# --- label transfer ------------------------------------------------------------------------

def reconcile_taxonomy(calls: DataFrame, meta: DataFrame, profile: dict[str, int], nr_level: str = "NR") -> DataFrame:
    """Ranks of a query from its primary reference down to the effective rank.

    ``calls`` has (primary, secondary, effective_rank).  An unknown value of the
    primary stays blank; only the NR level falls back to the secondary.  Of rows that
    share an accession the first counts, so each call gives one row.
    """
    levels = sorted(profile, key=profile.get)
    meta = first_by_accession(meta, "Accession", levels)

    def side(key: str, prefix: str) -> DataFrame:
        values = [(known_reconcile_value(lvl) if lvl in meta.columns else F.lit(None).cast("string"))
                  .alias(prefix + lvl) for lvl in levels]
        return meta.select(F.col("Accession").alias(key), *values)

    joined = calls.join(side("primary", "_p_"), "primary", "left").join(side("secondary", "_s_"), "secondary", "left")
    out = []
    for lvl in levels:
        value = F.coalesce(f"_p_{lvl}", f"_s_{lvl}") if lvl == nr_level else F.col(f"_p_{lvl}")
        out.append(F.when(F.col("effective_rank") >= profile[lvl], F.coalesce(value, F.lit(""))).otherwise("")
                   .alias(lvl))
    return joined.select(*calls.columns, *out)
