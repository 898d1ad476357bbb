"""Scalar column functions: ids, unknown tokens, weights, pair keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens each step of the workflow reads as "unknown".
RELATION_UNKNOWN = ("Unknown", "")
RECONCILE_UNKNOWN = ("", "nan", "na", "unknown")
ENRICH_UNKNOWN = ("", "unknown", "unclassified", "none", "<na>", "na", "null", "nan")
LABEL_UNKNOWN = ("", "Unknown", "unclassified", "Unclassified")
ASSEMBLY_UNKNOWN = ("", "NA", "na", "None", "none")
UNCLASSIFIED = "Unclassified"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_version(c: Column | str) -> Column:
    """Accession without its version: the text before the first dot."""
    return F.split_part(col(c), F.lit("."), F.lit(1))


def header_id(c: Column | str) -> Column:
    """First space-separated token of a record header."""
    return F.split_part(col(c), F.lit(" "), F.lit(1))


def known_relation_rank(c: Column | str) -> Column:
    """Rank value for pair comparison; case-sensitive unknown tokens become NULL."""
    c = col(c)
    return F.when(~c.isin(*RELATION_UNKNOWN), c)


def known_reconcile_value(c: Column | str) -> Column:
    """Rank value for label transfer; kept unchanged, unknown becomes NULL."""
    c = col(c)
    return F.when(~F.lower(F.trim(c)).isin(*RECONCILE_UNKNOWN), c)


def known_enrich_value(c: Column | str) -> Column:
    """Rank value for lineage lookups: trimmed and lower-cased, unknown becomes NULL."""
    cleaned = F.lower(F.trim(col(c)))
    return F.when(~cleaned.isin(*ENRICH_UNKNOWN), cleaned)


def label_or_unclassified(c: Column | str) -> Column:
    """Label for scoring: trimmed, every unknown form becomes ``Unclassified``."""
    cleaned = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(cleaned.isin(*LABEL_UNKNOWN), F.lit(UNCLASSIFIED)).otherwise(cleaned)


def known_assembly(c: Column | str) -> Column:
    """Assembly id, blank and NA forms become NULL."""
    c = col(c)
    return F.when(~c.isin(*ASSEMBLY_UNKNOWN), c)


def to_weight(c: Column | str, default: float | None = None) -> Column:
    """Numeric weight; text that is no number becomes NULL, or ``default``."""
    w = col(c).cast("string").try_cast("double")
    w = F.when(~F.isnan(w), w)
    return w if default is None else F.coalesce(w, F.lit(float(default)))


def pair_low(a: Column | str, b: Column | str) -> Column:
    return F.least(col(a), col(b))


def pair_high(a: Column | str, b: Column | str) -> Column:
    return F.greatest(col(a), col(b))


def clip_class(c: Column | str, k_classes: int, nr_code: int = 0) -> Column:
    """Bound code outside the class range becomes the no-relationship code."""
    c = col(c)
    return F.when(c >= F.lit(k_classes), F.lit(nr_code)).otherwise(c)


def first_half(c: Column | str, dim: int) -> Column:
    return F.slice(col(c), 1, dim)


def second_half(c: Column | str, dim: int) -> Column:
    return F.slice(col(c), dim + 1, dim)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)
