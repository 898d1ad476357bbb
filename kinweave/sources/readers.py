"""Readers: sequence records, hit tables, edge lists, metadata, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.columns import strip_version, to_weight

# The column order of the hit-table formats.
HIT_FIELDS_12 = (
    ("query", "string"), ("target", "string"), ("pident", "double"), ("alnlen", "int"),
    ("mismatch", "int"), ("numgapopen", "int"), ("qstart", "int"), ("qend", "int"),
    ("tstart", "int"), ("tend", "int"), ("evalue", "double"), ("bitscore", "double"),
)
HIT_FIELDS_14 = HIT_FIELDS_12 + (("qlen", "int"), ("tlen", "int"))
EDGE_LIST_FIELDS = (("query", "string"), ("target", "string"), ("qstart", "int"), ("qend", "int"))

# Accepted names of the three edge columns, first match wins.
SOURCE_NAMES = ("query", "source")
TARGET_NAMES = ("target", "subject")
WEIGHT_NAMES = ("ani", "ANI", "pident", "identity")


def _text_schema(fields) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name, _ in fields])


def _positional(spark: SparkSession, path: str, fields) -> DataFrame:
    raw = spark.read.schema(_text_schema(fields)).option("sep", "\t").option("quote", "").csv(path)
    return raw.select(*[F.col(n) if t == "string" else F.col(n).try_cast(t).alias(n) for n, t in fields])


def read_m8_12(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 12-column hit table; rows without a numeric identity are dropped."""
    return _positional(spark, path, HIT_FIELDS_12).dropna(subset=["pident"])


def read_m8_14(spark: SparkSession, path: str) -> DataFrame:
    """Headerless hit table with query and target lengths; blank lines are skipped."""
    return _positional(spark, path, HIT_FIELDS_14).dropna(subset=["pident"])


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Headerless (query, target, qstart, qend) file, reduced to its pair columns."""
    return _positional(spark, path, EDGE_LIST_FIELDS).select("query", "target")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of accessions and rank columns; every column stays text."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumn("Accession", F.col("Accession").cast("string"))


def read_weighted_edges(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Header edge file; the first known alias of each column is taken."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return rename_edge_columns(df).withColumn("weight", to_weight("weight"))


def rename_edge_columns(df: DataFrame) -> DataFrame:
    renames = {}
    for names, wanted in ((SOURCE_NAMES, "source"), (TARGET_NAMES, "target"), (WEIGHT_NAMES, "weight")):
        found = next((n for n in names if n in df.columns), None)
        if found is not None and found != wanted:
            renames[found] = wanted
    return df.withColumnsRenamed(renames)


def _record_columns(text):
    """(id, description, seq) of one record's text without its leading '>'."""
    header = F.regexp_extract(text, r"\A([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"\A[^\n]*", ""), r"[ \r\n]", "")
    description = F.rtrim(F.regexp_replace(header, r"\r", ""))
    return F.regexp_extract(description, r"\A(\S*)", 1), description, body


def _records(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    reader = spark.read.option("lineSep", "\n>")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.text(path)


def read_fasta(spark: SparkSession, path: str, first_by_base_id: bool = False) -> DataFrame:
    """FASTA text as rows (id, description, seq), one record per row.

    The record separator is the text source's line separator, so large files are
    split between tasks.  With ``first_by_base_id`` one record stays per
    version-free id: the one earliest by file and offset.
    """
    raw = _records(spark, path)
    text = F.regexp_replace(F.col("value"), r"\A>", "")
    record_id, description, seq = _record_columns(text)
    out = raw.select(record_id.alias("id"), description.alias("description"), seq.alias("seq"),
                     F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o"),
                     F.monotonically_increasing_id().alias("_n")).where("id <> ''")
    if not first_by_base_id:
        return out.select("id", "description", "seq")
    best = out.groupBy(strip_version("id").alias("base")).agg(
        F.min_by(F.struct("id", "description", "seq"), F.struct("_f", "_o", "_n")).alias("r"))
    return best.select("r.id", "r.description", "r.seq")


def merge_record_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """First record of every file in a folder; its id is the file name's stem.

    Only the first record of a file keeps its leading '>' when the separator is
    cut out, which marks it without reading a file as a whole.  Files without a
    record give no row.
    """
    raw = _records(spark, path, recursive).where(F.col("value").startswith(">"))
    _, _, seq = _record_columns(F.substr(F.col("value"), F.lit(2)))
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"\A(.*?)(\.[^.]*)?\z", 1).alias("id"),
                      F.lit("").alias("description"), seq.alias("seq"))


def read_distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Labelled wide matrix (TSV, first column is the row name) as (a, b, dist)."""
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    name, *columns = wide.columns
    return (wide.unpivot([name], columns, "b", "dist")
            .select(F.col(name).alias("a"), "b", F.col("dist").try_cast("double").alias("dist"))
            .where("dist is not null"))
