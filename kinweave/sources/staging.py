"""Shared scratch folder, materialised stages and stage reuse."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where that is unset, a folder below the session's warehouse, which all executors of a session share, is set as
    checkpoint directory and used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/kinweave-scratch"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: What ``materialize`` wrote since each open ``scratch_scope`` began.
_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/kinweave-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and go on from the written table.

    Cuts the lineage like a reliable checkpoint, but computes the stage once.
    """
    return materialize_at(df, label)[0]


def materialize_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the path, for ``remove_stage`` once nothing reads the table any more."""
    path = scratch_path(df.sparkSession, label)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def broadcast_if_small(table: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Mark a written table of a few narrow columns for broadcast if its row count allows it.

    Beyond ``max_rows`` the join stays a shuffle join.
    """
    return F.broadcast(table) if table.count() <= max_rows else table


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stage_exists(spark: SparkSession, path: str) -> bool:
    """True if a finished, non-empty stage lies at ``path``."""
    fs, target = _hadoop_path(spark, path)
    jvm = spark.sparkContext._jvm
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")):
        return False
    return fs.getContentSummary(target).getLength() > 0


def remove_stage(spark: SparkSession, path: str) -> None:
    """Delete a written stage that no table is read from any more."""
    fs, target = _hadoop_path(spark, path)
    fs.delete(target, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the session delete the shuffle files of jobs that are done; else they stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what ``materialize`` writes inside when the block ends; no table that reads it may be used after."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove_stage(spark, path)


def content_key(tables: list[DataFrame], settings: object) -> str:
    """Name for the contents of tables, in any order of rows, and for settings: count, sum and xor of the rows' hashes."""
    parts = [repr(settings)]
    for t in tables:
        h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(t.columns)]).alias("h")
        parts.append(f"{sorted(t.dtypes)} {t.select(h).agg(F.count('*'), F.sum(F.col('h').cast('decimal(38,0)')), F.bit_xor('h')).first()}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]


class Stages:
    """Results of one workflow on one content, below a folder: a rerun goes on from those that are finished.

    ``folder`` may be shared by many workflows and contents; ``key`` keeps them apart (``content_key``).  What a stage writes
    on its way is deleted as soon as the stage is written.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.path, self.named = spark, f"{folder.rstrip('/')}/{key}", []

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage ``name``, built and written if it is not there."""
        path = f"{self.path}/{name}"
        self.named.append(path)
        if not stage_exists(self.spark, path):
            with scratch_scope(self.spark):
                build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def result(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """As ``table``, and its readers were the last of all other stages, which are deleted.  A finished result builds nothing."""
        out = self.table(name, build)
        for path in self.named:
            if path != f"{self.path}/{name}":
                remove_stage(self.spark, path)
        return out


def stages_for(spark: SparkSession, folder: str | None, tables: list[DataFrame], settings: object) -> Stages:
    """Stages below ``folder`` that a later run on the same content finds again, or below a scratch folder of their own."""
    return Stages(spark, folder, content_key(tables, settings)) if folder else Stages(spark, scratch_path(spark, "stages"), "own")


def stage_if_absent(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """Reuse the stage at ``path``; build and write it if absent, empty or forced."""
    if force or not stage_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
