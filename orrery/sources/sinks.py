"""Sinks of entity tables: partition overwrites, snapshots, backfill and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import settled


def bucketed_files(df: DataFrame, column: str = "path", buckets: int = 64) -> DataFrame:
    """Rows with `part`, a hash of the file: the unit that an incremental run rewrites."""
    return df.withColumn("part", F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int"))


def write_entities(df: DataFrame, path: str, partitions: Sequence[str] = ("part",)) -> None:
    """Replace the partitions that `df` has rows of; others stay. Rows of a partition are written by one task each."""
    df.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def replace_files(stored: DataFrame, fresh: DataFrame, changed: DataFrame, column: str = "path", buckets: int = 64) -> DataFrame:
    """The partitions that changed files touch, with their rows of those files replaced: what write_entities() then writes.

    `buckets` must be what the stored table was written with. A partition that loses all its rows has none here: write_changes()
    deletes it.
    """
    parts = bucketed_files(changed.select(column).distinct(), column, buckets)
    touched = stored.join(parts.select("part").distinct(), "part", "left_semi").join(changed.select(column).distinct(), column, "left_anti")
    return touched.unionByName(bucketed_files(fresh, column, buckets))


def write_changes(spark: SparkSession, path: str, fresh: DataFrame, changed: DataFrame, column: str = "path", buckets: int = 64) -> None:
    """The stored table at `path` with the rows of changed files replaced by `fresh`, whose columns it has; partitions that lose all
    their rows go. Only touched partitions are read and written."""
    stored = spark.read.parquet(path)
    new = settled(replace_files(stored, fresh, changed, column, buckets).select(*stored.columns), "sink-new")
    write_entities(new, path)
    touched = bucketed_files(changed.select(column).distinct(), column, buckets).select("part").distinct()
    empty = [r["part"] for r in touched.join(new.select("part").distinct(), "part", "left_anti").collect()]  # at most `buckets`
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())  # type: ignore[union-attr]
    for part in empty:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"part={part}"), True)  # type: ignore[union-attr]
    spark.catalog.refreshByPath(path)


def missing_content(files: DataFrame, contents: DataFrame, key: str = "file_id") -> DataFrame:
    """Files that have no content row yet: to be read again."""
    return files.join(contents.select(key), key, "left_anti")


def within_size(contents: DataFrame, most: int = 256 << 20) -> DataFrame:
    """Contents of at most `most` bytes; larger ones come without text."""
    return contents.withColumn("content", F.when(F.octet_length("content") <= most, F.col("content")))


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """All tables into one folder, each as a whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of a snapshot."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def repositories(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of several repositories, with their alias in `repo`."""
    out = None
    for alias, df in sorted(tables.items()):
        own = df.withColumn("repo", F.lit(alias))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no repositories")
    return out


def repository_stats(tables: DataFrame) -> DataFrame:
    """(repo, rows), by alias."""
    return tables.groupBy("repo").agg(F.count("*").alias("rows")).orderBy("repo")


def enrichment_candidates(procedures: DataFrame, enriched: DataFrame) -> DataFrame:
    """Procedures that have no enrichment yet."""
    return procedures.join(enriched.select("proc_key"), "proc_key", "left_anti")


def drifted(before: dict[str, int], now: dict[str, int], factor: float = 1.5, least: int = 1000) -> list[str]:
    """Tables whose row counts moved so far that their statistics should be computed again."""
    return sorted(n for n, c in now.items() if c >= least and (before.get(n, 0) == 0 or max(c, before[n]) / max(1, min(c, before[n])) >= factor))


def analyze(spark: SparkSession, tables: Sequence[str]) -> None:
    """Statistics of catalog tables for the optimizer."""
    for name in tables:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
