"""Session defaults and tables that end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """A session with adaptive plans, UTC and Kryo; `settings` use __ for dots."""
    builder = SparkSession.builder.master(master).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found.rstrip("/")


def settled(df: DataFrame, name: str, parts: Sequence[str] = ()) -> DataFrame:
    """`df` as a Parquet table in the shared folder: loops over it neither recompute nor depend on executors. The
    folder has the application's name and can be deleted when that has ended. `parts`: columns to be folders of."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/orrery-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path) if parts else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
