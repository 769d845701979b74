"""Helpers that several training-data operators use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The white space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: A side of a join is broadcast only when a count has shown that it has no more rows than this.
BROADCAST_ROWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` to a lambda variable, so that `body` can use it many times at the cost of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text in order; null or blank text: an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting, else one of our own (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder: all that it leaves can be deleted with it when the application has ended."""
    return f"{shared_folder(spark)}/orrery-{spark.sparkContext.applicationId}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read back: lineage ends here.

    Lost executors cost nothing: the files are shared, and a failed write task is simply run again.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if a count proves that it has at most `rows` rows, else unchanged (a shuffle join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], size: Column, into: str, rows: int, per_bucket: int = 4_000) -> DataFrame:
    """Add `into`: the sum of `size` over the rows before this one in its group `by`.

    Rows are dealt to buckets by a hash of the order columns; a window runs within (group, bucket)
    and the sums of whole buckets before it are added from a table of bucket totals. So a group
    that holds most of the rows is still spread over many tasks. The order is (bucket, order
    columns): fixed by the rows' values, not by how they are partitioned. Equal rows take turns.
    `rows` is the number of rows of `df`; it sets the number of buckets.
    """
    n = max(1, min(1 << 16, rows // per_bucket + 1))
    dealt = df.withColumns({"_bucket": F.pmod(F.xxhash64(*order), F.lit(n)), "_size": size.cast("long")})
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    before = Window.partitionBy(*by).orderBy("_bucket")
    totals = dealt.groupBy(*by, "_bucket").agg(F.sum("_size").alias("_total"))
    offsets = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_at"), (F.sum("_total").over(before) - F.col("_total")).alias("_offset"))
    local = dealt.withColumn("_run", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    same = F.col("_bucket") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return local.join(offsets, same).withColumn(into, F.col("_run") + F.col("_offset")).select(*df.columns, into)


def clear_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def isolated(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns under names of our own, and those names: helper columns can't clash with them."""
    own = {c: f"_own_{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()]), own


def crc_fold(column: Column, parts: int) -> Column:
    """crc32 of a value as text, modulo `parts`: which fold a row is in."""
    return F.crc32(column.cast(T.StringType()).cast(T.BinaryType())) % parts
