"""Regular-expression search with context, limits and byte budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.text import has_match, lines

#: Most bytes of lines in one answer.
BYTES = 1 << 20


def hits(files: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(path, line, text): matching lines, 1-based. Whole files without a match are rejected before lines are made."""
    found = files.filter(F.col("content").isNotNull() & has_match(F.col("content"), pattern, ignore_case))
    rows = found.select("path", F.posexplode(lines(F.col("content"))).alias("at", "text"))
    return rows.filter(has_match(F.col("text"), pattern, ignore_case)).select("path", (F.col("at") + 1).cast("long").alias("line"), "text")


def limited(found: DataFrame, limit: int) -> DataFrame:
    """The first hits by path and line, with `truncated`: the limit was reached, even if nothing is left."""
    top = found.orderBy("path", "line").limit(limit)
    return top.withColumn("truncated", F.count("*").over(Window.partitionBy()) >= limit)


def within_bytes(found: DataFrame, most: int = BYTES, partitions: int = 0) -> DataFrame:
    """Hits by path and line for as long as their bytes fit; the running total is kept in two levels: per path, then over the
    totals of the paths."""
    own = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    sized = found.withColumn("bytes", F.octet_length("text").cast("long"))
    totals = sized.groupBy("path").agg(F.sum("bytes").alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(Window.orderBy("path")) - F.col("_total")).filter(F.col("_before") < most).drop("_total")
    return sized.withColumn("_own", F.sum("bytes").over(own)).join(before, "path").withColumn("running", F.col("_before") + F.col("_own")).filter(F.col("running") <= most).drop("_own", "_before")


def with_context(files: DataFrame, found: DataFrame, around: int) -> DataFrame:
    """(path, line, text, is_hit): hits and up to `around` lines on either side, each line once.

    The lines around a hit are generated from the hit, so the join with the file's lines is on equality.
    """
    near = found.select("path", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("line") - around), F.col("line") + around)).alias("line"), F.col("line").alias("_hit"))
    near = near.groupBy("path", "line").agg(F.max(F.col("_hit") == F.col("line")).alias("is_hit"))
    own = files.join(found.select("path").distinct(), "path", "left_semi")
    rows = own.select("path", F.posexplode(lines(F.col("content"))).alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line"), "text")
    return rows.join(near, ["path", "line"]).select("path", "line", "text", "is_hit")


def compact(found: DataFrame) -> DataFrame:
    """(path, hits): for each path the sorted distinct `N: line` entries, joined by newlines."""
    entry = F.struct(F.col("line"), F.concat(F.col("line").cast("string"), F.lit(": "), F.col("text")).alias("t"))
    return found.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_set(entry)), lambda x: x["t"]), "\n").alias("hits"))


def bodies(entities: DataFrame, pattern: str, first: int = 3, ignore_case: bool = False) -> DataFrame:
    """(id, name, lines, match_count): absolute numbers of the first matching lines of each body; the count only if there are
    more."""
    found = entities.filter(has_match(F.col("body"), pattern, ignore_case))
    flags = "(?miu)" if ignore_case else "(?m)"
    at = F.filter(F.transform(lines(F.col("body")), lambda x, i: F.when(x.rlike(flags + pattern), F.col("line_start") + i)), lambda x: x.isNotNull())
    rows = found.withColumn("_at", at)
    return rows.select("id", "name", F.array_join(F.slice("_at", 1, first).cast("array<string>"), ",").alias("lines"), F.when(F.size("_at") > first, F.size("_at")).cast("long").alias("match_count"))


def unreadable(files: DataFrame) -> DataFrame:
    """One row: number of files whose content is missing though they aren't oversize."""
    return files.agg(F.count_if(F.col("content").isNull() & ~F.col("oversize")).alias("files_unreadable"))
