"""Pages by count and by bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page(rows: DataFrame, order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """A page, with has_more from one row beyond it."""
    probe = rows.orderBy(*order).offset(offset).limit(limit + 1)
    rank = F.row_number().over(Window.orderBy(*order))
    return probe.withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).withColumn("_n", rank).filter(F.col("_n") <= limit).drop("_n")


def page_by_bytes(rows: DataFrame, order: Sequence[str], text: str, budget: int, reserve: int = 2000, offset: int = 0) -> DataFrame:
    """Rows in order for as long as the sum of (bytes + 1) stays within budget - reserve; the first always.

    An answer has at most budget - reserve rows, so no more are sorted into one task.
    """
    room = max(budget - reserve, 1)
    window = Window.orderBy(*order)
    first = rows.orderBy(*order).offset(offset).limit(room + 1)
    sized = first.withColumn("used", F.sum(F.octet_length(text).cast("long") + 1).over(window.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(window))
    return sized.filter((F.col("_n") == 1) | (F.col("used") <= room)).drop("_n")
