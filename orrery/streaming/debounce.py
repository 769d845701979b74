"""Debounced change batches: events of a path wait for silence, then the last one counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from orrery.operators.merge import delete_keys, latest, upsert

#: Seconds of silence that end a batch, the longest that it may last, and the events from which a full pass is made.
GAP, LONGEST, BULK = 1.5, 30.0, 8_000


def batches(events: DataFrame, keys: list[str], gap_seconds: float, longest_seconds: float | None = None, ts: str = "ts", path: str = "path", kind: str = "kind") -> DataFrame:
    """(keys, batch, started, ended, path, kind): of recorded events, the last of each path in each batch.

    A batch begins with an event and ends when the next is more than `gap_seconds` away; with `longest_seconds`, it is also cut at
    multiples of that time from its beginning.
    """
    order = Window.partitionBy(*keys).orderBy(ts, path, kind)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    since = at - F.lag(at).over(order)
    marked = events.withColumn("_new", F.when(since.isNull() | (since > int(gap_seconds * 1e6)), 1).otherwise(0)).withColumn("batch", F.sum("_new").over(order).cast("long"))
    if longest_seconds:
        start = F.min(at).over(Window.partitionBy(*keys, "batch"))
        marked = marked.withColumn("_part", F.floor((at - start) / int(longest_seconds * 1e6)))
    else:
        marked = marked.withColumn("_part", F.lit(0).cast("long"))
    group = [*keys, "batch", "_part"]
    whole = Window.partitionBy(*group)
    out = latest(marked.withColumns({"started": F.min(ts).over(whole), "ended": F.max(ts).over(whole)}), [*group, path], [ts, kind])
    return out.select(*keys, "batch", F.col("_part").cast("long").alias("part"), "started", "ended", F.col(path).alias("path"), F.col(kind).alias("kind"))


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """(key, started, ended, events): sessions of a key by event time; on streams, give `events` a watermark."""
    out = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.max(ts).alias("last"))
    return out.select(key, F.col("w.start").alias("started"), F.col("last").alias("ended"), "events")


def debounce_stream(events: DataFrame, gap_ms: int = int(GAP * 1000), longest_ms: int = int(LONGEST * 1000)) -> DataFrame:
    """Streaming: (repo, paths, kinds, settled) batches of events (repo, path, kind), by processing time.

    The state of a repository is its pending paths with their last kind. It is sent when nothing came for `gap_ms` (settled), or
    when the batch is `longest_ms` old.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        began, paths, kinds = state.get if state.exists else (now, [], [])
        pending = dict(zip(paths, kinds, strict=True))
        timed_out = state.hasTimedOut
        if not timed_out:
            for part in parts:
                for path, kind in zip(part["path"], part["kind"], strict=True):
                    pending.pop(path, None)
                    pending[path] = kind
        if pending and (timed_out or now - began >= longest_ms):
            state.remove()
            yield pd.DataFrame({"repo": [key[0]], "paths": [list(pending)], "kinds": [list(pending.values())], "settled": [timed_out]})
            return
        state.update((began, list(pending), list(pending.values())))
        state.setTimeoutDuration(max(1, min(gap_ms, began + longest_ms - now)))

    return events.groupBy("repo").applyInPandasWithState(
        step, "repo string, paths array<string>, kinds array<string>, settled boolean", "began long, paths array<string>, kinds array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def route(count: int, bulk: int = BULK) -> str:
    """Whether a batch of changes is applied file by file or by a full pass."""
    return "full" if count > bulk else "incremental"


def apply_changes(table: DataFrame, changes: DataFrame, contents: DataFrame, key: str = "path") -> DataFrame:
    """`table` after the changes (path, kind): deleted and changed paths go, contents of created and modified ones come.

    Running it again with the same changes gives the same table.
    """
    last = latest(changes, [key], ["kind"]) if "ts" not in changes.columns else latest(changes, [key], ["ts", "kind"])
    kept = delete_keys(table, last, [key])
    alive = last.filter(F.col("kind") != "Deleted").select(key)
    return kept.unionByName(contents.join(alive, key, "left_semi").select(*table.columns))


def apply_dated(table: DataFrame, rows: DataFrame, key: str = "path", order: Sequence[str] = ("ts", "kind")) -> DataFrame:
    """`table` and `rows`, of each path the last in the order, in whatever batches they came. Deletions stay as rows of their kind, so
    that an older change that comes late doesn't bring a path back; `alive` leaves them out."""
    return latest(table.unionByName(rows.select(*table.columns)), [key], order)


def alive(table: DataFrame) -> DataFrame:
    """The rows of a dated table whose path isn't deleted."""
    return table.filter(F.col("kind") != "Deleted")


def maintain(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], contents: Callable[[DataFrame], DataFrame], checkpoint: str, full: Callable[[], DataFrame] | None = None, bulk: int = BULK, key: str = "path", order: Sequence[str] = ("ts", "kind")) -> object:
    """A query that applies each micro-batch of changes (path, kind, ts) to a dated table (see `apply_dated`), which has `key`, `kind` and
    the columns of `order`; a batch beyond `bulk` changes is answered by `full`, if there is one, which gives the table from the
    files as they are.

    `contents` gets the last change of each path in a batch and gives the table's rows for them, deletions too. `write` gets the
    whole new table and the batch number; a batch that is run again after a failure must replace what it wrote before, so it
    writes by that number.
    """

    def one(batch: DataFrame, number: int) -> None:
        count = batch.count()
        if full is not None and route(count, bulk) == "full":
            now, known = full(), apply_dated(read(), contents(latest(batch, [key], order)), key, order)
            write(now.unionByName(delete_keys(known, now, [key]).withColumn("kind", F.lit("Deleted")).select(*now.columns)), number)
        elif count:
            write(apply_dated(read(), contents(latest(batch, [key], order)), key, order), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["alive", "apply_changes", "apply_dated", "batches", "debounce_stream", "maintain", "route", "sessions", "upsert"]
