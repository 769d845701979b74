"""Best-fit packing of token sequences, bulk-synchronous.

Documents are encoded once and cut into pieces of at most `capacity` tokens. Pieces are sorted by length, gaps by size.
A superstep takes all pieces of one length, longest first: a sweep over the sorted gaps gives each the successor gap (the
smallest that holds it); pieces that want the same gaps are served in the order of their rank, the rest open new
sequences; then the gaps are updated, and the next length follows. This is best-fit decreasing.

As lengths are at most `capacity`, the state of a sweep is kept as runs (gap size, first sequence, number of sequences): its
size depends on the capacity alone, so the sweeps run on the driver over a histogram. Ranks are found and pieces seated
where the pieces are: each looks its (length, rank) up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bounded, ranked, settled
from .tokens import default_vocabulary, vocabulary

#: Production parameters: tokens of a sequence, and the id that ends a document.
CAPACITY = 1024
END_ID = 2
#: Rows that are packed together where sequences follow the order of a table.
WINDOW_ROWS = 512


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary_path: str | None = None, text: str = "text", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) and the columns `carry`: the pieces of each document; null text is empty.

    A document of more than `capacity` tokens is cut so that only its first piece may be shorter. row numbers the rows.
    """
    path = vocabulary_path or default_vocabulary()
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, row = vocabulary(path), TaskContext.get().partitionId() << 33
        tail = np.array([end_id], "<u4")
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([vocab.ids(value or "").astype("<u4", copy=False), tail])
                head = len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    at.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
            made = [pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            rows = pa.array(np.arange(row, row + len(at)))
            row += len(at)
            taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([rows, taken[0], *made, *taken[1:]], names=names)

    kind = docs.schema[key].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *carry).mapInArrow(run, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


class Plan:
    """Seats for a histogram of lengths: seat(length, ranks) gives sequence and offset of the ranked pieces."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        #: For each length: ranks from which a seat run holds, its first sequence and its offset.
        self.seats: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        runs: dict[int, list[tuple[int, int]]] = {}
        sizes: list[int] = []

        def leave(size: int, first: int, count: int) -> None:
            if size and count:
                if not runs.get(size):
                    insort(sizes, size)
                runs.setdefault(size, []).append((first, count))

        for length in sorted(histogram, reverse=True):
            left, rank, table = histogram[length], 0, []
            while left:
                size = next((s for s in sizes if s >= length), None)
                if size is None:
                    break
                first, count = runs[size].pop()
                if not runs[size]:
                    sizes.remove(size)
                used = min(count, left)
                table.append((rank, first, capacity - size))
                leave(size, first + used, count - used)
                leave(size - length, first, used)
                rank, left = rank + used, left - used
            layers = capacity // length
            for new, deep in ((left // layers, layers), (1, left % layers)):
                if new and deep:
                    for layer in range(deep):
                        table.append((rank, self.sequences, layer * length))
                        rank += new
                    leave(capacity - deep * length, self.sequences, new)
                    self.sequences += new
            if table:
                self.seats[length] = tuple(np.array(c, np.int64) for c in zip(*table, strict=True))  # type: ignore[assignment]

    def seat(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        since, first, offset = self.seats[length]
        run = np.searchsorted(since, rank, "right") - 1
        return first[run] + rank - since[run], offset[run]


def seated(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (what pieces() made, settled) with sequence_id and offset instead of row."""
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = Plan(sizes, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(length[order])) + 1, len(order)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    at = order[a:b]
                    sequence[at], offset[at] = plan.seat(int(length[at[0]]), rank[at])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    placed = ranked(cut, ["length"], ["row"], F.lit(1), "rank", sum(sizes.values()))
    kind = cut.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary_path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each row of `docs` lies.

    Every row has a piece, as null and empty texts have the end id. Repeated rows are packed each; an empty table gives an
    empty result; other columns are not read.
    """
    return seated(settled(pieces(docs, capacity, end_id, vocabulary_path, text, key), "pack-pieces"), capacity)


def _stands(docs: DataFrame) -> list[Column]:
    """Where a row stands in its table: part and place. Tables of files: the file and the row's number in it; others: the partition."""
    try:
        held = docs.metadataColumn("_metadata")
        found = [held["file_path"].alias("_part"), held["row_index"].alias("_at")]
        docs.select(found)
    except AnalysisException:
        id_ = F.monotonically_increasing_id()
        found = [F.lpad(F.shiftright(id_, 33).cast("string"), 12, "0").alias("_part"), id_.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")]
    return found


def pack_in_order(docs: DataFrame, window: int = WINDOW_ROWS, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary_path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As pack(), but sequences follow the order of the table, which is that of its files' names and of the rows in them:
    every `window` rows of a file are packed for themselves, and sequence_id counts through the windows in order. So any
    run of sequences holds the rows of a run of the table, but for a window at each end.

    The order is that in which a sorted table was written. A table that doesn't come from files has the order of its partitions.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *_stands(docs))
    cut = settled(pieces(own, capacity, end_id, vocabulary_path, carry=("_part", "_at")), "pack-pieces").withColumn("_window", F.floor(F.col("_at") / window).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_at", "ascending"), ("piece", "ascending")])
        length = table["length"].to_numpy()
        plan = Plan(Counter(length.tolist()), capacity)
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            sequence[at], offset[at] = plan.seat(int(size), np.arange(len(at)))
        return table.select(["_part", "_window", *names]).append_column("sequence", pa.array(sequence)).append_column("offset", pa.array(offset))

    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = f"_part string, _window long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence long, offset long"
    made = settled(cut.select("_part", "_window", "_at", *names).groupBy("_part", "_window").applyInArrow(run, schema), "pack-windows")
    # The first sequence of each window: of its file, by a row for each file, and within it.
    counts = made.groupBy("_part", "_window").agg((F.max("sequence") + 1).alias("n"))
    before = lambda w: F.sum("n").over(w) - F.col("n")
    parts = counts.groupBy(F.col("_part").alias("_of")).agg(F.sum("n").alias("n")).select("_of", before(Window.orderBy(F.length("_of"), "_of")).alias("_base"))
    first = counts.select("_part", F.col("_window").alias("_w"), before(Window.partitionBy("_part").orderBy("_window")).alias("_first"))
    first = first.join(bounded(parts), F.col("_part") == F.col("_of")).select("_of", "_w", (F.col("_first") + F.col("_base")).alias("_first"))
    same = (F.col("_part") == F.col("_of")) & (F.col("_window") == F.col("_w"))
    return made.join(bounded(settled(first, "pack-first")), same).select(*names, (F.col("_first") + F.col("sequence")).alias("sequence_id"), "offset")
