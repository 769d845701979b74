"""Quality classifier: boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Options, fit
from .shared import crc_fold

#: Bound of the labelled rows that are fitted: those with the smallest hashes of their ids.
SAMPLE = 20_000
FOLDS, HELD_OUT, LIMIT = 5, 0, 0.3
_CLASSES = (b"#*$%&|<>", b"!", b"?", b".,;:", b"'\"()[]{}", b"-_/\\=+~@^", b"0123456789", b"\n", b" \t\r\x0b\x0c")


def _class_of_byte() -> np.ndarray:
    """Class of each byte: those above, then upper case, lower case, beyond ASCII, other."""
    out = np.full(256, len(_CLASSES) + 3)
    for k, chars in enumerate(_CLASSES):
        out[np.frombuffer(chars, np.uint8)] = k
    out[65:91], out[97:123], out[128:] = len(_CLASSES), len(_CLASSES) + 1, len(_CLASSES) + 2
    return out


_CLASS = _class_of_byte()
_N = len(_CLASSES) + 4


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text; null counts as empty."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(_CLASS, np.bincount(data, minlength=256), _N)
    words = raw.split()
    n, chars = max(1, len(words)), max(1, len(raw))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbol = np.isin(_CLASS[data], (0, 1))
    space = np.isin(_CLASS[data], (len(_CLASSES) - 2, len(_CLASSES) - 1))
    # Shares of symbols in eight equal parts of the text: a text may be good at first and junk later.
    parts = [float(p.mean()) if len(p) else 0.0 for p in np.array_split(symbol, 8)]
    return [
        np.log1p(len(words)), np.log1p(len(raw)), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        *(counts / chars), len(seen) / n, max(seen.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, sum(map(bytes.isupper, words)) / n,
        float(np.count_nonzero(symbol[:-1] & space[1:])) / n, len(lines) / n, len(set(lines)) / max(1, len(lines)), max(parts), min(parts),
    ]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(text, label) of at most `sample` labelled rows that aren't held out; one label for each id, the smallest, and one text."""
    fold = crc_fold(F.col(key), FOLDS)
    ids = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold != HELD_OUT)).groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("label"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    own = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id")
    # At most one row an id: of repeated ones the text with the smallest hash, so that the same rows always teach.
    return own.groupBy("_id").agg(F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("r.text", "r.label")


def train(docs: DataFrame, labels: DataFrame, options: Options = Options(), sample: int = SAMPLE, **columns: str) -> Boosted:
    """Fit on the driver: at most `sample` rows of a few dozen numbers are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(statistics(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1).cast(pa.int64())], names=["x", "y"])

    found = training_rows(docs, labels, sample, **columns).mapInArrow(run, "x array<double>, y long").toPandas()
    # Ties in the order of arrival must not matter: rows are sorted by their numbers.
    x = np.array(found["x"].tolist()) if len(found) else np.zeros((0, len(statistics(None))))
    y = found["y"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y)) if len(found) else np.empty(0, int)
    return fit(x[order], y[order], options)


def classify(docs: DataFrame, model: Boosted, text: str = "text", key: str = "doc_id", limit: float = LIMIT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row. Null text counts as empty; a null id is not held out; equal texts, of any
    length, have equal scores; a score of just `limit` counts as good; other columns are not read; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                score = model.score(np.array([statistics(t) for t in part.column(2).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= limit).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    held = F.coalesce(crc_fold(F.col(key), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(F.col(key).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
