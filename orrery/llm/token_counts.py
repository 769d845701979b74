"""Token counts of fields and sections: whole documents are encoded once and their tokens attributed by position.

Encoding sections by themselves would give other tokens at their edges and more work. Here each token has the span of the
characters that its bytes belong to, and these spans are joined with the sections' spans (both sorted, so two binary searches do). A
token that crosses a boundary is allocated whole by a stated rule, so that the sections' counts add up to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_vocabulary, vocabulary

#: Who gets a token that crosses boundaries: the section with most of its characters (the earliest of several), the first, or the last.
RULES = ("most", "first", "last")


def lines(text: str) -> list[int]:
    """Starts of the lines of a text, in code points; a line ends with its newline. An empty text has one line."""
    starts, at = [0], text.find("\n") + 1
    while 0 < at < len(text):
        starts.append(at)
        at = text.find("\n", at) + 1
    return starts


def spans(lengths: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (in code points) of each token; lengths: bytes of the tokens, which tile `raw`. A character whose
    bytes several tokens share belongs to each."""
    character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return character[ends - lengths], character[ends - 1]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "most") -> np.ndarray:
    """Tokens of each section, from the tokens' first and last characters and the sections' starts, from 0 on. Empty sections
    get none."""
    one = np.searchsorted(starts, first, "right") - 1
    other = np.searchsorted(starts, last, "right") - 1
    owner = (other if rule == "last" else one).copy()
    if rule == "most":
        for k in np.flatnonzero(one != other):
            edges = np.r_[first[k], starts[one[k] + 1 : other[k] + 1], last[k] + 1]
            owner[k] = one[k] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(starts))


def section_tokens(docs: DataFrame, rule: str = "most", vocabulary_path: str | None = None, fields: Sequence[str] = ("text",), key: str = "doc_id") -> DataFrame:
    """(doc_id, field, section, start, end, n_tokens, doc_tokens): one row for each line of each field of each row of `docs`.

    A document is its fields, cast to string, joined by newlines, which belong to the lines before them. start and end are in code
    points of it and tile it; section numbers the lines of a field. Null counts as empty: one section, without tokens but for those of the
    newline after it. Repeated rows give repeated rows; other columns are not read; an empty table gives an empty one.
    """
    if rule not in RULES or not fields:
        raise ValueError(f"rule must be one of {RULES}, and there must be a field")
    path, fields = vocabulary_path or default_vocabulary(), list(fields)
    names = ["doc_id", "field", "section", "start", "end", "n_tokens", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                rows, field, section, numbers = [], [], [], []
                for k, values in enumerate(zip(*[part.column(c + 1).to_pylist() for c in range(len(fields))], strict=True)):
                    starts, at = [], 0
                    for f, value in enumerate(values):
                        own = lines(value or "")
                        starts += [at + x for x in own]
                        at += len(value or "") + 1
                        field += [f] * len(own)
                        section += range(len(own))
                    document = "\n".join(v or "" for v in values)
                    ids, begin = vocab.ids(document), np.array(starts)
                    counts = allocate(*spans(vocab.lengths[ids], document.encode()), begin, rule)
                    rows += [k] * len(begin)
                    numbers.append(np.stack([begin, np.r_[begin[1:], len(document)], counts, np.full(len(begin), len(ids))]))
                made = [pa.array(c.astype(np.int64)) for c in np.concatenate(numbers, axis=1)]
                named = pa.array(fields, pa.string()).take(pa.array(field, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), named, pa.array(section, pa.int64()), *made], names=names)

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("doc_id"), *[F.col(f).cast("string").alias(f"_field_{k}") for k, f in enumerate(fields)])
    return chosen.mapInArrow(run, f"doc_id {kind}, field string, section long, start long, end long, n_tokens long, doc_tokens long")
