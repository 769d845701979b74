"""Language identification, words first: known words by their frequency in each language, unseen words by their
character n-grams, from long to short until some are known."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_fold

#: Bound of the documents that are learned from: those with the smallest hashes of their ids. All their words and n-grams are kept.
SAMPLE = 20_000
#: Entries that a task counts before it passes them on, and numbers (words times languages) that a worker remembers.
HELD, MEMORY = 500_000, 4_000_000
ORDERS = (5, 4, 3, 2, 1)
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _WORD.findall(text.lower())


def has_letter(found: list[str]) -> bool:
    return any(c.isalpha() for w in found for c in w)


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word between its ends; of length 1: its letters."""
    held = f" {word} " if n > 1 else word
    return [held[i : i + n] for i in range(len(held) - n + 1)]


def _key(entry: str) -> int:
    return xxhash.xxh3_64_intdigest(entry.encode())


class Table:
    """Entries of one order, sparse: sorted hashes, and for each the languages that have it with what they gain by it over one
    that doesn't. `floor`: log frequency of an entry that a language doesn't have."""

    def __init__(self, entries: np.ndarray, languages: np.ndarray, counts: np.ndarray, n: int) -> None:
        order = np.lexsort((languages, entries))
        entries, self.language = entries[order], languages[order].astype(np.int32)
        starts = np.flatnonzero(np.r_[True, entries[1:] != entries[:-1]]) if len(entries) else np.empty(0, np.int64)
        self.keys, self.ends = entries[starts], np.r_[starts, len(entries)].astype(np.int64)
        # Add-one-half smoothing over the entries that any language has.
        self.floor = np.log(0.5) - np.log(np.bincount(languages, counts, n) + 0.5 * len(starts)) if len(entries) else np.zeros(n)
        self.gain = (np.log(counts[order] + 0.5) - np.log(0.5)).astype(np.float32)

    def find(self, entries: list[str]) -> np.ndarray:
        """Row of each entry; -1 if it isn't known."""
        keys = np.fromiter(map(_key, entries), np.uint64, len(entries))
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, out: np.ndarray, rows: np.ndarray, owner: np.ndarray) -> None:
        """To the lines `owner` of `out`, the mean of their rows' log frequencies in each language."""
        weight = 1.0 / np.bincount(owner, minlength=len(out))[owner]
        size = self.ends[rows + 1] - self.ends[rows]
        at = np.arange(size.sum()) + np.repeat(self.ends[rows] - (np.cumsum(size) - size), size)
        cell = np.repeat(owner, size) * out.shape[1] + self.language[at]
        out += np.bincount(cell, self.gain[at] * np.repeat(weight, size), out.size).reshape(out.shape)
        out[np.unique(owner)] += self.floor


class Model:
    """A table for each order, 0 for words, and the languages' prior. What a worker has found out about words it remembers, as rows of
    one array, until that is full; then it starts anew."""

    def __init__(self, languages: list[str], prior: np.ndarray, tables: dict[int, Table]) -> None:
        self.languages, self.prior, self.tables = languages, prior, tables
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._held = np.empty((0, len(self.languages)))

    def __getstate__(self) -> dict[str, object]:
        return {k: v for k, v in self.__dict__.items() if k not in ("_place", "_held")}

    def __setstate__(self, state: dict[str, object]) -> None:
        self.__dict__.update(state)
        self._forget()

    def lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its log frequencies, or else the mean of those of its n-grams of the longest order of which any is known; and
        that order (0: the word, -1: nothing is known)."""
        out, order = np.zeros((len(words), len(self.languages))), np.full(len(words), -1)
        left = np.arange(len(words))
        for n in (0, *ORDERS):
            parts = [grams(words[k], n) if n else [words[k]] for k in left.tolist()]
            owner = np.repeat(left, list(map(len, parts)))
            rows = self.tables[n].find([g for p in parts for g in p])
            known = rows >= 0
            if known.any():
                self.tables[n].add(out, rows[known], owner[known])
                order[owner[known]] = n
                left = left[order[left] < 0]
            if not len(left):
                break
        return out, order

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """A line for each text: the sum over its words, and the prior. Texts are taken together, long ones in parts."""
        out = np.repeat(self.prior[None, :], len(texts), axis=0)
        most, flat = max(1000, MEMORY // max(1, len(self.languages))), [w for t in texts for w in t]
        text = np.repeat(np.arange(len(texts)), list(map(len, texts)))
        for lo in range(0, len(flat), most):
            part = flat[lo : lo + most]
            fresh = list({w for w in part if w not in self._place})
            if len(self._place) + len(fresh) > most:
                self._forget()
                fresh = list(set(part))
            if fresh:
                self._place.update(zip(fresh, range(len(self._place), len(self._place) + len(fresh)), strict=True))
                held = np.empty((len(self._place), len(self.languages)))
                held[: len(held) - len(fresh)] = self._held[: len(held) - len(fresh)]
                held[len(held) - len(fresh) :] = self.lines(fresh)[0]
                self._held = held
            values, own = self._held[list(map(self._place.__getitem__, part))], text[lo : lo + most]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[starts]] += np.add.reduceat(values, starts, axis=0)
        return out


def build(lang: Sequence[str], order: np.ndarray, entry: Sequence[str], count: np.ndarray) -> Model:
    """From rows of (language, order, entry, count), in any order; those of order -1 count documents."""
    languages = sorted(set(lang))
    place = {x: i for i, x in enumerate(languages)}
    at = np.array([place[x] for x in lang], np.int64)
    docs = np.bincount(at[order == -1], count[order == -1], len(languages))
    tables = {}
    for n in (0, *ORDERS):
        own = np.flatnonzero(order == n)
        tables[n] = Table(np.array([_key(entry[k]) for k in own], np.uint64), at[own], count[own].astype(np.float64), len(languages))
    return Model(languages, np.log((docs + 0.5) / (docs.sum() + 0.5 * len(docs))), tables)


def train(docs: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Count words and n-grams of at most `sample` documents that aren't held out; the sums are gathered on the driver: their
    number is bounded by the sample. Rows without text or language teach nothing; of rows that repeat an id, all teach."""
    fold = crc_fold(F.col(key), FOLDS)
    usable = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull() & (fold != HELD_OUT))
    ids = usable.select(F.col(key).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    taught = usable.select(F.col(key).alias("_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).join(F.broadcast(ids), "_id").select("lang", "text")

    def rows(seen: Counter[tuple[str, int, str]]) -> pa.RecordBatch:
        keys = list(seen)
        made = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string())]
        return pa.RecordBatch.from_arrays([*made, pa.array(list(seen.values()), pa.int64())], names=["lang", "n", "entry", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int, str]] = Counter()
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[language, -1, ""] += 1
                found.update((language, w) for w in words(value))
            for (language, word), count in found.items():
                seen[language, 0, word] += count
                for n in ORDERS:
                    for g in grams(word, n):
                        seen[language, n, g] += count
            if len(seen) >= HELD:
                yield rows(seen)
                seen = Counter()
        yield rows(seen)

    counted = taught.mapInArrow(run, "lang string, n int, entry string, count long").groupBy("lang", "n", "entry").agg(F.sum("count").alias("count")).toArrow()
    return build(counted["lang"].to_pylist(), counted["n"].to_numpy(), counted["entry"].to_pylist(), counted["count"].to_numpy())


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; score is the probability of the predicted language.

    A null text or one without a letter is `und` with score 0, and so is everything if nothing was learned. A null id isn't
    held out. Of languages with equal totals the first by name is predicted; equal texts, of any length, get equal answers; other columns are
    not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                found = [words(t or "") for t in part.column(2).to_pylist()]
                predicted, certain = [UNKNOWN] * len(found), [0.0] * len(found)
                told = [k for k, w in enumerate(found) if model.languages and has_letter(w)]
                for k, total in zip(told, model.totals([found[k] for k in told]), strict=True):
                    chance = np.exp(total - total.max())
                    best = int(chance.argmax())
                    predicted[k], certain[k] = model.languages[best], float(chance[best] / chance.sum())
                made = [pa.array(predicted, pa.string()), pa.array(certain, pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    held = F.coalesce(crc_fold(F.col(key), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(F.col(key).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
