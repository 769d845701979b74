"""Near duplicates: a similarity join of n-gram sets and its connected components.

1. One pass over the texts gives each document its set of n-gram hashes. Equal sets are one class.
2. Two similar sets share an element among the first few of each (the prefix), in any order that is the same for all. The
   order here is by the number of classes that have the element, then by hash, so that prefixes hold the rarest ones and
   passages that many documents share come last. Elements with small hashes are counted for all classes; those
   beyond only for the classes whose prefix isn't full without them.
3. Classes that share a prefix element are compared by parity bitmaps, whose distance never exceeds that of the sets. Pairs
   that pass are candidates; their components are blocks.
4. Each block's sets, made again from the texts, are joined in a prefix tree, which finds every link or another path.

Blocks and groups of any size are split: see `_candidates` and `_links`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .ngram_trie import Threshold, linked_forest
from .shared import bounded, isolated, settled

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(33)
#: A key is hot beyond this part of all rows, so there are no more hot ones.
HOT_KEYS = 50_000


@dataclass(frozen=True)
class Join:
    """words: of an n-gram. num / den: similarity. counted: share of the hash range whose elements are counted first. hot: of
    those, an element in more classes goes last; None: a third more than a prefix takes. group: rows of a group that is compared as a whole. cell: sets of one prefix
    tree."""

    words: int = 5
    num: int = 80
    den: int = 100
    counted: float | None = None
    hot: int = 128
    group: int = 4096
    cell: int = 1024


class _Words(dict):
    """64-bit hashes of words; starts anew when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def ngrams(text: str | None, n: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's words, A-Z in lower case; fewer words: one hash of them all."""
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    x = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        x *= _A
        x += h[k : len(h) - n + 1 + k]
    x ^= x >> _S
    x *= _B
    x ^= x >> _S
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]]


def _bitmap(items: np.ndarray) -> bytes:
    """Parities of the number of elements in each cell: at least half as many cells as elements, a power of two."""
    cells = max(64, 1 << max(0, (len(items) - 1).bit_length() - 1))
    at = (items & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(bool), bitorder="little").tobytes()


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _profiles(join: Join):
    """Pass 1. keys: elements in the counted range; p: size of the prefix."""
    share = join.counted if join.counted is not None else min(1.0, (1 - join.num / join.den) * 4 / 3)
    limit, top = Threshold(join.num, join.den), np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, node = _Words(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                sets = [ngrams(t, join.words, cache) for t in part.column(2).to_pylist()]
                low = [int(np.searchsorted(s, top)) for s in sets]
                p = [limit.prefix(len(s)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(node, node + len(sets))),
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(p, pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        _lists([s[:k] for s, k in zip(sets, low, strict=True)]),
                        pa.array([_bitmap(s) for s in sets], pa.binary()),
                    ],
                    names=["node", "doc_id", "text_hash", "n", "p", "digest", "keys", "bits"],
                )
                node += len(sets)

    return run


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `columns`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        if held:
            last, first = held[-1].slice(len(held[-1]) - 1), batch.slice(0, 1)
            same = all(last.column(c)[0].as_py() == first.column(c)[0].as_py() for c in columns)
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        ends = np.zeros(len(batch) - 1, bool)
        for c in columns:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            ends |= v[1:] != v[:-1]
        cut = np.flatnonzero(ends)
        if len(cut):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]) + 1)])
            held = [batch.slice(int(cut[-1]) + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _compare(join: Join):
    """Within each group: edges that connect the rows whose sizes and bitmaps allow similarity."""
    limit = Threshold(join.num, join.den)

    def near(n: np.ndarray, bits: list[bytes], node: np.ndarray) -> list[tuple[int, int]]:
        """Components as edges from their smallest node, so that groups with the same rows give the same edges.

        Rows are taken in the order of their sizes; each is compared with all smaller ones at once.
        """
        order = np.argsort(n, kind="stable")
        sizes, node, label = n[order], node[order], np.arange(len(n))
        maps = [np.frombuffer(bits[i], np.uint8) for i in order]
        widths = np.array([len(m) for m in maps])
        table = {int(w): (at := np.flatnonzero(widths == w), np.stack([maps[i] for i in at])) for w in np.unique(widths)}
        least = np.searchsorted(sizes * limit.den, limit.num * sizes)
        for q in range(1, len(order)):
            for width, (at, held) in table.items():
                a, b = np.searchsorted(at, (least[q], q))
                if width > widths[q] or a == b:
                    continue
                apart = np.bitwise_count(held[a:b] ^ _fold(maps[q], width)).sum(axis=1, dtype=np.int64)
                both = sizes[at[a:b]] + sizes[q]
                allowed = both - 2 * -(-limit.num * both // (limit.num + limit.den))
                met = np.unique(label[at[a:b][apart <= allowed]])
                if len(met):
                    label[np.isin(label, np.r_[met, label[q]])] = label[q]
        out: list[tuple[int, int]] = []
        for one in np.unique(label):
            own = np.sort(node[label == one])
            out += [(int(own[0]), int(x)) for x in own[1:]]
        return out

    def pair(n: int, bits: bytes, m: int, more: bytes) -> bool:
        if len(bits) > len(more):
            bits, more = more, bits
        x, y, width = int.from_bytes(bits, "little"), int.from_bytes(more, "little"), 8 * len(more)
        while width > 8 * len(bits):
            width //= 2
            y = (y >> width) ^ (y & ((1 << width) - 1))
        return (x ^ y).bit_count() <= n + m - 2 * limit.overlap(n, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["h"]):
            h = table.column("h").to_numpy()
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
            n, node, bits = table.column("n").to_numpy(), table.column("node").to_numpy(), table.column("bits")
            seen: set[tuple[int, int]] = set()
            size = np.diff(starts)
            # Most groups are pairs: their sizes are compared at once, their bitmaps as whole numbers.
            two = starts[:-1][size == 2]
            small, large = np.minimum(n[two], n[two + 1]), np.maximum(n[two], n[two + 1])
            two = two[limit.den * small >= limit.num * large]
            for k in two.tolist():
                if pair(int(n[k]), bits[k].as_py(), int(n[k + 1]), bits[k + 1].as_py()):
                    x, y = int(node[k]), int(node[k + 1])
                    seen.add((min(x, y), max(x, y)))
            for a, c in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                seen.update(near(n[a : a + c], bits.slice(a, c).to_pylist(), node[a : a + c]))
            yield _edges(list(seen))

    return run


def _counted(rows: DataFrame) -> DataFrame:
    """(h, node, count) of those rows (h, node) whose key others have too.

    Keys are counted with partial sums; those that hold more than a small part of all rows, of which there can't be many, meet their rows by
    a broadcast, so that no task gets all rows of such a key.
    """
    totals = settled(rows.groupBy("h").agg(F.count("*").cast("int").alias("count")).filter("count > 1"), "ngram-totals")
    limit = F.lit(max(2048, (totals.agg(F.sum("count")).first()[0] or 0) // HOT_KEYS))
    hot = F.broadcast(totals.filter(F.col("count") > limit))
    rest = rows.join(F.broadcast(hot.select("h")), "h", "left_anti").join(totals.filter(F.col("count") <= limit), "h")
    return rest.union(rows.join(hot, "h").select(rest.columns))


def _first(rows: DataFrame, wanted: DataFrame, number: str) -> DataFrame:
    """(h, node): of each node's elements, the rarest that fill its prefix, as far as others have them too.

    rows: (h, node, count), elements in more than one class. wanted: a row for each node with `total`, its number of elements in
    this part of the order; `number` says how many of them are in the prefix. Elements in one class come first: they
    fill places but bring no one together.
    """
    held = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("held"))
    places = F.expr(number) - (F.col("total") - F.size("held"))
    held = held.join(wanted, "node").withColumn("places", places.cast("int")).filter("places > 0")
    return held.select(F.explode(F.slice("held", F.lit(1), F.least("places", F.size("held")))).alias("e"), "node").select("e.h", "node")


def _made(texts: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """`wanted` (node, doc_id, text_hash, digest, ...) with items, the sets, made again from the texts."""
    rows = bounded(wanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    own = texts.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
    return own.select("text").mapInArrow(_sets(join), "digest binary, items array<bigint>").join(wanted.drop("doc_id", "text_hash"), "digest").dropDuplicates(["node"])


def _candidates(texts: DataFrame, heads: DataFrame, join: Join) -> DataFrame:
    """Edges (a, b) over the nodes: two similar classes are connected by them.

    The order: counted elements that aren't hot, then those beyond the counted range, then hot ones, each by count and
    hash. Groups of a key with more than `group` rows, which have nothing rarer in common, are near copies of one text as a
    rule; they are joined to their smallest node without comparison and so make up one block.
    """
    counted = settled(_counted(heads.select(F.explode("keys").alias("h"), "node")), "ngram-counted")
    brief = heads.select("node", "p", F.size("keys").alias("low"))
    hots = settled(counted.filter(F.col("count") > join.hot).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("hots")), "ngram-hot")
    cool = brief.join(bounded(hots.select("node", F.size("hots").alias("n_hot"))), "node", "left").select("node", "p", (F.col("low") - F.coalesce("n_hot", F.lit(0))).alias("total"))
    keys = _first(counted.filter(F.col("count") <= join.hot), cool, "p")
    # Classes with room in their prefix: the elements beyond the range are counted among these classes.
    open_ = cool.filter("total < p").join(heads.select("node", "doc_id", "text_hash", "digest", "n", F.size("keys").alias("low")), "node")
    open_ = settled(open_.select("node", "doc_id", "text_hash", "digest", "n", (F.col("p") - F.col("total")).alias("need"), "low"), "ngram-open")
    beyond = _made(texts, open_, join).select("node", F.explode(F.slice("items", F.col("low") + 1, F.greatest(F.lit(1), F.size("items")))).alias("h"))
    beyond = settled(beyond, "ngram-beyond")
    late = open_.select("node", "need", (F.col("n") - F.col("low")).alias("total"))
    keys = keys.union(_first(_counted(beyond), late, "need"))
    short = late.filter("need > total").join(hots, "node")
    keys = keys.union(short.select(F.explode(F.slice("hots", F.lit(1), F.least((F.col("need") - F.col("total")).cast("int"), F.size("hots")))).alias("e"), "node").select("e.h", "node"))
    keys = settled(keys, "ngram-keys")
    totals = keys.groupBy("h").agg(F.count("*").alias("count"), F.min("node").alias("a")).filter("count > 1")
    big = bounded(settled(totals.filter(F.col("count") > join.group).select("h", "a"), "ngram-big"))
    star = keys.join(big, "h").filter("a <> node").select("a", F.col("node").alias("b"))
    # What is left has few rows a key. A row without a neighbour of like size has no partner in its group.
    sized = keys.join(big, "h", "left_anti").join(heads.select("node", "n"), "node")
    by_size = Window.partitionBy("h").orderBy("n", "node")
    like = (F.lag("n").over(by_size) * join.den >= F.col("n") * join.num) | (F.lead("n").over(by_size) * join.num <= F.col("n") * join.den)
    small = sized.withColumn("like", like).filter("like").select("h", "node", "n").join(heads.select("node", "bits"), "node")
    pairs = small.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(join), "a long, b long")
    return settled(pairs.union(star).distinct(), "ngram-candidates")


def _sets(join: Join):
    """Pass 2: the sets themselves, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            for lo in range(0, len(batch), 500):
                sets = [ngrams(t, join.words, cache) for t in batch.column(0).slice(lo, 500).to_pylist()]
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, _lists(sets)], names=["digest", "items"])

    return run


def _search(join: Join, visiting: bool):
    """Links within each cell of a block: all rows are looked up among each other or, if `visiting`, rows that visit among those
    that don't. Rows of one label are connected already."""
    limit = Threshold(join.num, join.den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["block", "cell"]):
            keys = np.stack([table.column(c).to_numpy() for c in ("block", "cell")])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])
            node, label, visits = (table.column(c).to_numpy() for c in ("node", "label", "visits"))
            items = table.column("items").combine_chunks()
            flat, ends = items.values.to_numpy().view(np.uint64), items.offsets.to_numpy()
            found: list[tuple[int, int]] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                own = int((~visits[a:b]).sum())
                if b - a < 2 or (visiting and own in (0, b - a)):
                    continue
                order = a + np.lexsort((node[a:b], visits[a:b]))
                sets = [flat[ends[k] : ends[k + 1]] for k in order]
                guests = sets[own:] if visiting else None
                found += [(int(node[order[x]]), int(node[order[y]])) for x, y in linked_forest(sets[:own], limit, guests, label[order])]
            yield _edges(found)

    return run


def _links(texts: DataFrame, heads: DataFrame, blocks: DataFrame, join: Join) -> DataFrame:
    """Edges (a, b) that connect the nodes as all similar pairs would.

    A block of up to `cell` sets is one tree. A larger one is first dealt to cells by a hash, with its smallest
    set in each: near copies of one text become one component here. Then only the sets outside the block's largest
    component visit the other cells and are looked up there; if they are many, in parts.
    """
    wanted = settled(heads.join(blocks, "node").select("node", "doc_id", "text_hash", "digest", "block"), "ngram-blocks")
    made = settled(_made(texts, wanted, join).select("node", "block", "items"), "ngram-sets")

    def search(cells: DataFrame, visiting: bool) -> DataFrame:
        dealt = cells.repartition("block", "cell").sortWithinPartitions("block", "cell")
        return settled(dealt.mapInArrow(_search(join, visiting), "a long, b long"), "ngram-links")

    sizes = made.groupBy("block").agg(F.count("*").alias("size"), F.min("node").alias("pivot"))
    cells = F.ceil(F.col("size") / join.cell).cast("int")
    dealt = made.join(bounded(sizes), "block").withColumn("cells", cells)
    own = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("cells") - 1)
    at = F.explode(F.when(F.col("node") == F.col("pivot"), everywhere).otherwise(F.array(own)))
    whole = [F.col("node").alias("label"), F.lit(False).alias("visits")]
    first = search(dealt.select("node", "block", "items", *whole, at.alias("cell")), False)
    large = sizes.filter(F.col("size") > join.cell)
    if large.limit(1).count() == 0:
        return first
    labels = components(first)
    part = dealt.filter("cells > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = part.groupBy("block", "label").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    rest = part.join(main, "block").withColumns({"goes": F.col("label") != F.col("main"), "own": own})
    guests = rest.filter("goes").groupBy("block").agg(F.ceil(F.count("*") / (4 * join.cell)).cast("int").alias("parts"))
    rest = settled(rest.join(guests, "block"), "ngram-rest")
    part_of = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    every_part = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.col("own") * F.col("parts") + i))
    elsewhere = F.explode(F.transform(F.array_remove(everywhere, F.col("own")), lambda c: c * F.col("parts") + part_of))
    stay = rest.select("node", "block", "items", "label", F.lit(False).alias("visits"), every_part.alias("cell"))
    go = rest.filter("goes").select("node", "block", "items", "label", F.lit(True).alias("visits"), elsewhere.alias("cell"))
    return first.union(search(stay.union(go), True))


def near_duplicates(docs: DataFrame, join: Join = Join(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of `docs`.

    component_id is the smallest id that can be reached over links, the row's own included. Null and blank texts
    have no n-grams and no links. Rows with equal sets are linked even if they repeat an id; a null id counts as
    greater than all others: a component of null ids alone has a null component_id. Other columns of `docs` are not read.
    """
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    schema = f"node long, doc_id {docs.schema[key].dataType.simpleString()}, text_hash long, n long, p long, digest binary, keys array<bigint>, bits binary"
    base = settled(texts.mapInArrow(_profiles(join), schema), "ngram-profiles")
    classes = base.filter("n > 0").groupBy("digest").agg(F.min("node").alias("head"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = settled(classes, "ngram-classes")
    several = classes.filter("copies > 1").select("digest", "head")
    extra = base.filter("n > 0").select("node", "digest").join(bounded(several), "digest").filter("node <> head").select("node")
    extra = settled(extra, "ngram-copies")
    heads = base.filter("n > 0").join(bounded(extra), "node", "left_anti")
    edges = _candidates(texts, heads, join)
    blocks = components(edges).select("node", F.col("label").alias("block"))
    links = _links(texts, heads, blocks, join)
    labels = components(links)
    # Smallest id of each component, then of each class in it.
    in_part = labels.join(classes.select(F.col("head").alias("node"), "least"), "node")
    smallest = in_part.groupBy("label").agg(F.min("least").alias("smallest"))
    of_class = in_part.join(smallest, "label").select("node", "smallest")
    reach = classes.join(of_class, F.col("head") == F.col("node"), "left").filter("copies > 1 OR node IS NOT NULL")
    linked = settled(reach.select("digest", F.coalesce("smallest", "least").alias("component_id")), "ngram-linked")
    out = base.select("doc_id", "n", "digest").join(bounded(linked), "digest", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, join: Join = Join(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, with its columns, that stand for their component: those with its smallest id.

    Of rows that repeat an id and a text one stays. A text without words is dropped only as a repeat of the same row.
    """
    safe, own = isolated(docs)
    found = near_duplicates(safe, join, own[text], own[key])
    found = settled(found, "ngram-found")
    gone = found.groupBy("doc_id").agg(F.bool_or(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("stays")).filter("NOT stays")
    gone = bounded(settled(gone.select(F.col("doc_id").alias("_gone")), "ngram-gone"))
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    repeated = bounded(settled(repeated.select(F.col("doc_id").alias("_repeated"), F.lit(True).alias("_again")), "ngram-repeated"))
    kept = safe.join(gone, F.col(own[key]).eqNullSafe(F.col("_gone")), "left_anti")
    kept = kept.join(repeated, F.col(own[key]).eqNullSafe(F.col("_repeated")), "left")
    once = kept.filter("_again").dropDuplicates([own[key], own[text]])
    return kept.filter("_again IS NULL").union(once).select(*[F.col(a).alias(c) for c, a in own.items()])
