"""Ranked full-text search over weighted fields, and trigram search."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import settled

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"


def query_tokens(query: str) -> list[str]:
    """Lower-case tokens of a query; each also matches as a prefix."""
    out: list[str] = []
    for part in re.split(r"[^\w]+", query):
        for token in re.split("_+", part):
            if re.search(r"[^\W_]", token) and token.lower() not in out:
                out.append(token.lower())
    return out


def query_phrases(query: str) -> list[tuple[str, ...]]:
    """Words of a query as phrases of tokens: the parts of a_b must stand next to each other, the last as a prefix."""
    words = [tuple(t.lower() for t in re.split("_+", part) if re.search(r"[^\W_]", t)) for part in re.split(r"[^\w]+", query)]
    return list(dict.fromkeys(w for w in words if w))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def postings(entities: DataFrame, doc: str, fields: list[str], positions: bool = False) -> DataFrame:
    """(term, doc, field, tf): the inverted index, to be stored and sorted by term. With `positions` also `at`, those of the term in
    the field, for phrases.

    Terms are counted within their row, so no task gathers the postings of its rows; only those of documents that several rows
    make up (looked for in the keys) are added up.
    """
    each = [F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in fields]
    rows = entities.select(F.col(doc).alias("doc"), F.explode(F.array(*each)).alias("f")).select("doc", "f.field", "f.terms").filter(F.size("terms") > 0)
    # Each step is a column of its own: sorted occurrences, and the places in them where another term begins.
    rows = rows.withColumn("sorted", F.sort_array(F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("i"))))) if positions else rows.withColumn("sorted", F.sort_array("terms"))
    term = lambda i: F.get("sorted", i).getField("term") if positions else F.get("sorted", i)
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda i: (i == 0) | (term(i) != term(i - 1))))

    def entry(start: Column, n: Column) -> Column:
        tf = F.coalesce(F.get("starts", n + 1), F.size("sorted")) - start
        more = [F.transform(F.slice("sorted", start + 1, tf), lambda x: x.getField("i")).alias("at")] if positions else []
        return F.struct(term(start).alias("term"), tf.cast("long").alias("tf"), *more)

    rows = rows.select("doc", "field", F.explode(F.transform("starts", entry)).alias("e")).select("e.term", "doc", "field", "e.tf", *(["e.at"] if positions else []))
    repeated = entities.groupBy(F.col(doc).alias("_doc")).agg(F.count("*").alias("n")).filter("n > 1").select("_doc")
    if repeated.isEmpty():
        return rows
    same = F.col("doc").eqNullSafe(F.col("_doc"))
    more = [F.sort_array(F.flatten(F.collect_list("at"))).alias("at")] if positions else []
    added = rows.join(repeated, same, "left_semi").groupBy("term", "doc", "field").agg(F.sum("tf").alias("tf"), *more)
    return rows.join(repeated, same, "left_anti").unionByName(added)


def lengths(entities: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """(doc, size): the number of tokens of each document, those without one included; stored beside the postings."""
    size = sum((F.size(tokens(F.col(f))) for f in fields), F.lit(0))
    return entities.select(F.col(doc).alias("doc"), size.alias("size")).groupBy("doc").agg(F.sum("size").cast("double").alias("size"))


def write_postings(index: DataFrame, path: str, buckets: int = 64) -> None:
    """A stored index: `part`, a hash of the document, is what upkeep rewrites; within it rows are sorted by term, so that a query
    for a term or a prefix reads few row groups."""
    dealt = index.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int"))
    dealt.repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def update_postings(stored: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after a change: postings of changed documents (doc) go, those of their new texts come."""
    return stored.join(changed.select("doc").distinct(), "doc", "left_anti").select(*fresh.columns).unionByName(fresh)


def bm25(entities: DataFrame, doc: str, weights: Mapping[str, float], query: str, most: int = 20) -> DataFrame:
    """(doc, score): negated weighted bm25, smallest first, ties by doc.

    Statistics come from one pass: the number of rows, the mean length and, for each query token, the rows that hold it. A
    term's frequency is the weighted sum over the fields, and a row's length is that of all fields. A token that more than
    half of the rows hold has a tiny positive weight.
    """
    wanted = query_phrases(query)
    fields = list(weights)
    # Texts are split once, into columns of their own.
    entities = entities.select(F.col(doc).alias("_doc"), *[tokens(F.col(f)).alias(f"_f{k}") for k, f in enumerate(fields)])
    lists, doc = {f: F.col(f"_f{k}") for k, f in enumerate(fields)}, "_doc"

    def count(f: str, phrase: tuple[str, ...]) -> Column:
        """Places where the phrase ends, its last token as a prefix."""
        before = [(k, t) for k, t in enumerate(reversed(phrase[:-1]), 1)]
        here = lambda x, i: reduce(and_, [F.coalesce(F.get(lists[f], i - k) == t, F.lit(False)) for k, t in before], x.startswith(phrase[-1]))
        return F.size(F.filter(lists[f], here))

    length = sum((F.size(lists[f]) for f in fields), F.lit(0))
    tf = [sum((F.lit(float(weights[f])) * count(f, t) for f in fields), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(wanted)]
    # Texts are read once: what statistics and scores need of a row is a few numbers.
    rows = settled(entities.select(F.col(doc).alias("doc"), length.cast("double").alias("size"), *tf), "bm25")
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(wanted))])
    any_ = F.lit(False)
    for i in range(len(wanted)):
        any_ |= F.col(f"tf{i}") > 0
    score = F.lit(0.0)
    for i in range(len(wanted)):
        df = F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        f = F.col(f"tf{i}")
        score += idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = rows.filter(any_).join(F.broadcast(stats)).select("doc", F.round(-score, 9).alias("score"))
    return scored.orderBy("score", "doc").limit(most)


def bm25_postings(index: DataFrame, sizes: DataFrame, weights: Mapping[str, float], query: str, most: int = 20) -> DataFrame:
    """The same from a stored index: only the postings of the query's terms are read. A posting counts for every phrase of which it
    is a part. Phrases of several tokens need an index with positions."""
    wanted = query_phrases(query)
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(w))) for f, w in weights.items()])
    # (phrase, place in it, test of the term).
    tests = [(n, k, F.col("term").startswith(t) if k == len(p) - 1 else F.col("term") == t) for n, p in enumerate(wanted) for k, t in enumerate(p)]
    index = index.filter(reduce(or_, [t for *_, t in tests], F.lit(False))).filter(F.col("field").isin(*weights))
    met = F.explode(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(n).alias("token"), F.lit(k).alias("k"))) for n, k, t in tests])))
    hits = index.withColumn("_hit", met).withColumns({"token": F.col("_hit.token"), "k": F.col("_hit.k")})
    long = [n for n, p in enumerate(wanted) if len(p) > 1]
    tf = hits.filter(~F.col("token").isin(*long)).groupBy("doc", "token").agg(F.sum(weight * F.col("tf")).alias("f"))
    if long:
        sizes_of = F.coalesce(*[F.when(F.col("token") == n, F.lit(len(wanted[n]))) for n in long])
        starts = hits.filter(F.col("token").isin(*long)).select("doc", "field", "token", "k", F.explode("at").alias("i"))
        whole = starts.groupBy("doc", "field", "token", (F.col("i") - F.col("k")).alias("start")).agg(F.count_distinct("k").alias("n")).filter(F.col("n") == sizes_of)
        tf = tf.union(whole.groupBy("doc", "token").agg(F.sum(weight).alias("f")))
    df = tf.groupBy("token").agg(F.count("*").cast("double").alias("df"))
    stats = sizes.agg(F.count("*").cast("double").alias("n"), F.avg("size").alias("mean"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    rows = tf.join(F.broadcast(df), "token").join(sizes, "doc").join(F.broadcast(stats))
    return rows.groupBy("doc").agg(F.round(-F.sum(part), 9).alias("score")).orderBy("score", "doc").limit(most)


def trigrams(text: Column) -> Column:
    """Distinct lower-case character triples; ё counts as е."""
    low = F.translate(F.lower(text), "ё", "е")
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))).otherwise(F.array().cast("array<string>"))


def trigram_index(entities: DataFrame, key: str, text: str) -> DataFrame:
    """(term, doc): the rows that hold a triple; stored and kept up like postings (write_postings, update_postings)."""
    return entities.select(F.col(key).alias("doc"), F.explode(trigrams(F.col(text))).alias("term")).distinct().select("term", "doc")


def _holding(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc): rows that have all triples of one of the words. Only the words' postings are read."""
    triples = {w: sorted({w[i : i + 3] for i in range(len(w) - 2)}) for w in words}
    read = index.filter(F.col("term").isin(sorted({t for ts in triples.values() for t in ts})))
    of = F.array_compact(F.array(*[F.when(F.col("term").isin(ts), F.lit(n)) for n, ts in enumerate(triples.values())]))
    wanted = F.element_at(F.array(*[F.lit(len(ts)) for ts in triples.values()]), F.col("word") + 1)
    found = read.select("doc", "term", F.explode(of).alias("word")).groupBy("doc", "word").agg(F.count_distinct("term").alias("n"))
    return found.filter(F.col("n") == wanted).select("doc").distinct()


def term_search(entities: DataFrame, key: str, text: str, query: str, most: int = 20, index: DataFrame | None = None) -> DataFrame:
    """(key, matched): rows that hold any word of three characters or more as a substring; most words first, ties by key.

    AND and NOT before a word make it needed or forbidden; a quoted phrase is one word. With a trigram index only rows that have
    the triples of a word are looked at; the answer is the same.
    """
    parts = re.findall(r'"([^"]+)"|(\S+)', query)
    needed, forbidden, wanted, mode = [], [], [], "OR"
    for quoted, plain in parts:
        if plain in ("AND", "OR", "NOT"):
            mode = plain
            continue
        word = (quoted or plain).lower().replace("ё", "е").strip("()*")
        if len(word) >= 3:
            (needed if mode == "AND" else forbidden if mode == "NOT" else wanted).append(word)
        if mode == "AND" and wanted and not forbidden:
            needed = list(dict.fromkeys([*wanted[-1:], *needed]))
        mode = "OR"
    low = F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), "ё", "е")
    has = lambda w: F.contains(low, F.lit(w))
    words = list(dict.fromkeys([*wanted, *needed]))
    score = sum((has(w).cast("long") for w in words), F.lit(0).cast("long"))
    keep = score > 0
    for w in needed:
        keep &= has(w)
    for w in forbidden:
        keep &= ~has(w)
    if index is not None and words:
        entities = entities.join(_holding(index, words).withColumnRenamed("doc", "_doc"), F.col(key) == F.col("_doc"), "left_semi")
    return entities.filter(keep).select(key, score.alias("matched")).orderBy(F.desc("matched"), key).limit(most)


def filtered_search(ranked: DataFrame, files: DataFrame, path_filter: Column, limit: int, compat: bool = False) -> DataFrame:
    """Ranked hits whose file passes a filter. compat: only the best min(5 * limit, 500) are looked at, and prefilter_exhausted
    tells that there were that many."""
    if not compat:
        return ranked.join(files, "doc").filter(path_filter).orderBy("score", "doc").limit(limit)
    fetched = min(5 * limit, 500)
    pool = ranked.orderBy("score", "doc").limit(fetched)
    full = pool.agg((F.count("*") >= fetched).alias("prefilter_exhausted"))
    return pool.join(files, "doc").filter(path_filter).join(F.broadcast(full)).orderBy("score", "doc").limit(limit)
