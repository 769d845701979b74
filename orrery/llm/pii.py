"""Personal data: fixed patterns, and terms that give a protected entity away.

Base spans are matches of four patterns. Beyond them, co-occurrence over the corpus estimates how
much a term reveals: a term that stands next to one entity in several contexts, and nearly nowhere else,
identifies it even where the entity itself is masked. Such terms are found by their pointwise mutual
information with the entity and generalised or removed wherever they occur.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, clear_name, isolated, let, settled

#: Kinds in output order, with the pattern, a cheap test that holds for every text with a valid match, and the tag that
#: replaces one. Possessive forms of the stated patterns: they match the same, without recursion or quadratic time.
KINDS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "[EMAIL]"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", "[IP]"),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++", r"(?:[0-9][\x20-]?){12}[0-9]", "[CARD]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "[PHONE]"),
)
#: A term: a run of letters of this length or more, in lower case.
TERM = r"\p{L}{3,}+"
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Values of a run of a scan, and code points of a piece of a text: they bound the work for one span, not what is found.
RUN, PIECE = 64, 2048


@dataclass(frozen=True)
class Disclosure:
    """When a term discloses an entity. `window`: words on either side that count as next to it; `support`: distinct
    contexts needed; `share`: of the distinct texts with the term, how many have it next to the entity; `bits`: mutual information
    needed; `remove`: share from which the term is removed and not just generalised."""

    window: int = 3
    support: int = 3
    share: float = 0.5
    bits: float = 6.0
    remove: float = 0.8


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        low = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), low)
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _running(values: Column, op: Callable[[Column, Column], Column], zero: Column, depth: int = 4) -> Column:
    """Fold of the values before each one (exclusive scan), and last the fold of all.

    Values are dealt to short runs and the runs' folds are scanned the same way, so that no array grows step by step with the
    number of values.
    """
    kind = "array<int>"

    def plain(run: Column) -> Column:
        grow = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(run, F.struct(zero.alias("at"), F.array().cast(kind).alias("out")), grow, lambda s: F.concat(s["out"], F.array(s["at"])))

    if depth == 1:
        return plain(values)

    def by_runs(values: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, RUN))

        def added(runs: Column) -> Column:
            bases = _running(F.transform(runs, lambda r: F.aggregate(r, zero, op)), op, zero, depth - 1)
            inside = lambda bases: F.concat(
                F.flatten(F.transform(runs, lambda r, k: F.transform(F.slice(plain(r), F.lit(1), F.size(r)), lambda x: op(F.get(bases, k), x)))), F.slice(bases, -1, 1)
            )
            return let(bases, inside)

        return F.when(F.size(values) > RUN, let(runs, added)).otherwise(plain(values))

    return let(values, by_runs)


def _matches(text: Column, pattern: str, kind: Callable[[Column], Column]) -> Column:
    """All matches in order: array of struct(kind, start, end, value), in code points.

    Positions come from the lengths of what lies between the matches, so one pass finds all.
    """

    def placed(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def spans(ends: Column) -> Column:
            end = lambda i: F.get(ends, i + 1)
            return F.transform(found, lambda m, i: F.struct(kind(m).alias("kind"), (end(i) - F.length(m)).alias("start"), end(i).alias("end"), m.alias("value")))

        return F.when(F.size(found) > 0, let(_running(sizes, lambda a, x: a + x, F.lit(0)), spans)).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: let(F.split(text, pattern, -1), lambda g: placed(m, g)))


def _found(kind: str, pattern: str, test: str, text: Column) -> Column:
    """Valid matches of one kind, in order."""
    hit = F.contains(text, F.lit(test)) if test == "@" else text.rlike(test)
    spans = F.filter(_matches(text, pattern, lambda m: F.lit(kind)), lambda s: _valid(kind, s["value"]))
    return F.when(hit, spans).otherwise(F.array().cast(SPANS))


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, by which _cut() finds its way."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)


def _cut(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b of the text: only the pieces in between are read."""
    first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
    at, to = a % PIECE, (b - 1) % PIECE + 1
    across = F.concat(
        F.substring(F.get(pieces, first), at + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.substring(F.get(pieces, last), F.lit(1), to)
    )
    return F.when(b <= a, F.lit("")).when(first == last, F.substring(F.get(pieces, first), at + 1, b - a)).otherwise(across)


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds, by kind in the fixed order, then by start; null: none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_found(kind, pattern, test, text) for kind, pattern, test, _ in KINDS])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.xxhash64(span["kind"], value)


def disclosing_terms(texts: DataFrame, rule: Disclosure = Disclosure()) -> tuple[DataFrame, DataFrame]:
    """From (_row, _text): terms that disclose (term, share, bits, remove), and the rows that have them (_row, term).

    Counts cover all rows, in distinct texts: copies of a document neither prove nor hide anything. Contexts that are the
    same word for word support a term once.
    A null or empty text adds nothing.
    """
    near = 40 * rule.window
    texts = texts.filter("_text <> ''").withColumn("_unit", F.xxhash64("_text"))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TERM), 0)

    def contexts(spans: Column, pieces: Column, size: Column) -> Column:
        """Each span's entity, whether it is the entity's first in the row, and the words on either side."""
        sides = F.sort_array(F.transform(spans, lambda s: F.struct(_entity(s).alias("entity"), s["start"].alias("start"), s["end"].alias("end"))))
        left = lambda s: words(_cut(pieces, F.greatest(F.lit(0), s["start"] - near), s["start"]))
        right = lambda s: words(_cut(pieces, s["end"], F.least(size, s["end"] + near)))
        first = lambda found, s, i: (i == 0) | (F.get(found, i - 1)["entity"] != s["entity"])
        one = lambda found: lambda s, i: F.struct(s["entity"].alias("entity"), first(found, s, i).alias("first"), F.reverse(left(s)).alias("before"), right(s).alias("after"))
        return let(sides, lambda found: F.transform(found, one(found)))

    spans = let(base_spans(F.col("_text")), lambda ss: F.when(F.size(ss) > 0, let(_pieces(F.col("_text")), lambda p: let(F.length("_text"), lambda n: contexts(ss, p, n)))))
    beside = texts.select("_unit", F.explode(spans).alias("s")).select("_unit", "s.entity", "s.first", "s.before", "s.after")
    beside = beside.select("_unit", "entity", "first", F.slice("before", 1, rule.window).alias("before"), F.slice("after", 1, rule.window).alias("after"))
    beside = settled(beside.select("_unit", "entity", "first", F.xxhash64("before", "after").alias("context"), F.array_distinct(F.concat("before", "after")).alias("terms")), "pii-beside")
    stands = beside.select("_unit", "entity", "context", F.explode("terms").alias("term"))
    pairs = stands.groupBy("term", "entity").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("_unit").alias("together"))
    # A term stands in at least the texts in which it is beside some entity, several of one text counted once; so what is
    # left out before the corpus is searched has too small a share, or too little information, for certain.
    pairs = pairs.filter(F.col("contexts") >= rule.support).join(stands.groupBy("term").agg(F.count_distinct("_unit").alias("beside")), "term")
    # How often the entity stands in the corpus: the lesser of its rates among rows and among distinct texts, so that copies
    # of its documents don't make it common.
    total = texts.groupBy("_unit").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("texts")).first()
    rates = beside.groupBy("entity", "_unit").agg(F.sum(F.col("first").cast("long")).alias("n")).groupBy("entity")
    rates = rates.agg(F.least(F.sum("n") / F.lit(total["rows"] or 1), F.count("*") / F.lit(total["texts"] or 1)).alias("rate"))
    # log2 P(entity | term) / P(entity).
    tells = lambda share: (share >= rule.share) & (F.log2(share / F.col("rate")) >= rule.bits)
    pairs = settled(pairs.join(rates, "entity").filter(tells(F.col("together") / F.col("beside"))), "pii-pairs")
    terms = bounded(pairs.select("term").distinct())
    own = texts.select("_row", "_unit", F.explode(F.array_distinct(words(F.col("_text")))).alias("term"))
    rows = settled(own.join(terms, "term", "left_semi").distinct(), "pii-rows")
    everywhere = rows.groupBy("term").agg(F.count_distinct("_unit").alias("rows"))
    share = F.col("together") / F.greatest("rows", "beside")
    found = pairs.join(everywhere, "term").filter(tells(share)).select("term", share.alias("share"), F.log2(share / F.col("rate")).alias("bits"))
    # The entity that the term gives away most.
    found = found.groupBy("term").agg(F.max(F.struct("share", "bits")).alias("b")).select("term", "b.share", "b.bits")
    found = settled(found.withColumn("remove", F.col("share") >= rule.remove), "pii-terms")
    return found, rows.select("_row", "term")


def _term_spans(text: Column, terms: Column) -> Column:
    """Occurrences of the terms: struct(kind, start, end, value); kind is name (capitalised), term, or dropped (to be removed)."""
    hit = lambda m: F.filter(terms, lambda t: t["term"] == F.lower(m))
    shape = lambda m: F.when(m.rlike(r"^\p{Lu}"), "name").otherwise("term")
    kind = lambda m: let(hit(m), lambda h: F.when(F.size(h) == 0, "").when(F.get(h, F.lit(0))["remove"], "dropped").otherwise(shape(m)))
    found = F.filter(_matches(text, TERM, kind), lambda s: s["kind"] != "")
    return F.when(F.size(terms) > 0, found).otherwise(F.array().cast(SPANS))


def detect(docs: DataFrame, rule: Disclosure = Disclosure(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of `docs` and `pii`: struct(spans, extra) of base spans and of disclosing terms.

    Null or empty text: no spans. Repeated rows get the same spans each. Other columns are untouched; if one is named `pii`, the
    new one gets a leading underscore.
    """
    safe, own = isolated(docs)
    into, text, key = clear_name(docs, "pii"), own[text], own[key]
    row = F.xxhash64(F.col(key), F.col(text))
    texts = safe.select(row.alias("_row"), F.col(text).alias("_text"))
    found, rows = disclosing_terms(texts, rule)
    held = rows.join(bounded(found), "term").groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("term", "remove"))).alias("_terms"))
    held = bounded(settled(held, "pii-held").withColumnRenamed("_row", "_row_of"))
    out = safe.withColumn("_row", row).join(held, F.col("_row") == F.col("_row_of"), "left")
    none = F.array().cast("array<struct<term:string,remove:boolean>>")
    clean = F.coalesce(F.col(text), F.lit(""))
    return out.select(
        *[F.col(a).alias(c) for c, a in own.items()],
        F.struct(base_spans(F.col(text)).alias("spans"), let(F.coalesce("_terms", none), lambda t: _term_spans(clean, t)).alias("extra")).alias(into),
    )


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and joined spans of what detect() found, in its last column. n_spans: all spans, the added ones included."""
    spans, extra = F.col(f"{found.columns[-1]}.spans"), F.col(f"{found.columns[-1]}.extra")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(spans)
    # Base spans come before those that the method adds; the added ones share one kind name here.
    added = F.transform(extra, lambda s: s.withField("kind", F.lit("term")))
    total = F.size(F.concat(spans, extra)).cast("long").alias("n_spans")
    return found.select(F.col(key), *[count(kind) for kind, *_ in KINDS], F.sha2(base, 256).alias("base_sha256"), _joined(F.concat(spans, added)).alias("spans"), total)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its tag; spans that overlap become the tag of the first."""
    tags = {kind: tag for kind, _, _, tag in KINDS} | {"name": "[NAME]", "term": "[TERM]", "dropped": ""}
    tag = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in tags.items()])

    def replaced(ordered: Column, pieces: Column) -> Column:
        def joined(at: Column) -> Column:
            """at: where what is done so far ends, before each span and after all."""
            fresh = lambda s, i: F.when(s["start"] >= F.get(at, i), F.concat(_cut(pieces, F.get(at, i), s["start"]), tag(s["kind"]))).otherwise("")
            rest = _cut(pieces, F.get(at, F.size(ordered)), F.length(text))
            return F.array_join(F.concat(F.transform(ordered, fresh), F.array(rest)), "")

        return let(_running(F.transform(ordered, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0)), joined)

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, let(ordered, lambda o: let(_pieces(text), lambda p: replaced(o, p)))).otherwise(text)


def mask(docs: DataFrame, rule: Disclosure = Disclosure(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with the same columns, its text sanitised; a null text stays null."""
    safe, own = isolated(docs)
    found = detect(safe, rule, own[text], own[key])
    masked = sanitised(F.col(own[text]), F.concat("pii.spans", "pii.extra"))
    return found.select(*[(masked if c == text else F.col(a)).alias(c) for c, a in own.items()])
