"""Quality rules: a threshold table compiled into one projection.

Each rule names a measure of the text and the range that it may have. Measures are SQL
expressions over the words and lines of the whole text, so the verdicts come out of a map-only
plan: no shuffle, no user function, one pass over the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, clear_name, isolated, let, words_of

#: Frequent function words of the languages that are expected.
STOP_WORDS = (
    "the of and to in a is that for it was on as with by at from this be are or an "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans a par sur au il "
    "de la que el en y a los del se las por un para con no una su al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high]; None: open on that side. Ratios: a zero denominator gives 0. base: the rule decides
    base_failed. languages: only texts that are marked with one of them are judged."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    base: bool = False
    languages: tuple[str, ...] = ()


#: Production thresholds. The base rules come first.
RULES = (
    Rule("words", "n_words", 50, None, base=True),
    Rule("repeated_windows", "n_repeat_words / n_words", None, 0.5, base=True),
    Rule("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbol_to_word", "n_symbols / n_words", None, 0.1),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None, languages=("en", "de", "fr", "es")),
    Rule("upper_case", "n_upper / n_letters", None, 0.4),
    Rule("exclamations", "n_exclaim / n_words", None, 0.2),
    Rule("letters", "n_letters / word_chars", 0.6, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullets / n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipses / n_lines", None, 0.5),
)


#: Counts of a text, in the order of the struct.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullets", "n_ellipses", "n_stop_words", "n_letters", "n_upper", "n_exclaim")


def _count_of(text: Column, kept: str) -> Column:
    """Number of characters of a class: what is left when runs of others are removed."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Positions that lie in a three-word window found at least twice.

    Windows are compared by 64-bit hashes of their words. They are sorted with their positions, so
    the cost is n log n for a text of any length.
    """
    hashes = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(positions, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")

    def repeated(pairs: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        hit = F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def count(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(pairs, repeated))

    return let(hashes, count)


def measures(text: Column) -> Column:
    """One struct with all counts of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})

    def of(words: Column, lines: Column) -> Column:
        size = lambda c: F.size(c).cast("long")
        return F.struct(
            size(words).alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _count_of(text, "#*$%&|<>").alias("n_symbols"),
            (size(lines) - size(F.array_distinct(lines))).alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            size(lines).alias("n_lines"),
            size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]\s"))).alias("n_bullets"),
            size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).alias("n_ellipses"),
            size(F.filter(words, lambda w: w.isin(stop))).alias("n_stop_words"),
            _count_of(text, r"\p{L}").alias("n_letters"),
            _count_of(text, r"\p{Lu}").alias("n_upper"),
            _count_of(text, "!").alias("n_exclaim"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return let(words_of(text), lambda w: let(lines, lambda x: of(w, x)))


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of `docs` and `quality`, a struct of the counts, base_failed, failed (names of rules) and kept.

    Null and empty texts have counts of zero and fail the base rules. Repeated rows are judged one by
    one. Rules for some languages judge no row whose `lang` is null or another one, and none if there is no such column. If `docs` has a
    column named quality, the new one gets a leading underscore.
    """
    mark = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    return docs.withColumn(clear_name(docs, "quality"), let(measures(F.col(text)), lambda m: _judged(m, mark, rules)))


def _judged(m: Column, lang: Column, rules: tuple[Rule, ...]) -> Column:
    """The measures and the verdict. One expression: a filter on it that Spark moves down computes the measures once."""

    def value(rule: Rule) -> Column:
        top, _, bottom = rule.measure.partition(" / ")
        return F.when(m[bottom] > 0, m[top] / m[bottom]).otherwise(0.0) if bottom else m[top]

    def broken(rule: Rule) -> Column:
        low = value(rule) < rule.low if rule.low is not None else F.lit(False)
        out = low | (value(rule) > rule.high) if rule.high is not None else low
        return out & F.coalesce(lang.isin(*rule.languages), F.lit(False)) if rule.languages else out

    base = reduce(or_, [broken(r) for r in rules if r.base], F.lit(False))
    failed = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]))
    return let(failed, lambda f: F.struct(*[m[c].alias(c) for c in MEASURES], base.alias("base_failed"), f.alias("failed"), (F.size(f) == 0).alias("kept")))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs` that break no rule, with the columns that `docs` has."""
    safe, own = isolated(docs)
    return verdicts(safe, rules, own[text], own.get(lang, "")).filter("quality.kept").select(*[F.col(a).alias(c) for c, a in own.items()])
