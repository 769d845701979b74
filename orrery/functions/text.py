"""Text expressions: globs, regular expressions, snippets, line slices and identifier terms."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most patterns that the braces of a glob may expand to.
BRACES = 64


def expand_braces(glob: str) -> list[str]:
    """Alternatives of {a,b} groups, in order; nested groups and too many alternatives are left as they are."""
    parts: list[list[str]] = []
    at = 0
    for m in re.finditer(r"\{([^{}]*)\}", glob):
        parts += [[glob[at : m.start()]], m[1].split(",")]
        at = m.end()
    parts.append([glob[at:]])
    size = 1
    for p in parts:
        size *= len(p)
    if size > BRACES or glob.count("{") != glob.count("}") or re.search(r"\{[^}]*\{", glob):
        return [glob]
    return ["".join(x) for x in product(*parts)]


def glob_variants(glob: str) -> list[str]:
    """Globs in which a star stands for any characters, slashes too: `**/` may also stand for no folder at all."""
    out: list[str] = []
    for one in expand_braces(glob):
        for variant in (one, one.replace("**/", "")) if "**/" in one else (one,):
            flat = re.sub(r"\*+", "*", variant)
            if flat not in out:
                out.append(flat)
    return out


def glob_regex(glob: str) -> str:
    """An anchored regular expression: star, question mark and [classes]; all else is literal."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "^!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/-" else c
        i += 1
    return f"(?s)^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    """Case-sensitive. A glob that is a literal beginning and one star becomes a prefix test, which the scan can use."""
    tests = []
    for variant in glob_variants(glob):
        head = variant.rstrip("*")
        plain = not re.search(r"[*?\[]", head)
        tests.append(path.startswith(head) if plain and variant.endswith("*") else path == variant if plain else path.rlike(glob_regex(variant)))
    out = tests[0]
    for t in tests[1:]:
        out |= t
    return out


def has_match(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Multi-line regular expression over text with LF line ends."""
    flags = "(?miu)" if ignore_case else "(?m)"
    return F.regexp_replace(text, "\r\n", "\n").rlike(flags + pattern)


def literal(text: str) -> str:
    """A pattern for exactly this text."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def lines(text: Column) -> Column:
    """Lines without their ends; a final newline ends the last line and starts none."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n\z", ""), "\n")


def line_slice(text: Column, first: int, last: int, most: int = 5_000) -> Column:
    """Lines first..last, 1-based and inclusive, at most `most` of them."""
    count = max(0, min(last - first + 1, most))
    return F.array_join(F.slice(lines(text), max(1, first), count), "\n")


def snippet(text: Column, token: str, around: int = 80) -> Column:
    """The surroundings of the first occurrence in any case, white space collapsed, marked where it is cut; null: none."""
    at = F.instr(F.lower(text), token.lower())
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text), at + len(token) - 1 + around)
    body = F.trim(F.regexp_replace(F.substring(text, start, end - start + 1), r"\s+", " "))
    marked = F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at > 0, marked)


def head_tail(body: Column, limit: int = 15_000, head: int = 60, tail: int = 40) -> Column:
    """A long body as its first and last lines with a marker between them."""
    rows = F.split(body, "\n")
    cut = F.size(rows) - head - tail
    short = F.concat_ws("\n", F.array_join(F.slice(rows, 1, head), "\n"), F.concat(F.lit("… "), cut.cast("string"), F.lit(" lines omitted …")), F.array_join(F.slice(rows, -tail, tail), "\n"))
    return F.when((F.length(body) > limit) & (cut > 0), short).otherwise(body)


def identifier_words(name: Column) -> Column:
    """Lower-case words of an identifier: split at other characters, case changes, digits, scripts and ends of acronyms."""
    marked = name
    for pattern, to in (
        (r"[^\p{L}\p{N}]+", " "),
        (r"(\p{Ll})(\p{Lu})", "$1 $2"),
        (r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2"),
        (r"(\p{L})(\p{N})", "$1 $2"),
        (r"(\p{N})(\p{L})", "$1 $2"),
        (r"([\p{IsLatin}])([\p{IsCyrillic}])", "$1 $2"),
        (r"([\p{IsCyrillic}])([\p{IsLatin}])", "$1 $2"),
    ):
        marked = F.regexp_replace(marked, pattern, to)
    return F.array_remove(F.split(F.translate(F.lower(marked), "ё", "е"), " +"), "")


def leading_comment(body: Column, mark: str = "//", most: int = 240) -> Column:
    """Text of the comment lines at the start of a body; annotations and bars of signs are passed over."""
    rows = F.transform(F.split(body, "\n"), lambda x: F.trim(x))
    stop = F.array_position(F.transform(rows, lambda x: ~(x.startswith(mark) | x.startswith("&") | (x == ""))), True)
    held = F.when(stop > 0, F.slice(rows, F.lit(1), stop.cast("int") - 1)).otherwise(rows)
    said = F.transform(F.filter(held, lambda x: x.startswith(mark)), lambda x: F.trim(F.substring(x, F.lit(len(mark) + 1), F.length(x))))
    return F.substring(F.array_join(F.filter(said, lambda x: x.rlike(r"[\p{L}\p{N}]")), " "), 1, most)


def terms(*parts: Column) -> Column:
    """Words of several parts (arrays or strings), without repeats, joined by commas."""
    return F.array_join(F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda x: x != "")), ", ")
