"""A guarded SQL surface: one read-only query, with parameters, a row limit and a time limit."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

LIMIT, MOST, SECONDS = 500, 5_000, 8.0
#: Features of the dialect that have no equivalent, with the advice that an error gives.
GAPS = (
    (r"\bGLOB\b", "GLOB: use rlike or the file listing"),
    (r"\bEXCLUDE\s+(CURRENT|GROUP|TIES|NO)\b", "EXCLUDE in a window frame"),
    (r"\bGROUPS\s+(BETWEEN|UNBOUNDED|CURRENT|\d)", "GROUPS window frames"),
    (r"\bLIMIT\s+\d+\s*,\s*\d+", "LIMIT m, n: use LIMIT n OFFSET m"),
    (r"\bsqlite_master\b", "the schema table: use catalog()"),
)


#: Functions that run code or tell of files, and table functions that only make rows of their arguments.
FORBIDDEN = ("reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "raise_error", "assert_true")
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "values")


class Refused(ValueError):
    """The text isn't a single read-only query, or uses what isn't supported."""


@dataclass
class Answer:
    columns: list[str]
    rows: list[list[object]]
    row_count: int
    truncated: bool
    limit: int
    hint: str | None = None
    suggestions: list[str] = field(default_factory=list)


def without_comments(sql: str) -> str:
    """The text without comments; what looks like one within quotes stays."""
    token = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`)|--[^\n]*|/\*.*?\*/", re.S)
    return token.sub(lambda m: m[1] or " ", sql).strip()


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _items(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _strings(seq: Any) -> list[str]:
    return [str(x) for x in _items(seq)]


def _nodes(plan: Any) -> Iterator[Any]:
    """All plans and expressions of a parsed plan, those in subqueries and common tables too."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        methods = {m.getName() for m in node.getClass().getMethods() if not m.getParameterCount()}
        for part in ("children", "expressions", "innerChildren"):
            if part in methods:
                todo += [x for x in _items(getattr(node, part)()) if hasattr(x, "getClass") and "children" in {m.getName() for m in x.getClass().getMethods()}]
        if "plan" in methods and "children" in methods and node.getClass().getName().startswith("org.apache.spark.sql.catalyst.expressions"):
            todo.append(node.plan())
        if "cteRelations" in methods:
            todo += [x._2() for x in _items(node.cteRelations())]


def check(spark: SparkSession, sql: str) -> str:
    """The bare query, or Refused. The parsed plan decides: a command anywhere in it is refused, whatever the text looks like."""
    bare = without_comments(sql).rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", bare):
        raise Refused("only SELECT and WITH are allowed")
    outside = re.sub(r"'(?:[^']|'')*'", "''", bare)
    for pattern, what in GAPS:
        if re.search(pattern, outside, re.I):
            raise Refused(f"not supported: {what}")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(bare)  # type: ignore[attr-defined]
    except Exception as e:
        raise Refused(f"syntax error: {str(e).splitlines()[0]}") from e
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if re.match("(InsertInto|Create|Drop|Replace|Alter|Delete|Update|Merge|Set[A-Z]|Truncate|Cache|Uncache|Load|Refresh|Analyze|Overwrite|Append|ScriptTransformation)", name):
            raise Refused("the statement would change something")
        if name == "UnresolvedRelation" and len(_strings(node.multipartIdentifier())) > 1:
            raise Refused("only the tables of the index can be read")
        if name == "UnresolvedTableValuedFunction" and _strings(node.name())[-1].lower() not in TABLE_FUNCTIONS:
            raise Refused(f"the table function {_strings(node.name())[-1]} is not allowed")
        if name == "UnresolvedFunction" and _strings(node.nameParts())[-1].lower() in FORBIDDEN:
            raise Refused(f"the function {_strings(node.nameParts())[-1]} is not allowed")
    return bare


def query(spark: SparkSession, sql: str, params: Sequence[object] | None = None) -> DataFrame:
    """The lazy result of a query that passes the guard. Booleans count as 0 and 1 among the parameters."""
    values = [int(p) if isinstance(p, bool) else p for p in params or []]
    for p in values:
        if not (p is None or isinstance(p, (int, float, str))):
            raise Refused("parameters must be null, boolean, number or text")
    bare = check(spark, sql)
    return spark.sql(bare, args=values) if values else spark.sql(bare)


def catalog(spark: SparkSession) -> DataFrame:
    """(table, column, type) of the session's views."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def explain_error(spark: SparkSession, message: str) -> list[str]:
    """For an unknown column or table: the nearest names, and the tables that own a column of that name."""
    m = re.search(r"(?:column, variable, or function parameter with name|table or view) `?([\w.`]+?)`? cannot", message)
    if not m:
        return []
    name = m[1].replace("`", "").split(".")[-1].lower()
    owned: dict[str, list[str]] = {}
    for t in spark.catalog.listTables():
        owned.setdefault(t.name, [c.name for c in spark.catalog.listColumns(t.name)])
    names = {n for n in owned} if "table or view" in message else {c for cs in owned.values() for c in cs}
    near = sorted((distance(name, n.lower()), n) for n in names)
    out = [n for d, n in near if d <= 6][:3]
    return out + [f"{t}.{name}" for t, cs in sorted(owned.items()) if name in (c.lower() for c in cs)]


def run(spark: SparkSession, sql: str, params: Sequence[object] | None = None, limit: int = LIMIT, seconds: float = SECONDS) -> Answer:
    """At most `limit` rows (5000 at most); cancelled after `seconds`."""
    limit = min(max(limit, 1), MOST)
    try:
        df = query(spark, sql, params)
    except (AnalysisException, ParseException) as e:
        near = explain_error(spark, str(e))
        raise Refused(f"{str(e).splitlines()[0]}" + (f" Did you mean: {', '.join(near)}?" if near else "")) from e
    tag = f"guard-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, spark.interruptTag, [tag])
    spark.addTag(tag)
    timer.start()
    try:
        rows = df.limit(limit + 1).collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)
    cell = lambda v: {"_blob_bytes": len(v)} if isinstance(v, (bytes, bytearray)) else v
    out = [[cell(v) for v in r] for r in rows[:limit]]
    own = re.search(r"(?i)\blimit\s+(\d+)\s*$", without_comments(sql).rstrip(";"))
    hint = "the query's own LIMIT was reached" if own and int(own[1]) == len(out) else None
    return Answer(df.columns, out, len(out), len(rows) > limit, limit, hint)


def search_words(sql: str) -> list[str]:
    """Words of three characters or more in the string literals: what to search for when a query finds nothing."""
    said = " ".join(re.findall(r"'((?:[^']|'')*)'", sql))
    return list(dict.fromkeys(w for w in re.findall(r"\w{3,}", said.replace("%", " "))))


def renamed_types(sql: str, names: Mapping[str, str]) -> str:
    """String literals with the object-type prefix before a dot replaced by its canonical name."""

    def fix(m: re.Match[str]) -> str:
        head, dot, rest = m[1].partition(".")
        return f"'{names.get(head, head)}{dot}{rest}'" if dot else m[0]

    return re.sub(r"'((?:[^']|'')*)'", fix, sql)
