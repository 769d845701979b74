"""Exact lookup with fallbacks, suggestions and symbol search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.text import matches_glob

#: More hits than this are given as places only; of those and of each category of symbols, this many are listed.
PLACES_FROM, CATEGORY = 5, 50


def exact(entities: DataFrame, names: Sequence[str], path_glob: str | None = None) -> DataFrame:
    """Entities with one of the names or qualified names: all names in one scan."""
    hit = F.col("name").isin(*names)
    if "qualified_name" in entities.columns:
        hit |= F.col("qualified_name").isin(*names)
    found = entities.filter(hit)
    return found.filter(matches_glob(F.col("path"), path_glob)) if path_glob else found


def resolve(entities: DataFrame, name: str) -> DataFrame:
    """Exact matches, or else matches in any case, with `matched` saying which; in one plan and one scan.

    The best kind of match is the maximum over all hits, so nothing has to be counted first.
    """
    lower = name.lower()
    rank = F.when(F.col("name") == name, 2).when(F.lower("name") == lower, 1)
    hits = entities.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    best = hits.agg(F.max("_rank").alias("_best"))
    return hits.join(F.broadcast(best), F.col("_rank") == F.col("_best")).withColumn("matched", F.when(F.col("_rank") == 2, "exact").otherwise("ignoring case")).drop("_rank", "_best")


def places(found: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """The first CATEGORY hits with the total; beyond PLACES_FROM hits they come without bodies, as places."""
    total = found.agg(F.count("*").alias("total"))
    first = found.orderBy(*keys).limit(CATEGORY).join(F.broadcast(total))
    return first.withColumn(body, F.when(F.col("total") <= PLACES_FROM, F.col(body)))


def suggest(names: DataFrame, wanted: str, column: str = "name", most: int = 5) -> DataFrame:
    """(name, distance): nearest names by edit distance, ties by name.

    Candidates share a beginning of 12, 9 or 6 characters with the wanted name as it is, in lower case or capitalised. A longer
    candidate may also match by its head, at one more. Distances beyond a third of the length (3 at least) don't count.
    """
    heads = sorted({form[:n] for n in (12, 9, 6) for form in (wanted, wanted.lower(), wanted.capitalize()) if len(wanted) >= 1})
    start = F.lit(False)
    for head in heads:
        start |= F.col(column).startswith(head)
    own, target = F.lower(F.col(column)), F.lit(wanted.lower())
    whole = F.levenshtein(own, target)
    head = F.when(F.length(own) > len(wanted), F.levenshtein(F.substring(own, 1, len(wanted)), target) + 1)
    found = names.filter(start).select(F.col(column).alias("name")).distinct()
    own, whole = F.lower("name"), F.levenshtein(F.lower("name"), target)
    head = F.when(F.length("name") > len(wanted), F.levenshtein(F.substring(own, 1, len(wanted)), target) + 1)
    near = found.select("name", F.coalesce(F.least(whole, head), whole).cast("long").alias("distance"))
    return near.filter(F.col("distance") <= max(len(wanted) // 3, 3)).orderBy("distance", "name").limit(most)


def find_symbol(name: str, functions: DataFrame, classes: DataFrame, variables: DataFrame, imports: DataFrame, files: DataFrame | None = None, language: str | None = None, most: int = CATEGORY) -> DataFrame:
    """(category, name, detail, file_id, line): up to `most` of each category by file and line.

    A language restricts all categories but variables.
    """

    def rows(df: DataFrame, category: str, hit: F.Column, detail: str, line: str, scoped: bool = True) -> DataFrame:
        found = df.filter(hit)
        if language and scoped and files is not None:
            found = found.join(files.filter(F.col("language") == language).select("file_id"), "file_id", "left_semi")
        return found.select(F.lit(category).alias("category"), "name", F.col(detail).cast("string").alias("detail"), "file_id", F.col(line).cast("long").alias("line"))

    named = F.col("name") == name
    both = (
        rows(functions, "function", named | (F.col("qualified_name") == name), "qualified_name", "line_start")
        .unionByName(rows(classes, "class", named, "bases", "line_start"))
        .unionByName(rows(variables, "variable", named, "value", "line", scoped=False))
        .unionByName(rows(imports, "import", named | (F.col("alias") == name), "module", "line"))
    )
    rank = F.row_number().over(Window.partitionBy("category").orderBy("file_id", "line", "detail"))
    return both.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")


def imports_of(imports: DataFrame, file_id: int | None = None, module: str | None = None, most: int = 200) -> DataFrame:
    """Imports of a file or of a module; one of the two must be given."""
    if file_id is None and module is None:
        raise ValueError("file_id or module is required")
    hit = F.col("file_id") == file_id if file_id is not None else F.col("module") == module
    return imports.filter(hit).orderBy("file_id", "line", "name").limit(most)


def known(symbol: str, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: whether the symbol is a function or at either end of a call."""
    hits = functions.filter(F.col("name") == symbol).select(F.lit(1).alias("x")).limit(1).union(calls.filter((F.col("caller") == symbol) | (F.col("callee") == symbol)).select(F.lit(1)).limit(1))
    return hits.agg((F.count("*") > 0).alias("known"))


def resolve_objects(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, full_name): each wanted name's object by its exact name, or else the first in any case, or else null."""
    asked = wanted.select(F.col("wanted"), F.lower("wanted").alias("_key"))
    same = objects.select("full_name", F.lower("full_name").alias("_key")).groupBy("_key").agg(F.min("full_name").alias("_first"), F.collect_set("full_name").alias("_all"))
    found = asked.join(same, "_key", "left")
    return found.select("wanted", F.when(F.array_contains("_all", F.col("wanted")), F.col("wanted")).otherwise(F.col("_first")).alias("full_name"))


def name_like(objects: DataFrame, part: str, meta_type: str | None = None, most: int = 50) -> DataFrame:
    """Objects whose name has the part in any case; `more`: there are others beyond the first `most`."""
    hit = F.contains(F.lower("full_name"), F.lit(part.lower()))
    if meta_type:
        hit &= F.split("full_name", r"\.")[0] == meta_type
    found = objects.filter(hit).orderBy("full_name").limit(most + 1)
    rank, total = F.row_number().over(Window.orderBy("full_name")), F.count("*").over(Window.partitionBy())
    return found.withColumn("_n", rank).withColumn("more", total > most).filter(F.col("_n") <= most).drop("_n")


def similar_objects(objects: DataFrame, wanted: str, most: int = 8) -> DataFrame:
    """Objects that begin like the wanted name, those of its own type first."""
    kind, _, own = wanted.partition(".")
    head = (own or kind)[:6].lower()
    parts = F.split("full_name", r"\.")
    found = objects.filter(F.lower(F.element_at(parts, -1)).startswith(head)).select("full_name", (parts[0] == kind).alias("same_type"))
    return found.orderBy(F.desc("same_type"), "full_name").limit(most)
