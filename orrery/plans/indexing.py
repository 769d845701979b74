"""The indexing job: from a file tree to entity tables, whole or for what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import lines
from orrery.operators import extract, merge
from orrery.session import settled
from orrery.sources import files as sources


def entities(loaded: DataFrame) -> dict[str, DataFrame]:
    """Entity tables of loaded files (see orrery.sources.files.loaded), each with `path` and a key from its place."""
    known = loaded.withColumns({"file_id": F.xxhash64("path"), "lines_total": F.when(F.col("content").isNotNull(), F.size(lines(F.col("content")))).cast("long")})
    known = settled(known, "index-files")
    code, searched = sources.parts(known)
    rows = extract.extract(code).withColumns({"file_id": F.xxhash64("path"), "id": F.xxhash64("path", "entity", "name", "line_start", "line_end", "qualified_name", "detail")})
    # Files are read once and parsed once; each table then reads its own part.
    rows = settled(rows, "index-entities", ["entity"])
    kind = lambda k: extract.entity(rows, k)
    doc = F.lit(None).cast("string").alias("docstring")
    return {
        "files": known.select("file_id", "path", "content_hash", "language", "lines_total", "mtime", "file_size"),
        "functions": kind("function").select("id", "file_id", "path", "name", "qualified_name", "line_start", "line_end", F.col("detail").alias("args"), doc, "body", F.col("kind").eqNullSafe("async").alias("is_async"), "node_hash"),
        "classes": kind("class").select("id", "file_id", "path", "name", "line_start", "line_end", F.col("detail").alias("bases"), doc, "body", "node_hash"),
        "imports": kind("import").select("file_id", "path", F.col("detail").alias("module"), "name", F.col("name").alias("alias"), F.col("line_start").alias("line"), "kind"),
        "calls": kind("call").select("file_id", "path", "caller", F.col("name").alias("callee"), F.col("line_start").alias("line")),
        "variables": kind("variable").select("file_id", "path", "name", F.col("detail").alias("value"), F.col("line_start").alias("line")),
        "texts": searched.select("file_id", "path", "content"),
        "codes": code.select("file_id", "path", "content", "oversize"),
    }


def index(spark: SparkSession, root: str, **options: object) -> dict[str, DataFrame]:
    """Tables of a whole tree."""
    return entities(sources.loaded(sources.scan(spark, root, **options)))  # type: ignore[arg-type]


def update(tables: dict[str, DataFrame], scanned: DataFrame) -> dict[str, DataFrame]:
    """Tables after a new scan: files of the same path, time and size aren't opened; rows of changed and vanished ones go.

    Gives what index() would give for the tree as it is now.
    """
    stored = tables["files"]
    unread = settled(merge.unchanged_fast(stored, scanned), "index-unread")
    fresh = entities(sources.loaded(unread))
    gone = stored.select("path").join(scanned.select("path"), "path", "left_anti").union(unread.select("path"))
    return {name: merge.delete_keys(df, gone, ["path"]).unionByName(fresh[name]) for name, df in tables.items()}
