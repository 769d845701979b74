"""Keyed merges, snapshots and differences: immutable tables in place of row updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last in the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", rank).filter(F.col("_n") == 1).drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `old` whose key `new` doesn't have, and all of `new`."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of `old`, and one row for each further key of `new`."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys).distinct(), list(keys), "left_anti")
    return old.unionByName(fresh)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't among the deleted; used for cascades as well."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def delete_prefix(rows: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    """Rows whose path doesn't start with the prefix, taken literally."""
    return rows.filter(~F.col(column).startswith(prefix))


def file_changes(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, change): new, changed, touched (same content, other time or size), same or deleted.

    stored, seen: (path, content_hash, mtime, file_size).
    """
    names = ("content_hash", "mtime", "file_size")
    a = stored.select("path", *[F.col(c).alias(f"_a_{c}") for c in names], F.lit(True).alias("_in_a"))
    b = seen.select("path", *[F.col(c).alias(f"_b_{c}") for c in names], F.lit(True).alias("_in_b"))
    same = lambda c: F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    change = (
        F.when(F.col("_in_b").isNull(), "deleted")
        .when(F.col("_in_a").isNull(), "new")
        .when(~same("content_hash"), "changed")
        .when(~same("mtime") | ~same("file_size"), "touched")
        .otherwise("same")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def unchanged_fast(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed files that must be read: those without a stored row of the same path, time and size."""
    return listed.join(stored.select("path", "mtime", "file_size"), ["path", "mtime", "file_size"], "left_anti")


def reconcile(stored: DataFrame, declared: DataFrame, key: str = "full_name", version: str = "config_version") -> DataFrame:
    """(key, state): added, updated, removed or kept, from two manifests."""
    a = stored.select(key, F.col(version).alias("_a"), F.lit(True).alias("_in_a"))
    b = declared.select(key, F.col(version).alias("_b"), F.lit(True).alias("_in_b"))
    state = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "updated").otherwise("kept")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def reconcile_area(stored: DataFrame, declared: DataFrame, objects: DataFrame, area: str) -> DataFrame:
    """(full_name, state, action): one area's manifest against the stored ones (area, full_name, config_version), unchanged names left out.

    objects: (full_name, home), the area that an object belongs to. An object that its home no longer declares is dropped with
    all that hangs on it; one that another area has let go is merged again from the areas that are left.
    """
    own = stored.filter(F.col("area") == area)
    changed = reconcile(own, declared).filter("state <> 'kept'")
    home = objects.select("full_name", "home").dropDuplicates(["full_name"])
    action = F.when((F.col("state") == "removed") & (F.col("home") == area), "drop").when((F.col("state") == "removed") & F.col("home").isNotNull(), "merge")
    return changed.join(home, "full_name", "left").select("full_name", "state", action.alias("action"))


#: Tables of a configuration, with the columns that name an object and whether its parts (Type.Name.Part) go with it.
OWNED = {"objects": {"full_name": True}, "links": {"from_object": False, "to_object": False}, "forms": {"owner_full_name": False}, "modules": {"object_name": False}, "manifest": {"full_name": True}}


def drop_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables (see OWNED) without the rows of the objects in `gone` (full_name), their parts included; other tables stay as they are."""
    names = gone.select(F.col("full_name").alias("_gone")).distinct()

    def without(rows: DataFrame, column: str, parts: bool) -> DataFrame:
        if not parts:
            return rows.join(names, F.col(column) == F.col("_gone"), "left_anti")
        # Every dotted beginning of a name is looked up: an equality join, not one by prefix.
        split = F.split("_name", r"\.")
        begins = F.transform(F.sequence(F.lit(1), F.size(split)), lambda n: F.array_join(F.slice(split, F.lit(1), n), "."))
        hit = rows.select(F.col(column).alias("_name")).distinct().select("_name", F.explode(begins).alias("_gone")).join(names, "_gone", "left_semi")
        return rows.join(hit.select("_name").distinct(), F.col(column) == F.col("_name"), "left_anti")

    out = dict(tables)
    for table, columns in OWNED.items():
        for column, parts in columns.items():
            if table in out:
                out[table] = without(out[table], column, parts)
    return out


def edge_delta(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that were added and those that are gone."""
    return new.exceptAll(old), old.exceptAll(new)


def fresh_rows(rows: DataFrame, sent: DataFrame, scope: str) -> DataFrame:
    """Rows that weren't delivered yet in a scope. sent: (scope, row_hash)."""
    names = rows.columns
    marked = rows.withColumn("row_hash", F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})))
    return marked.join(sent.filter(F.col("scope") == scope).select("row_hash"), "row_hash", "left_anti").select(*names)
