"""Adapters: the driver's tables seen as the entities of a code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def key(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


class Tables:
    """Entity tables over the Parquet files of one folder; every method gives a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def views(self, names: tuple[str, ...] = NAMES) -> SparkSession:
        """A session of its own, with the raw tables as views."""
        own = self.spark.newSession()
        for name in names:
            own.read.parquet(f"{self.folder}/{name}.parquet").createOrReplaceTempView(name)
        return own

    def files(self) -> DataFrame:
        """(file_id, path, language, lines_total, file_size, content): documents as files."""
        path = F.concat_ws("/", "source", "lang", key("", "doc_id"))
        lines = F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n")).cast("long")
        return self.raw("documents").select(F.col("doc_id").alias("file_id"), F.concat(path, F.lit(".md")).alias("path"), F.col("lang").alias("language"), lines.alias("lines_total"), F.col("n_chars").alias("file_size"), F.col("text").alias("content"))

    def functions(self) -> DataFrame:
        """Parts as functions: names repeat, qualified names less so."""
        rows = self.raw("part")
        body = F.concat_ws("\n", "p_name", "p_type", F.concat(F.lit("return "), F.col("p_brand")))
        return rows.select(
            F.col("p_partkey").alias("id"), F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"),
            F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("docstring"),
            F.col("p_size").cast("long").alias("line_start"), (F.col("p_size") + 2).cast("long").alias("line_end"), body.alias("body"),
        )

    def classes(self) -> DataFrame:
        """Suppliers as classes, their nation as the base."""
        nation = self.raw("nation").select(F.col("n_nationkey").alias("_n"), "n_name")
        rows = self.raw("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("_n"))
        return rows.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("file_id"), F.col("s_name").alias("name"), F.col("n_name").alias("bases"), F.col("s_suppkey").alias("line_start"))

    def imports(self) -> DataFrame:
        """Nations import their name from the module of their region."""
        region = self.raw("region").select(F.col("r_regionkey").alias("_r"), F.col("r_name").alias("module"))
        rows = self.raw("nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("_r"))
        return rows.select(F.col("n_nationkey").cast("long").alias("file_id"), "module", F.col("n_name").alias("name"), F.lower("n_name").alias("alias"), F.col("n_nationkey").cast("long").alias("line"))

    def variables(self) -> DataFrame:
        """Customers as variables of their nation's file."""
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("file_id"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("value"), F.col("c_custkey").alias("line"))

    def calls(self) -> DataFrame:
        """(caller, callee, line, file_id), distinct: odd lines call from part to supplier, even ones back."""
        rows = self.raw("lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey")
        odd = F.col("l_linenumber") % 2 == 1
        return rows.select(
            F.when(odd, key("P", "l_partkey")).otherwise(key("S", "l_suppkey")).alias("caller"),
            F.when(odd, key("S", "l_suppkey")).otherwise(key("P", "l_partkey")).alias("callee"),
            F.col("l_linenumber").cast("long").alias("line"),
            F.col("l_orderkey").alias("file_id"),
        ).distinct()

    def data_links(self) -> DataFrame:
        """(from_object, to_object, link_kind, is_universal): foreign keys as typed edges; regions are universal."""

        def links(name: str, source: F.Column, target: F.Column, kind: str, universal: bool = False) -> DataFrame:
            return self.raw(name).select(source.alias("from_object"), target.alias("to_object"), F.lit(kind).alias("link_kind"), F.lit(universal).alias("is_universal"))

        return (
            links("orders", key("Order.", "o_orderkey"), key("Customer.", "o_custkey"), "attr")
            .union(links("customer", key("Customer.", "c_custkey"), key("Nation.", "c_nationkey"), "attr"))
            .union(links("supplier", key("Supplier.", "s_suppkey"), key("Nation.", "s_nationkey"), "attr"))
            .union(links("nation", key("Nation.", "n_nationkey"), key("Region.", "n_regionkey"), "owner", True))
            .union(links("lineitem", key("Order.", "l_orderkey"), key("Part.", "l_partkey"), "recorder"))
            .union(links("lineitem", key("Order.", "l_orderkey"), key("Supplier.", "l_suppkey"), "recorder"))
            .distinct()
        )

    def code_usages(self) -> DataFrame:
        """(object_ref, file_path, usage_kind, line): order lines use parts."""
        return self.raw("lineitem").select(key("Part.", "l_partkey").alias("object_ref"), F.concat(key("orders/", "l_orderkey"), F.lit(".mod")).alias("file_path"), F.col("l_returnflag").alias("usage_kind"), F.col("l_linenumber").cast("long").alias("line"))

    def role_rights(self) -> DataFrame:
        """(role_name, object_name, right_name): market segments may read nations; with a balance, change them."""
        rows = self.raw("customer")
        return rows.select(F.col("c_mktsegment").alias("role_name"), key("Nation.", "c_nationkey").alias("object_name"), F.when(F.col("c_acctbal") > 0, "Update").otherwise("Read").alias("right_name")).distinct()

    def postings_source(self) -> DataFrame:
        """(doc, text): documents for full-text search."""
        return self.raw("documents").select(F.col("doc_id").alias("doc"), "text")
