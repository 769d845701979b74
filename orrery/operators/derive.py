"""The derived layer: exports, call graph, resolution of callees and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What marks an exported procedure in its argument text.
EXPORT = ") Export"


def exported(functions: DataFrame, mark: str = EXPORT, common: str = "CommonModules/", manager: str = "ManagerModule") -> DataFrame:
    """(path, name, kind, owner): functions whose arguments have the mark; kind by path: common, manager or other."""
    parts = F.split("path", "/")
    is_common, is_manager = F.col("path").contains(common), F.col("path").contains(manager)
    kind = F.when(is_common, "common").when(is_manager, "manager").otherwise("other")
    owner = F.when(is_common | is_manager, F.element_at(F.slice(parts, -2, 1), 1))
    return functions.filter(F.contains("args", F.lit(mark))).select("path", "name", kind.alias("kind"), owner.alias("owner"))


def unique_exports(exports: DataFrame) -> DataFrame:
    """(name, path): names that exactly one export has, with its path."""
    return exports.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter(F.col("n") == 1).drop("n")


def call_graph(calls: DataFrame, subscriptions: DataFrame, forms: DataFrame, overrides: DataFrame) -> DataFrame:
    """(caller_key, callee_name, call_type), distinct.

    calls: (path, caller, callee); subscriptions: (event, handler_module, handler_proc); forms: (owner, form, event, handler);
    overrides: (target_key, name).
    """
    join = lambda *c: F.concat_ws("::", *c)
    direct = calls.select(join("path", "caller").alias("caller_key"), F.col("callee").alias("callee_name"), F.lit("direct").alias("call_type"))
    events = subscriptions.select(join(F.lit("event"), "event"), F.concat_ws(".", "handler_module", "handler_proc"), F.lit("subscription"))
    bound = forms.select(join(F.lit("form"), "owner", "form", "event"), join("owner", "form", "handler"), F.lit("form_event"))
    over = overrides.select("target_key", "name", F.lit("extension_override"))
    return direct.union(events).union(bound).union(over).distinct()


def resolve_callees(edges: DataFrame, procedures: DataFrame, exports: DataFrame, modules: DataFrame, collections: DataFrame) -> DataFrame:
    """`edges` (path, caller, callee) with callee_key: by a procedure of the same file, else a name exported once, else
    Module.Method of a common module, else Collection.Object.Method; of several keys the least; null if none fits.

    procedures: (path, name). exports: (path, name). modules: (module, path). collections: (collection, object, path).
    Each source is reduced to one row for a key before it is joined, so no edge is multiplied.
    """
    key = lambda: F.concat_ws("::", "path", "name")
    local = procedures.select("path", "name").distinct().select("path", F.col("name").alias("callee"), key().alias("_a"))
    single = unique_exports(exports).select(F.col("name").alias("callee"), key().alias("_b"))
    methods = exports.join(modules.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"))
    dotted = methods.groupBy(F.concat_ws(".", "module", "name").alias("callee")).agg(F.min(key()).alias("_c"))
    owned = exports.join(collections.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"))
    full = owned.groupBy(F.concat_ws(".", "collection", "object", "name").alias("callee")).agg(F.min(key()).alias("_d"))
    out = edges.join(local, ["path", "callee"], "left").join(single, "callee", "left").join(dotted, "callee", "left").join(full, "callee", "left")
    return out.select("path", "caller", "callee", F.coalesce("_a", "_b", "_c", "_d").alias("callee_key"))


def resolve_batch(stored: DataFrame, batch: DataFrame, procedures: DataFrame, exports: DataFrame, modules: DataFrame, collections: DataFrame) -> DataFrame:
    """`stored` (path, caller, callee, callee_key) with the edges of the files of `batch` (path) resolved anew; others stay as
    they are and aren't joined with anything else."""
    own = batch.select("path").distinct()
    again = resolve_callees(stored.join(own, "path", "left_semi").drop("callee_key"), procedures, exports, modules, collections)
    return stored.join(own, "path", "left_anti").select(*again.columns).unionByName(again)


def prune_ballast(edges: DataFrame, ballast: list[str], exports: DataFrame) -> DataFrame:
    """Without unresolved edges to names of the list (after the first dot, if any) that no one exports."""
    at = F.instr("callee", ".")
    own = F.when(at > 0, F.expr("substring(callee, instr(callee, '.') + 1)")).otherwise(F.col("callee"))
    held = exports.select(F.col("name").alias("_own")).distinct()
    marked = edges.withColumn("_own", own)
    gone = marked.filter(F.col("callee_key").isNull() & F.col("_own").isin(*ballast)).select("_own").distinct().join(held, "_own", "left_anti")
    dead = gone.withColumn("_dead", F.lit(True))
    return marked.join(dead, "_own", "left").filter(F.col("callee_key").isNotNull() | F.col("_dead").isNull()).select(*edges.columns)


def prune_methods(edges: DataFrame, modules: DataFrame, collections: DataFrame) -> DataFrame:
    """Without unresolved method calls of unknown things: one dot, and what stands before it is neither module nor collection; or
    more dots, and it is no module."""
    first = F.split("callee", r"\.")[0]
    dots = F.length("callee") - F.length(F.replace("callee", F.lit("."), F.lit("")))
    marked = edges.withColumn("_q", first)
    marked = marked.join(modules.select(F.col("module").alias("_q"), F.lit(True).alias("_m")).distinct(), "_q", "left")
    marked = marked.join(collections.select(F.col("collection").alias("_q"), F.lit(True).alias("_c")).distinct(), "_q", "left")
    foreign = F.col("callee_key").isNull() & (((dots == 1) & F.col("_m").isNull() & F.col("_c").isNull()) | ((dots > 1) & F.col("_m").isNull()))
    return marked.filter(~foreign).select(*edges.columns)


def link_targets(attributes: DataFrame, many: int = 30) -> DataFrame:
    """(object, attribute, target): `cfg:KindRef.Name` becomes Kind.Name, `cfg:KindRef` *Kind; more than `many` targets of one
    attribute become one row, *Multiple. attributes: (object, attribute, type)."""
    named = F.regexp_extract("type", r"^(?:cfg:)?(\w+?)Ref\.(.+)$", 1)
    whole = F.regexp_extract("type", r"^(?:cfg:)?(\w+?)Ref$", 1)
    target = (
        F.when(F.col("type").rlike(r"^(cfg:)?AnyRef$"), "*Any")
        .when(F.col("type").rlike(r"^(cfg:)?DefinedType\."), F.regexp_replace("type", "^cfg:", ""))
        .when(named != "", F.concat(named, F.lit("."), F.regexp_extract("type", r"^(?:cfg:)?(\w+?)Ref\.(.+)$", 2)))
        .when(whole != "", F.concat(F.lit("*"), whole))
    )
    rows = attributes.select("object", "attribute", target.alias("target")).filter(F.col("target").isNotNull()).distinct()
    size = rows.groupBy("object", "attribute").agg(F.count("*").alias("_n"))
    return rows.join(size, ["object", "attribute"]).select("object", "attribute", F.when(F.col("_n") > many, "*Multiple").otherwise(F.col("target")).alias("target")).distinct()


def code_usages(lines: DataFrame, collections: list[str], types: list[str]) -> DataFrame:
    """(path, line, usage_kind, object_ref): Collection.Object in code, TypeRef.Object and Type.Object[.member] in string literals.

    lines: (path, line, text). Comments after // outside literals are dropped; a literal ends with its line.
    """
    quoted = F.contains("text", F.lit('"'))
    bare = F.when(quoted, F.regexp_replace("text", r'"[^"]*+"?', '""')).otherwise(F.col("text"))
    # Possessive: a long line costs neither stack nor second tries.
    cut = F.regexp_replace("text", r'^((?:[^"/]++|/(?!/)|"[^"]*+")*+)//.*$', "$1")
    said = F.when(quoted, F.array_join(F.regexp_extract_all(cut, F.lit('"([^"]*+)"?'), 1), " ")).otherwise("")
    lines = lines.select("path", "line", F.regexp_replace(bare, "//.*$", "").alias("code"), said.alias("said"))
    code, said = F.col("code"), F.col("said")
    word = r"[\p{L}_][\p{L}\p{N}_]*"
    one = lambda kind, text, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: F.struct(F.lit(kind).alias("usage_kind"), x.alias("object_ref")))
    found = F.concat(
        one("manager", code, rf"(?<![\p{{L}}\p{{N}}_.])(?:{'|'.join(collections)})\.{word}"),
        one("ref_type", said, rf"(?<![\p{{L}}\p{{N}}_.])(?:{'|'.join(types)})Ref\.{word}"),
        one("query", said, rf"(?<![\p{{L}}\p{{N}}_.])(?:{'|'.join(types)})\.{word}"),
    )
    return lines.select("path", "line", F.explode(found).alias("u")).select("path", "line", "u.usage_kind", "u.object_ref")
