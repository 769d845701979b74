"""The tools of the index as one object over entity tables.

Each tool plans DataFrames and gathers only its bounded answer; tables() holds what the indexing job wrote. Answers carry the flags
that tell what was cut off. Object, form and link tools need the derived tables as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.functions.text import matches_glob
from orrery.operators import graph, grep, lookup, refs, search, shaping
from orrery.plans import guard

FUNCTION_FIELDS = {"name": 10.0, "qualified_name": 5.0, "docstring": 2.0, "body": 1.0}
CLASS_FIELDS = {"name": 10.0, "docstring": 2.0, "body": 1.0}


@dataclass
class Engine:
    """tables: files, functions, classes, imports, calls, variables, texts, codes; and of the derived layer objects, links, forms,
    subscriptions, rights, usages, procedure_graph, terms, and term_triples (their trigram index, if there is one). Entities carry `path`."""

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    cache: shaping.AnswerCache = field(default_factory=shaping.AnswerCache)

    def _t(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name}: the repository isn't indexed that far")
        return self.tables[name]

    def _scoped(self, df: DataFrame, language: str | None = None, path_glob: str | None = None) -> DataFrame:
        if language:
            df = df.join(self._t("files").filter(F.col("language") == language).select("path"), "path", "left_semi")
        return df.filter(matches_glob(F.col("path"), path_glob)) if path_glob else df

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        return [shaping.strip(r.asDict(recursive=True)) for r in df.collect()]  # type: ignore[misc]

    # ---- search

    def _ranked(self, table: str, fields: Mapping[str, float], query: str, limit: int, language: str | None, path_glob: str | None) -> list[dict]:
        rows = self._scoped(self._t(table), language, path_glob)
        best = search.bm25(rows, "id", fields, query, limit)
        slim = rows.drop("body", "node_hash").withColumn("docstring", F.substring(F.regexp_replace("docstring", r"\s+", " "), 1, 200))
        return self._rows(best.join(slim, best["doc"] == slim["id"]).drop("doc").orderBy("score", "id"))

    def search_function(self, query: str, limit: int = 20, language: str | None = None, path_glob: str | None = None) -> list[dict]:
        return self._ranked("functions", FUNCTION_FIELDS, query, limit, language, path_glob)

    def search_class(self, query: str, limit: int = 20, language: str | None = None, path_glob: str | None = None) -> list[dict]:
        return self._ranked("classes", CLASS_FIELDS, query, limit, language, path_glob)

    def search_text(self, query: str, limit: int = 20, language: str | None = None, path_glob: str | None = None) -> list[dict]:
        rows = self._scoped(self._t("texts"), language, path_glob)
        best = search.bm25(rows, "path", {"content": 1.0}, query, limit)
        token = (search.query_tokens(query) or [query])[0]
        found = best.join(rows, best["doc"] == rows["path"]).orderBy("score", "path")
        return self._rows(found.select("path", text.snippet(F.col("content"), token).alias("snippet")))

    def search_terms(self, query: str, limit: int = 20) -> list[dict]:
        found = search.term_search(self._t("terms"), "proc_key", "terms", query, min(max(limit, 1), 200), self.tables.get("term_triples"))
        return self._rows(found.join(self._t("terms"), "proc_key").orderBy(F.desc("matched"), "proc_key"))

    # ---- lookup

    def _entity(self, table: str, name: str | Sequence[str], path_glob: str | None) -> dict:
        rows = self._scoped(self._t(table), None, path_glob)
        if not isinstance(name, str):
            found = self._rows(lookup.exact(rows, list(name)).orderBy("name", "path", "line_start"))
            return {"results": found, "missing": sorted(set(name) - {r["name"] for r in found})}
        hits = lookup.places(lookup.resolve(rows, name), ["path", "line_start"]).withColumn("body", text.head_tail(F.col("body")))
        found = self._rows(hits)
        if not found:
            return {"results": [], "did_you_mean": [r["name"] for r in lookup.suggest(self._t(table), name).collect()]}
        total = found[0]["total"]
        keep = ("name", "qualified_name", "path", "line_start", "line_end") if total > lookup.PLACES_FROM else None
        return {"total": total, "matched": found[0]["matched"], "results": [{k: v for k, v in r.items() if k not in ("total", "matched") and (keep is None or k in keep)} for r in found]}

    def get_function(self, name: str | Sequence[str], path_glob: str | None = None) -> dict:
        return self._entity("functions", name, path_glob)

    def get_class(self, name: str | Sequence[str], path_glob: str | None = None) -> dict:
        return self._entity("classes", name, path_glob)

    def find_symbol(self, name: str, language: str | None = None, path_glob: str | None = None) -> dict:
        own = [self._scoped(self._t(t), None, path_glob) for t in ("functions", "classes", "variables", "imports")]
        out: dict[str, list] = {"functions": [], "classes": [], "variables": [], "imports": []}
        plural = {"function": "functions", "class": "classes", "variable": "variables", "import": "imports"}
        for r in lookup.find_symbol(name, *own, self._t("files"), language).collect():
            out[plural[r["category"]]].append(r.asDict())
        return out

    def get_imports(self, file_id: int | None = None, module: str | None = None, language: str | None = None, limit: int = 200) -> dict:
        found = self._rows(lookup.imports_of(self._scoped(self._t("imports"), language), file_id, module, limit + 1))
        return {"imports": found[:limit], "truncated": len(found) > limit}

    # ---- calls

    def get_callers(self, name: str, language: str | None = None, limit: int = 200) -> dict:
        rows = graph.callers(self._scoped(self._t("calls"), language), name).orderBy("file_id", "line", "caller", "callee")
        total = rows.count()
        answer = {"calls": self._rows(rows.select("caller", "callee", "line", "path").limit(limit)), "total": total, "truncated": total > limit}
        if "forms" in self.tables:
            answer["form_events"] = self._rows(refs.form_callers(self._t("functions"), self._t("forms"), name))
        return answer

    def get_callees(self, name: str, language: str | None = None, limit: int = 200) -> dict:
        rows = graph.callees(self._scoped(self._t("calls"), language), name).orderBy("file_id", "line", "caller", "callee")
        total = rows.count()
        return {"calls": self._rows(rows.select("caller", "callee", "line", "path").limit(limit)), "total": total, "truncated": total > limit}

    def _edges(self, language: str | None) -> DataFrame:
        calls = self._scoped(self._t("calls"), language)
        return calls.groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.min(F.struct("line", "path")).alias("pick"))

    def find_path(self, start: str, end: str, max_depth: int = 5, language: str | None = None) -> dict:
        depth = min(max(max_depth, 1), 10)
        if start == end:
            known = bool(lookup.known(start, self._t("functions"), self._t("calls")).first()["known"])
            return {"from": start, "to": end, "found": known, "path": [], "max_depth": depth}
        walk = graph.walk(self._edges(language), start, end, depth)
        steps = [{"caller": r["src"], "callee": r["dst"], **r["edge"]["pick"].asDict()} for r in walk.rows.orderBy("step").collect()]
        return {"from": start, "to": end, "found": bool(steps), "path": steps, "max_depth": depth} | self._why_not(steps, walk)

    @staticmethod
    def _why_not(steps: list[dict], walk: graph.Walk) -> dict:
        """Flags of a search that found nothing: whether there may be a path all the same."""
        return {} if steps else {"walk_depth_exhausted": walk.depth_exhausted, "walk_nodes_capped": walk.nodes_capped}

    def get_call_tree(self, root: str, direction: str = "callees", max_depth: int = 3, max_nodes: int = 200, language: str | None = None) -> dict:
        most = min(max(max_nodes, 1), 5000)
        edges = [r.asDict() for r in graph.tree(self._scoped(self._t("calls"), language), root, direction, max_depth, most).collect()]
        return {"root": root, "direction": direction, "max_depth": max_depth, "edge_count": len(edges), "edges": shaping.strip(edges), "tree": graph.nested(edges, root, direction), "truncated": len(edges) >= most}

    def find_path_by_key(self, start: str, end: str, max_depth: int = 3) -> dict:
        """Over the resolved call graph: a callee is its key where it is known, else its name."""
        edges = self._t("procedure_graph").select(F.col("caller_key").alias("src"), F.coalesce("callee_key", "callee_name").alias("dst"), F.struct("call_type", "callee_name", "callee_key").alias("pick"))
        walk = graph.walk(edges, start, end, min(max(max_depth, 1), 10))
        steps = [{"caller": r["src"], "callee": r["dst"], "call_type": r["edge"]["pick"]["call_type"]} for r in walk.rows.orderBy("step").collect()]
        return {"found": bool(steps), "path": steps} | self._why_not(steps, walk)

    # ---- files

    def get_stats(self) -> dict:
        names = [n for n in ("files", "functions", "classes", "imports", "calls", "variables", "texts") if n in self.tables]
        rows = None
        for n in names:
            c = self._t(n).agg(F.count("*").alias("total")).select(F.lit(n).alias("entity"), "total")
            rows = c if rows is None else rows.union(c)
        return {r["entity"]: r["total"] for r in rows.collect()} if rows is not None else {}

    def list_files(self, pattern: str | None = None, path_prefix: str | None = None, language: str | None = None, limit: int = 500) -> dict:
        rows = self._t("files")
        if path_prefix:
            rows = rows.filter(F.col("path").startswith(path_prefix))
        if language:
            rows = rows.filter(F.col("language") == language)
        rows = rows.filter(matches_glob(F.col("path"), pattern)) if pattern else rows
        found = rows.orderBy("path").limit(limit).collect()
        total = len(found) if len(found) < limit else rows.count()
        return {"files": [f"{r['path']} | {r['language']} | {r['lines_total']} lines | {r['file_size']}" for r in found], "total": total, "truncated": total > limit}

    def stat_file(self, path: str) -> dict:
        found = self._t("files").filter(F.col("path") == path).first()
        if found is None:
            return {"exists": False, "hint": [r["name"] for r in lookup.suggest(self._t("files"), path, "path").collect()]}
        return {"exists": True} | shaping.strip(found.asDict())  # type: ignore[operator]

    def read_file(self, path: str, line_start: int | None = None, line_end: int | None = None) -> dict:
        first, last = max(1, line_start or 1), line_end or (1 << 30)
        for table in ("codes", "texts"):
            if table not in self.tables:
                continue
            rows = self._t(table).filter(F.col("path") == path)
            size = F.size(text.lines(F.col("content")))
            found = rows.select(text.line_slice(F.col("content"), first, last).alias("content"), size.alias("lines_total")).first()
            if found is not None:
                held = (found["content"] or "").count("\n") + 1 if found["content"] else 0
                return {"content": found["content"], "lines_returned": held, "lines_total": found["lines_total"], "truncated": first + held - 1 < min(last, found["lines_total"] or 0), "category": table.rstrip("s")}
        return {"content": None, "category": None, "lines_total": 0, "lines_returned": 0, "truncated": False}

    def get_file_summary(self, path: str) -> dict:
        answer: dict[str, object] = {"file": self.stat_file(path)}
        for table in ("functions", "classes", "imports", "variables"):
            rows = self._t(table).filter(F.col("path") == path).drop("body", "docstring")
            found = self._rows(rows.orderBy("line_start" if "line_start" in rows.columns else "line"))
            answer |= {table: shaping.file_map(found), f"{table}_total": len(found)}
        return answer

    # ---- grep

    def _grep(self, table: str, regex: str, path_glob: str | None, language: str | None, limit: int, context_lines: int) -> dict:
        rows = self._scoped(self._t(table), language, path_glob)
        top = grep.limited(grep.within_bytes(grep.hits(rows, regex)).select("path", "line", "text"), limit)
        shown = top.collect()
        answer = {"shown": len(shown), "limit": limit, "truncated": len(shown) >= limit}
        hits = self.spark.createDataFrame([(r["path"], r["line"], r["text"]) for r in shown], "path string, line long, text string")
        lines = grep.with_context(rows, hits, context_lines) if context_lines and shown else hits
        return answer | {"files": {r["path"]: r["hits"].split("\n") for r in grep.compact(lines).orderBy("path").collect()}}

    def grep_text(self, regex: str, path_glob: str | None = None, language: str | None = None, limit: int | None = None, context_lines: int = 0) -> dict:
        return self._grep("texts", regex, path_glob, language, limit or (100 if path_glob or language else 30), context_lines)

    def grep_code(self, regex: str, path_glob: str | None = None, language: str | None = None, limit: int = 30, context_lines: int = 0) -> dict:
        return self._grep("codes", regex, path_glob, language, limit, context_lines)

    def grep_body(self, pattern: str | None = None, regex: str | None = None, language: str | None = None, limit: int = 30, path_glob: str | None = None) -> dict:
        if (pattern is None) == (regex is None):
            raise ValueError("exactly one of pattern and regex is required")
        own = ["id", "name", "path", "line_start", "body"]
        both = self._t("functions").select(*own).unionByName(self._t("classes").select(*own))
        rows = self._scoped(both, language, path_glob)
        found = grep.bodies(rows, regex if regex is not None else text.literal(pattern or ""), ignore_case=regex is None)
        found = found.join(rows.select("id", "name", "path", "line_start"), ["id", "name"]).orderBy("path", "line_start", "name").limit(limit).collect()
        files: dict[str, list[str]] = {}
        for r in found:
            files.setdefault(r["path"], []).append(f"{r['name']}: {r['lines']}" + (f" ({r['match_count']} matches)" if r["match_count"] else ""))
        return {"files": files, "shown": len(found), "limit": limit, "truncated": len(found) >= limit}

    # ---- objects

    def _object(self, name: str) -> str | None:
        wanted = self.spark.createDataFrame([(name,)], "wanted string")
        return lookup.resolve_objects(self._t("objects"), wanted).first()["full_name"]

    def get_object_structure(self, full_name: str | None = None, name_like: str | None = None, meta_type: str | None = None, max_bytes: int | None = None) -> dict:
        if name_like is not None:
            found = lookup.name_like(self._t("objects"), name_like, meta_type).collect()
            return shaping.shrink_results({"matched": len(found), "truncated": bool(found and found[0]["more"]), "results": [shaping.strip(r.asDict()) for r in found]}, budget=shaping.clamp_budget(max_bytes))
        own = self._object(full_name or "")
        if own is None:
            return {"found": False, "did_you_mean": [r["full_name"] for r in lookup.similar_objects(self._t("objects"), full_name or "").collect()]}
        row = self._t("objects").filter(F.col("full_name") == own).first()
        return shaping.omit_sections(row.asDict(), shaping.clamp_budget(max_bytes))

    def get_object_profile(self, full_name: str) -> dict:
        own = self._object(full_name)
        if own is None:
            return {"found": False}
        named = lambda t, c: self._t(t).filter(F.col(c) == own)
        kinds = {d: {r["link_kind"]: r["n"] for r in named("links", c).groupBy("link_kind").agg(F.count("*").alias("n")).orderBy("link_kind").collect()} for d, c in (("out", "from_object"), ("in", "to_object"))}
        forms = refs.folded_handlers(refs.form_handlers(self._t("forms"), own))
        return {"object": own, "structure": self.get_object_structure(own), "forms": self._rows(forms.orderBy("form_name")), "data_links": kinds}

    def get_form_handlers(self, owner: str, form_name: str | None = None, element: str | None = None, max_bytes: int | None = None) -> dict:
        found = refs.form_handlers(self._t("forms"), owner, form_name, element)
        full = {"handlers": self._rows(found.orderBy("form_name", "event", "handler"))}
        return full if form_name else shaping.fold(full, {"forms": self._rows(refs.folded_handlers(found).orderBy("form_name"))}, shaping.clamp_budget(max_bytes))

    def get_event_subscriptions(self, handler_module: str | None = None, event: str | None = None, source: str | None = None, limit: int = 50) -> dict:
        found = refs.subscriptions(self._t("subscriptions"), handler_module, event, source, limit).collect()
        total = found[0]["total"] if found else 0
        return {"subscriptions": [{k: v for k, v in r.asDict().items() if k != "total"} for r in found], "count": len(found), "total": total, "truncated": total > len(found), "limit": limit}

    def get_data_links(self, name: str, direction: str = "both", depth: int = 1, limit: int = 100, offset: int = 0) -> dict:
        limit = min(max(limit, 1), 1000)
        answer: dict[str, object] = {}
        for side in ("out", "in") if direction == "both" else (direction,):
            every = graph.links(self._t("links"), name, side, depth, whole=True)
            page = every.orderBy("depth", "from_object", "to_object", "link_kind").offset(offset).limit(limit)
            kinds = {r["link_kind"]: r["n"] for r in every.groupBy("link_kind").agg(F.count("*").alias("n")).orderBy("link_kind").collect()}
            total = sum(kinds.values())
            answer |= {side: self._rows(page), f"{side}_by_kind": kinds, f"{side}_total": total, f"{side}_has_more": total > offset + limit}
        return answer

    def find_data_path(self, start: str, end: str, max_depth: int = 4) -> dict:
        edges = self._t("links").select(F.col("from_object").alias("src"), F.col("to_object").alias("dst"), F.struct("link_kind").alias("pick"), "is_universal")
        walk = graph.walk(edges, start, end, min(max(max_depth, 1), 8), terminal="is_universal")
        steps = [{"from": r["src"], "to": r["dst"], "link_kind": r["edge"]["pick"]["link_kind"]} for r in walk.rows.orderBy("step").collect()]
        return {"found": bool(steps), "path": steps} | ({} if steps else {"visited_nodes": walk.visited, "depth_exhausted": walk.depth_exhausted, "nodes_capped": walk.nodes_capped})

    def get_register_writers(self, name: str) -> dict:
        found = refs.register_writers(self._t("links"), name).collect()
        sides = {s: [r["object"] for r in found if r["side"] == s] for s in ("writers", "writes_to")}
        return sides | {"counts": {s: len(v) for s, v in sides.items()}, "truncated": any(len(v) >= 500 for v in sides.values())}

    def find_references(self, name: str, limit: int = 20, section: str | None = None, offset: int = 0) -> dict:
        limit = min(max(limit, 1), 200)
        if section == "code_usages":
            return {"code_usages": self._rows(refs.section(self._t("usages"), name, limit, offset))}
        answer: dict[str, dict] = {s: {"total": 0, "by_kind": {}} for s in ("data_refs", "code_usages", "role_rights")}
        for r in refs.reference_counts(self._t("links"), self._t("usages"), self._t("rights"), name).collect():
            answer[r["section"]]["by_kind"][r["kind"]] = r["total"]
            answer[r["section"]]["total"] += r["total"]
        answer["code_usages"]["sample"] = self._rows(refs.section(self._t("usages"), name, limit))
        return answer

    def sql(self, statement: str, params: Sequence[object] | None = None, limit: int = guard.LIMIT) -> guard.Answer:
        """A guarded query over the tables by their names; if it finds nothing, terms that match its literals."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        answer = guard.run(self.spark, statement, params, limit)
        if not answer.rows and "terms" in self.tables and (words := guard.search_words(statement)):
            answer.suggestions = [r["proc_key"] for r in self.search_terms(" ".join(words), 10)]
        return answer

    def health(self) -> dict:
        return {"spark": self.spark.version, "tables": sorted(self.tables)}
