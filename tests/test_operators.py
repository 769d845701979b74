"""Operators on small fixtures: cycles, unicode, line ends, globs, guards, budgets and upkeep."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import derive, extract, graph, grep, lookup, merge, refs, search, shaping
from orrery.plans import guard
from orrery.sources import files
from orrery.streaming import debounce


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "glob,hits,misses",
    [
        ("**/*.md", ["a.md", "x/y/a.md"], ["a.mdx", "a.MD"]),
        ("src/**/mod.rs", ["src/mod.rs", "src/a/b/mod.rs"], ["src2/mod.rs"]),
        ("*.{rs,py}", ["a/b.rs", "c.py"], ["c.go"]),
        ("a?c[0-9]", ["abc1", "a.c9"], ["ac1", "abcx"]),
        ("{a,b}/{c,d}.x", ["a/c.x", "b/d.x"], ["a/e.x"]),
        ("lit.eral+(x)", ["lit.eral+(x)"], ["litteral+(x)"]),
        ("{a,{b,c}}", ["{a,{b,c}}"], ["a", "b"]),
    ],
)
def test_globs(spark, glob, hits, misses):
    rows = spark.createDataFrame([(p,) for p in hits + misses], "path string").filter(text.matches_glob(F.col("path"), glob))
    assert sorted(r.path for r in rows.collect()) == sorted(hits)


def test_braces_are_bounded():
    many = "{" + ",".join(map(str, range(9))) + "}"
    assert text.expand_braces(many * 2) == [many * 2] and len(text.expand_braces(many + "{a,b}")) == 18


def test_lines_and_slices(spark):
    assert one(spark, text.lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    assert one(spark, text.lines(F.lit("a\n\n"))) == ["a", ""]
    assert one(spark, text.line_slice(F.lit("1\n2\n3\n4"), 2, 3)) == "2\n3"
    assert one(spark, text.line_slice(F.lit("1\n2"), 5, 9)) == ""
    assert one(spark, text.head_tail(F.lit("\n".join(map(str, range(10)))), 5, 2, 1)) == "0\n1\n… 7 lines omitted …\n9"


def test_regular_expressions(spark):
    assert one(spark, text.has_match(F.lit("a\r\nend\r\nb"), "^end$"))
    assert one(spark, text.has_match(F.lit("ПРИВЕТ"), "привет", ignore_case=True))
    assert one(spark, F.lit("a.b(c)").rlike(text.literal("a.b(c)"))) and not one(spark, F.lit("axb(c)").rlike(text.literal("a.b(c)")))
    with pytest.raises(Exception, match="PATTERN|Unclosed"):
        one(spark, text.has_match(F.col("id").cast("string"), "("))


def test_snippet_and_terms(spark):
    assert one(spark, text.snippet(F.lit("x" * 100 + " Needle  in\na " + "y" * 100), "needle", 8)) == "…xxxxxxx Needle in a y…"
    assert one(spark, text.snippet(F.lit("none"), "needle")) is None
    assert one(spark, text.identifier_words(F.lit("getHTTPServer2_ПолучитьЁлкуABC"))) == ["get", "http", "server", "2", "получить", "елку", "abc"]
    assert one(spark, text.leading_comment(F.lit("// ======\n// Adds one.\n&AtServer\n// Really.\nProc()\n// not this"))) == "Adds one. Really."
    assert one(spark, text.terms(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("")))) == "a, b"


CYCLE = [("a", "b", 1, 1), ("b", "c", 2, 1), ("c", "a", 3, 1), ("a", "d", 4, 1), ("d", "e", 5, 2)]


def calls(spark):
    return spark.createDataFrame(CYCLE, "caller string, callee string, line long, file_id long")


def edges(spark):
    return calls(spark).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.struct("line", "file_id").alias("pick"))


def test_graph_on_a_cycle(spark):
    assert {r.node: r.depth for r in graph.depths(edges(spark), "a", 10).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert [(r.src, r.dst) for r in graph.path(edges(spark), "a", "c", 5).orderBy("step").collect()] == [("a", "b"), ("b", "c")]
    assert graph.path(edges(spark), "a", "c", 1).count() == 0 and graph.path(edges(spark), "a", "a", 5).count() == 0
    assert graph.path(edges(spark), "a", "nowhere", 5).count() == 0
    tree = graph.tree(calls(spark), "a", "callees", 4, 100)
    assert [(r.depth, r.caller, r.callee) for r in tree.collect()] == [(1, "a", "b"), (1, "a", "d"), (2, "b", "c"), (2, "d", "e"), (3, "c", "a"), (4, "a", "b"), (4, "a", "d")]
    nested = graph.nested([r.asDict() for r in tree.collect()], "a")
    assert [c["name"] for c in nested["children"]] == ["b", "d"]


def test_universal_targets_are_not_followed(spark):
    rows = [("o", "c", "attr", False), ("c", "u", "owner", True), ("u", "x", "attr", False)]
    links = spark.createDataFrame(rows, "from_object string, to_object string, link_kind string, is_universal boolean")
    assert [(r.depth, r.to_object) for r in graph.links(links, "o", "out", 4).collect()] == [(1, "c"), (2, "u")]


def test_resolution_order_and_pruning(spark):
    procedures = spark.createDataFrame([("f1", "Local"), ("f2", "Single"), ("f3", "Twice"), ("f4", "Twice"), ("m1", "Meth"), ("c1", "Deep")], "path string, name string")
    exports = procedures.filter("name <> 'Local'")
    modules = spark.createDataFrame([("Mod", "m1")], "module string, path string")
    collections = spark.createDataFrame([("Catalogs", "Goods", "c1")], "collection string, object string, path string")
    wanted = {"Local": "f1::Local", "Single": "f2::Single", "Twice": None, "Mod.Meth": "m1::Meth", "Catalogs.Goods.Deep": "c1::Deep", "Mod.None": None, "x.Add": None, "Print": None, "a.b.c": None, "Catalogs.x": None}
    calls_ = spark.createDataFrame([("f1", "main", c) for c in wanted], "path string, caller string, callee string")
    found = derive.resolve_callees(calls_, procedures, exports, modules, collections)
    assert {r.callee: r.callee_key for r in found.collect()} == wanted
    left = derive.prune_methods(derive.prune_ballast(found, ["Print", "Add"], exports), modules, collections)
    assert {r.callee for r in left.collect()} == set(wanted) - {"x.Add", "Print", "a.b.c"}


def test_lookup_fallback_and_suggestions(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["Обмен", "ОБМЕН", "Exchange", "exchangeAll", "Other"])], "id long, name string")
    assert [r.id for r in lookup.resolve(names, "Обмен").collect()] == [0]
    assert {r.id for r in lookup.resolve(names, "обмен").collect()} == {0, 1}
    assert lookup.resolve(names, "none").count() == 0
    assert [r.name for r in lookup.suggest(names, "Exchangd").collect()] == ["Exchange", "exchangeAll"]
    assert lookup.known("b", names, calls(spark)).first().known and not lookup.known("zz", names, calls(spark)).first().known
    with pytest.raises(ValueError, match="required"):
        lookup.imports_of(names)


def test_find_symbol_language_spares_variables(spark):
    shape = "name string, qualified_name string, bases string, value string, module string, alias string, file_id long, line_start long, line long"
    rows = spark.createDataFrame([("n", "n", "b", "v", "m", "a", 1, 1, 1), ("n", "n", "b", "v", "m", "a", 2, 1, 1)], shape)
    own = spark.createDataFrame([(1, "python"), (2, "go")], "file_id long, language string")
    found = lookup.find_symbol("n", rows, rows, rows, rows, own, "go")
    counts = {r.category: r["count"] for r in found.groupBy("category").count().collect()}
    assert counts == {"function": 1, "class": 1, "variable": 2, "import": 1}


def test_search(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alphabet soup soup"), (3, "gamma"), (4, None)], "id long, body string")
    assert [r.doc for r in search.bm25(rows, "id", {"body": 1.0}, "alpha").collect()] == [1, 2]
    assert search.query_tokens("foo_bar Baz--9") == ["foo", "bar", "baz", "9"]
    index = search.postings(rows, "id", ["body"])
    sizes = rows.select(F.col("id").alias("doc"), F.size(search.tokens(F.col("body"))).cast("double").alias("size"))
    assert search.bm25_postings(index, sizes, {"body": 1.0}, "gamma alpha").collect() == search.bm25(rows, "id", {"body": 1.0}, "gamma alpha").collect()
    found = search.term_search(rows, "id", "body", "soup AND alp")
    assert [r.id for r in found.collect()] == [2]
    assert [r.id for r in search.term_search(rows, "id", "body", 'alp NOT soup').collect()] == [1]
    ranked = search.bm25(rows, "id", {"body": 1.0}, "alpha")
    own = rows.select(F.col("id").alias("doc"))
    assert search.filtered_search(ranked, own, F.col("doc") > 1, 1, compat=True).first().prefilter_exhausted is False


def test_grep(spark):
    docs = spark.createDataFrame([("b", "x\nhit 1\ny\nhit 2\n"), ("a", "hit\r\nz"), ("c", None)], "path string, content string")
    found = grep.hits(docs, "^hit")
    assert [(r.path, r.line) for r in found.orderBy("path", "line").collect()] == [("a", 1), ("b", 2), ("b", 4)]
    assert [r.truncated for r in grep.limited(found, 3).collect()] == [True] * 3
    near = grep.with_context(docs, found, 1).orderBy("path", "line").collect()
    assert [(r.path, r.line, r.is_hit) for r in near] == [("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, True), ("b", 3, False), ("b", 4, True)]
    assert [r.path for r in grep.within_bytes(found, 8).collect()] == ["a", "b"]
    assert {r.path: r.hits for r in grep.compact(found).collect()}["b"] == "2: hit 1\n4: hit 2"


def test_guard_refuses_code_and_files(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    bad = ["SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'nanoTime')", "SELECT * FROM text.`/etc/hostname`"]
    bad += ["SELECT id FROM numbers WHERE id IN (SELECT length(value) FROM text.`/etc/hostname`)", "WITH a AS (SELECT try_reflect('java.lang.System', 'nanoTime') AS x) SELECT x FROM a"]
    bad += ["SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "SELECT input_file_name() FROM numbers", "SELECT id FROM numbers WHERE EXISTS (SELECT 1 FROM parquet.`/x`)", "SELECT * FROM read_files('/etc')"]
    for sql in bad:
        with pytest.raises(guard.Refused, match="allowed|tables of the index"):
            guard.query(spark, sql)
    assert guard.run(spark, "SELECT 'a\nCreate reflect(x) text.y' AS s, id FROM numbers WHERE id IN (SELECT max(id) FROM range(3))").rows[0][1] == 2


def test_walk_flags(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i) for i in range(12)], "src string, dst string, pick int")
    assert graph.walk(chain, "n0", "n9", 4).depth_exhausted and not graph.walk(chain, "n0", "n9", 10).depth_exhausted
    assert graph.walk(chain, "n0", "n9", 10).rows.count() == 9 and not graph.walk(chain, "n10", "zz", 10).depth_exhausted
    assert graph.walk(chain, "n0", "n9", 10, most=3).nodes_capped


def test_dialect_modules():
    from orrery.operators import dialect

    source = "Перем А, Б Экспорт;\n\n&НаСервере\nПроцедура Один(х) Экспорт\n  Если Верно(х) Тогда\n    Модуль.Метод(Свой()).Ещё(\"Нет(\"); // Нет()\n  КонецЕсли;\nКонецПроцедуры\n\n&Перед(\"Два\")\nФункция Р_Два()\n  Возврат 1;\nКонецФункции\nГлавный();\n"
    rows = extract.extract_text("m", "bsl", source)
    got = lambda kind: [(r[2], r[6], r[7], r[8]) for r in rows if r[1] == kind]
    assert got("function") == [("Один", "(х) Export", "&НаСервере", None), ("Р_Два", "()", "&Перед", None)]
    assert [(r[2], r[3], r[7]) for r in rows if r[1] == "override"] == [("Р_Два", "Два", "Перед")]
    assert [(n, c) for n, _, _, c in got("call")] == [("Верно", "Один"), ("Модуль.Метод", "Один"), ("Свой", "Один"), ("Ещё", "Один"), ("Главный", "<module>")]
    assert [r[2] for r in rows if r[1] == "variable"] == ["А", "Б"]
    assert extract.extract_text("m", "bsl", "Процедура Без\n") and dialect.EVENTS["OnCopy"] == "ПриКопировании"


def test_extraction_gives_up_in_time(monkeypatch):
    monkeypatch.setattr(extract, "SECONDS", 0.05)
    monkeypatch.setitem(extract.EXTRACTORS, "slow", lambda text, rows: [None for _ in iter(int, 1)])
    assert extract.extract_text("p", "slow", "x") == []


def test_stored_index_upkeep(spark, tmp_path):
    docs = spark.createDataFrame([(1, "tests run"), (2, "test the foo_bar test"), (3, "foo x bar"), (4, "testing foo barn")], "id long, t string")
    shape = lambda d: search.postings(d, "id", ["t"], positions=True)
    search.write_postings(shape(docs), str(tmp_path / "i"), 4)
    fresh = spark.createDataFrame([(2, "foo bars and tests"), (5, "tests test")], "id long, t string")
    gone = spark.createDataFrame([(2,), (3,), (5,)], "doc long")
    stored = spark.read.parquet(str(tmp_path / "i"))
    index = search.update_postings(stored, shape(fresh), gone)
    now = docs.filter("id IN (1, 4)").union(fresh)
    sizes = index.groupBy("doc").agg(F.sum("tf").cast("double").alias("size"))
    for query in ("test tests", "foo_bar", "tests foo_b run", "zzz"):
        want = [tuple(r) for r in search.bm25(now, "id", {"t": 1.0}, query).collect()]
        assert [tuple(r) for r in search.bm25_postings(index, sizes, {"t": 1.0}, query).collect()] == want, query
    assert [r.doc for r in search.bm25(docs, "id", {"t": 1.0}, "foo_bar").collect()] == [4, 2]


def test_trigram_index_gives_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Onion soup"), (2, "alpine ONIONS, soup"), (3, "nio oni ion"), (4, None), (5, "ёлка и ель"), (6, "so")], "id long, t string")
    search.write_postings(search.trigram_index(docs, "id", "t"), str(tmp_path / "t"), 4)
    stored = spark.read.parquet(str(tmp_path / "t"))
    for query in ("onion", "onion AND soup", "soup NOT alpine", '"n soup"', "елка onio", "zzz", "so"):
        want = [tuple(r) for r in search.term_search(docs, "id", "t", query).collect()]
        assert [tuple(r) for r in search.term_search(docs, "id", "t", query, index=stored).collect()] == want, query
    fresh = spark.createDataFrame([(2, "chives"), (7, "an onion")], "id long, t string")
    index = search.update_postings(stored, search.trigram_index(fresh, "id", "t"), fresh.select(F.col("id").alias("doc")))
    now = docs.filter("id <> 2").union(fresh)
    assert [r.id for r in search.term_search(now, "id", "t", "onion chive", index=index).collect()] == [1, 2, 7]


def test_area_reconciliation_and_cascade(spark):
    stored = spark.createDataFrame([("A", "Doc.X", "1"), ("A", "Doc.Y", "1"), ("A", "Doc.Z", "1"), ("A", "Doc.Q", "1"), ("B", "Doc.W", "1")], "area string, full_name string, config_version string")
    declared = spark.createDataFrame([("Doc.Z", "1"), ("Doc.N", "1"), ("Doc.Q", "2")], "full_name string, config_version string")
    objects = spark.createDataFrame([("Doc.X", "A"), ("Doc.Y", "B"), ("Doc.Z", "A"), ("Doc.W", "B")], "full_name string, home string")
    found = merge.reconcile_area(stored, declared, objects, "A")
    assert {tuple(r) for r in found.collect()} == {("Doc.X", "removed", "drop"), ("Doc.Y", "removed", "merge"), ("Doc.N", "added", None), ("Doc.Q", "updated", None)}
    names = lambda *rows: spark.createDataFrame([(r,) for r in rows], "full_name string")
    links = spark.createDataFrame([("Doc.X", "Doc.Z"), ("Doc.Z", "Doc.X"), ("Doc.Z", "Doc.XY"), ("Doc.Z", None)], "from_object string, to_object string")
    tables = {"objects": names("Doc.X", "Doc.X.Template.T", "Doc.XY", "Doc.Z", None), "links": links, "files": names("Doc.X")}
    kept = merge.drop_cascade(tables, found.filter("action = 'drop'"))
    assert {r[0] for r in kept["objects"].collect()} == {"Doc.XY", "Doc.Z", None}
    assert {tuple(r) for r in kept["links"].collect()} == {("Doc.Z", "Doc.XY"), ("Doc.Z", None)}
    assert kept["files"] is tables["files"]


def test_guard(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    assert guard.query(spark, "-- c\nSELECT id /* x */ FROM numbers WHERE id > ?", [2]).count() == 2
    for bad in ("DROP VIEW numbers", "INSERT INTO numbers VALUES (1)", "SELECT 1; DROP VIEW numbers", "WITH x AS (SELECT 1) INSERT INTO numbers SELECT * FROM x", "SELECT * FROM numbers LIMIT 1, 2", "SELECT id FROM numbers WHERE id GLOB 'a'", "SELECT sum(id) OVER (ORDER BY id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM numbers", "explain select 1"):
        with pytest.raises(guard.Refused):
            guard.query(spark, bad)
    with pytest.raises(guard.Refused, match="parameters"):
        guard.query(spark, "SELECT ?", [[1]])
    answer = guard.run(spark, "SELECT id FROM numbers ORDER BY id", limit=3)
    assert (answer.rows, answer.truncated, answer.row_count) == ([[0], [1], [2]], True, 3)
    assert guard.run(spark, "SELECT id FROM numbers LIMIT 2").hint
    assert guard.run(spark, "SELECT unhex('00ff') AS b").rows == [[{"_blob_bytes": 2}]]
    with pytest.raises(guard.Refused, match="number"):
        guard.run(spark, "SELECT * FROM numbrs")
    assert "numbers.id" in guard.explain_error(spark, "A column, variable, or function parameter with name `id` cannot be resolved")
    assert guard.search_words("SELECT * WHERE name LIKE '%обмен%' AND x = 'ab'") == ["обмен"]
    assert guard.renamed_types("x = 'Справочник.A' AND y = 'z'", {"Справочник": "Catalog"}) == "x = 'Catalog.A' AND y = 'z'"
    assert guard.run(spark, "SELECT ';--' AS s").rows == [[";--"]]


def test_merge_and_incremental_equals_full(spark):
    r = random.Random(3)
    table = {f"p{i}": i for i in range(40)}
    df = spark.createDataFrame(list(table.items()), "path string, value long")
    for step in range(4):
        changes = {f"p{r.randrange(60)}": r.choice(["Created", "Modified", "Deleted"]) for _ in range(12)}
        now = {p: 1000 * step + i for i, p in enumerate(changes)}
        batch = spark.createDataFrame(list(changes.items()), "path string, kind string")
        fresh = spark.createDataFrame(list(now.items()), "path string, value long")
        df = debounce.apply_changes(df, batch, fresh)
        again = debounce.apply_changes(df, batch, fresh)
        for p, kind in changes.items():
            table.pop(p, None)
            if kind != "Deleted":
                table[p] = now[p]
        assert {x.path: x.value for x in df.collect()} == table == {x.path: x.value for x in again.collect()}


def test_file_changes(spark):
    shape = "path string, content_hash string, mtime long, file_size long"
    old = spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 1, 1), ("c", "1", 1, 1), ("d", "1", 1, 1)], shape)
    new = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 1, 1), ("c", "1", 2, 1), ("e", "1", 1, 1)], shape)
    assert {r.path: r.change for r in merge.file_changes(old, new).collect()} == {"a": "same", "b": "changed", "c": "touched", "d": "deleted", "e": "new"}


def test_scan_and_load(spark, tmp_path):
    tree = {"a.py": b"x = 1\n", "src/b.RS": b"fn a() {}", "node_modules/c.py": b"y", "n.txt": b"text", "bin.py": b"\0\1", "d.bin": b"zz", "h.h": b"int a;", "big.md": b"a" * ((1 << 20) + 1), "bad.txt": b"\xff\xfe"}
    for name, body in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    scanned = files.scan(spark, str(tmp_path), globs=["**/*.bin"])
    assert sorted(r.path for r in scanned.select("path").collect()) == sorted(set(tree) - {"node_modules/c.py", "d.bin"})
    assert files.weight(scanned).first().files == len(tree) - 2
    rows = {r.path: r for r in files.loaded(scanned).collect()}
    assert sorted(rows) == ["a.py", "bad.txt", "h.h", "n.txt", "src/b.RS"]
    assert rows["h.h"].language == "c" and rows["src/b.RS"].language == "rust" and rows["bad.txt"].content is None
    assert {r.path for r in files.loaded(scanned, exempt=["big.md"]).collect()} >= {"big.md"}
    parsed, searched = files.parts(files.loaded(scanned))
    assert {r.path for r in searched.collect()} == {"n.txt", "bad.txt", "h.h"} and parsed.count() == 3
    found = extract.extract(parsed).collect()
    assert {(r.path, r.entity, r.name) for r in found} >= {("a.py", "variable", "x"), ("src/b.RS", "function", "a")}
    # A file that is gone by the time it is read fails alone.
    (tmp_path / "n.txt").unlink()
    listing = scanned.unionByName(scanned.filter("path = 'a.py'").withColumns({"path": F.lit("gone.txt"), "uri": F.lit(f"file:{tmp_path}/gone.txt")}))
    assert {r.path: r.content is None for r in files.loaded(listing).collect() if r.path in ("gone.txt", "a.py")} == {"gone.txt": True, "a.py": False}


def names(language, source, entity):
    return [(r[2], r[3], r[6], r[8]) for r in extract.extract_text("f", language, source) if r[1] == entity]


def test_python_extractor():
    source = "import os.path\nfrom .a import b as c\nX = 1\nclass A(B, C):\n    async def f(self, x=1):\n        return g(h(x))\ny()\n"
    assert names("python", source, "function") == [("f", "A.f", "self, x=1", None)]
    assert names("python", source, "class") == [("A", None, "B, C", None)]
    assert names("python", source, "import") == [("os.path", None, "os.path", None), ("c", None, ".a", None)]
    assert [(n, c) for n, _, _, c in names("python", source, "call")] == [("g", "f"), ("h", "f"), ("y", "<module>")]
    assert names("python", "X = '" + "a" * 300 + "'", "variable")[0][2] == "'" + "a" * 199
    assert extract.extract_text("f", "python", "def broken(") == [] and extract.extract_text("f", "cobol", "x") == []


@pytest.mark.parametrize(
    "language,source,function,owner,imported",
    [
        ("rust", "use a::b;\nimpl Foo {\n pub fn bar(&self) { baz() }\n}\n// fn no() {}", "bar", "Foo::bar", "a::b"),
        ("go", 'package m\nimport "fmt"\nfunc (r *R) M(a int) int { return baz(a) }', "M", "R.M", "fmt"),
        ("java", "import a.b.C;\nclass A extends B {\n  public int f(int x) { return baz(x); }\n}", "f", "A.f", "a.b.C"),
        ("javascript", 'import x from "y";\nclass A extends B {\n  m(x) { this.baz(x) }\n}', "m", "A.m", "y"),
        ("typescript", 'import {x} from "y";\nclass A implements I {\n  m(x: number): string { return baz(x) }\n}', "m", "A.m", "y"),
        ("php", "<?php\nuse A\\B;\nclass C extends D { function f($x) { return baz($x); } }", "f", "C::f", "A\\B"),
        ("c", "#include <stdio.h>\nint f(int a) { return baz(a); }", "f", "f", "stdio.h"),
        ("cpp", '#include "a.h"\nint A::f(int a) { return baz(a); }', "f", "A::f", "a.h"),
        ("csharp", "using System;\nclass A : B {\n  public int F(int x) { return baz(x); }\n}", "F", "A.F", "System"),
        ("ruby", 'require "x"\nclass A < B\n  def m(x)\n    baz(x)\n  end\nend', "m", "A#m", "x"),
        ("swift", "import Foundation\nclass A: B {\n  func f(x: Int) -> Int { return baz(x) }\n}", "f", "A.f", "Foundation"),
    ],
)
def test_pattern_extractors(language, source, function, owner, imported):
    assert [(n, q) for n, q, _, _ in names(language, source, "function")] == [(function, owner)]
    assert [d for _, _, d, _ in names(language, source, "import")] == [imported]
    assert ("baz", function) in [(n, c) for n, _, _, c in names(language, source, "call")]


def test_html_and_xml_extractors():
    page = '<div id="a" class="b c"><a href="/x">t</a><img src="i.png"></div><link href="s.css"><script>var x;\n</script><form id="q"><input name="i" type="text"></form><p>'
    assert names("html", page, "class")[0][:3] == ("a", None, "div") and ("q", None, "form", None) in names("html", page, "class")
    assert [n for n, *_ in names("html", page, "variable")] == ["class:b", "class:c", "i"]
    assert [r[7] for r in extract.extract_text("f", "html", page) if r[1] == "import"] == ["link", "img", "stylesheet"]
    assert [n for n, *_ in names("html", page, "function")] == ["inline_script_1", "form_q"]
    meta = "<MetaDataObject><Catalog><Properties><Name>Goods</Name></Properties><Attribute><Properties><Name>Owner</Name><Type>cfg:CatalogRef.Firms</Type></Properties></Attribute></Catalog></MetaDataObject>"
    assert names("xml", meta, "class")[0][0] == "Goods" and names("xml", meta, "variable") == [("Owner", None, "cfg:CatalogRef.Firms", None)]
    assert extract.extract_text("f", "xml", "<MetaDataObject><broken>") == []


def test_code_usages_skip_comments(spark):
    rows = spark.createDataFrame([("f", 1, 'x = Catalogs.A; // Catalogs.B'), ("f", 2, 's = "Catalog.C // CatalogRef.D"; my.Catalogs.E()')], "path string, line long, text string")
    found = derive.code_usages(rows, ["Catalogs"], ["Catalog"])
    assert {(r.line, r.usage_kind, r.object_ref) for r in found.collect()} == {(1, "manager", "Catalogs.A"), (2, "query", "Catalog.C"), (2, "ref_type", "CatalogRef.D")}


def test_code_usages_of_a_very_long_line(spark):
    long = 'x = "Catalog.A"; ' + "y = 1 / 2; " * 50_000 + 'Catalogs.B.Find(); "Catalog.C // no comment"; // Catalogs.D'
    rows = spark.createDataFrame([("p", 1, long), ("p", 2, None), ("p", 3, 'z = "CatalogRef.E')], "path string, line long, text string")
    found = derive.code_usages(rows, ["Catalogs"], ["Catalog"]).collect()
    assert {(r.line, r.usage_kind, r.object_ref) for r in found} == {(1, "query", "Catalog.A"), (1, "manager", "Catalogs.B"), (1, "query", "Catalog.C"), (3, "ref_type", "CatalogRef.E")}


def test_link_targets(spark):
    rows = [("o", "a", "cfg:CatalogRef.X"), ("o", "b", "cfg:DocumentRef"), ("o", "c", "xs:string"), ("o", "d", "cfg:AnyRef"), ("o", "e", "cfg:DefinedType.T")] + [("o", "m", f"cfg:CatalogRef.N{i}") for i in range(31)]
    found = derive.link_targets(spark.createDataFrame(rows, "object string, attribute string, type string"))
    assert {(r.attribute, r.target) for r in found.collect()} == {("a", "Catalog.X"), ("b", "*Document"), ("d", "*Any"), ("e", "DefinedType.T"), ("m", "*Multiple")}


def test_subscription_sources(spark):
    rows = spark.createDataFrame([("s1", "e", "m", '["DocumentObject.Order"]'), ("s2", "e", "m", '["Document.Other"]')], "name string, event string, handler_module string, sources_json string")
    for wanted in ("document.order", "DocumentObject.Order", "ORDER"):
        assert [r.name for r in refs.subscriptions(rows, source=wanted).collect()] == ["s1"]


def test_shaping():
    answer = {"rows": [{"id": 1, "t": "x" * 50} for _ in range(100)], "few": [1]}
    assert "id" not in str(shaping.strip(answer))
    capped = shaping.cap({"rows": list(answer["rows"])}, 1000)
    assert shaping.size(capped) <= 1000 and capped["rows_total"] == 100 and capped["rows_truncated"]
    left = shaping.omit_sections({"a": list(range(500)), "b": [1]}, 100)
    assert left["_omitted"] == ["a"] and left["_count"] == {"a": 500}
    shrunk = shaping.shrink_results({"results": [{"s": list(range(300))} for _ in range(4)]}, budget=500)
    assert len(shrunk["results"]) >= 1 and shaping.size(shrunk) <= 900
    first, more = shaping.page(["x" * 5000] * 3, 4000)
    assert len(first) == 1 and more
    assert shaping.clamp_budget(None) == 48_000 and shaping.clamp_budget(10**9) == 4 * 48_000
    assert shaping.cache_key("r", "t", {"b": 1, "a": 2, "repo": "r"}) == shaping.cache_key("r", "t", {"a": 2, "b": 1})
    assert "columns" in shaping.file_map([{"a": 1}] * 121) and "entries" in shaping.file_map([{"a": 1}])
    assert shaping.fold({"a": "x" * 100}, {"n": 1}, 50) == {"n": 1}


def test_cache_and_sessions():
    now = [0.0]
    cache = shaping.AnswerCache(2, 15, lambda: now[0])
    assert cache.put("r", "r|k1", 1, [], 0) and cache.put("r", "r|k2", 2, ["f"], 0)
    now[0] = 20
    assert cache.get("r|k1") is None and cache.get("r|k2") == 2
    assert cache.changed("r", ["f"]) == 1 and cache.get("r|k2") is None
    assert not cache.put("r", "r|k3", 3, ["f"], 0)
    sent = shaping.Delivered(rows=3)
    assert sent.fresh("s", "t|r", [1, 2, 1]) == ([1, 2], 1)
    assert sent.fresh("s", "t|r", [2, 3]) == ([3], 1) and sent.fresh("s", "u|r", [2]) == ([2], 0)


def test_debounced_batches(spark):
    rows = [("r", 0.0, "a", "Created"), ("r", 1.0, "a", "Modified"), ("r", 1.5, "b", "Created"), ("r", 9.0, "a", "Deleted"), ("q", 0.5, "z", "Created")]
    events = spark.createDataFrame(rows, "repo string, t double, path string, kind string").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    found = debounce.batches(events, ["repo"], 1.5).select("repo", "batch", "path", "kind")
    assert sorted(map(tuple, found.collect())) == [("q", 1, "z", "Created"), ("r", 1, "a", "Modified"), ("r", 1, "b", "Created"), ("r", 2, "a", "Deleted")]
    assert debounce.batches(events, ["repo"], 100, 5).filter("repo = 'r'").select("part").distinct().count() == 2
    assert debounce.route(8000) == "incremental" and debounce.route(8001) == "full"


def test_debounce_stream(spark, tmp_path):
    source, shape = tmp_path / "in", "repo string, path string, kind string"
    spark.createDataFrame([("r", "a", "Created"), ("r", "a", "Deleted"), ("r", "b", "Created")], shape).coalesce(1).write.json(str(source))
    out = debounce.debounce_stream(spark.readStream.schema(shape).json(str(source)), gap_ms=300, longest_ms=5000)
    sink = out.writeStream.format("memory").queryName("debounced").outputMode("append").trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(150):
            rows = spark.table("debounced").collect()
            if rows:
                break
            sink.awaitTermination(0.4)
    finally:
        sink.stop()
    assert [(r.repo, dict(zip(r.paths, r.kinds, strict=True)), r.settled) for r in rows] == [("r", {"a": "Deleted", "b": "Created"}, True)]
