"""The indexing job and the tools, end to end on a small tree; configuration files; sinks."""

import pytest
from pyspark.sql import functions as F

from orrery.plans import guard, indexing
from orrery.plans.engine import Engine
from orrery.sources import config_xml, files, sinks

TREE = {
    "pkg/a.py": "import os\n\nclass Base:\n    pass\n\nclass Child(Base):\n    def run(self, n):\n        return helper(n)\n\ndef helper(n):\n    return os.getcwd()\n",
    "pkg/b.py": "from pkg.a import helper\n\ndef main():\n    helper(1)\n    main()\n",
    "web/page.html": '<div id="top" class="big"><a href="/x">Run helper</a></div>',
    "notes.md": "Helper notes\nrun the helper\nend\n",
}


def write(root, tree):
    for name, body in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, TREE)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree):
    return Engine(spark, {k: v.cache() for k, v in indexing.index(spark, str(tree)).items()})


def test_counts(engine):
    stats = engine.get_stats()
    assert (stats["files"], stats["functions"], stats["classes"], stats["texts"]) == (4, 3, 3, 2)


def test_lookup_tools(engine):
    found = engine.get_function("helper")
    assert found["matched"] == "exact" and found["results"][0]["args"] == "n" and "id" not in found["results"][0]
    assert engine.get_function("HELPER")["matched"] == "ignoring case"
    assert engine.get_function("helperr")["did_you_mean"] == ["helper"]
    assert engine.get_function(["run", "none"])["missing"] == ["none"]
    assert engine.get_class("Child")["results"][0]["bases"] == "Base"
    symbol = engine.find_symbol("helper")
    assert [len(symbol[k]) for k in ("functions", "classes", "variables", "imports")] == [1, 0, 0, 1]
    assert engine.get_imports(module="os")["imports"][0]["name"] == "os"


def test_call_tools(engine):
    assert {c["caller"] for c in engine.get_callers("helper")["calls"]} == {"run", "main"}
    assert engine.get_callees("main")["total"] == 2
    assert [s["callee"] for s in engine.find_path("main", "getcwd")["path"]] == ["helper", "getcwd"]
    assert engine.find_path("main", "main")["found"] and not engine.find_path("getcwd", "main")["found"]
    assert engine.get_call_tree("main", max_depth=2)["tree"]["children"][0]["name"] == "helper"


def test_search_and_grep_tools(engine):
    assert engine.search_function("helper")[0]["name"] == "helper"
    assert engine.search_class("child base")[0]["name"] == "Child"
    assert engine.search_text("notes")[0] == {"path": "notes.md", "snippet": "Helper notes run the helper end"}
    assert engine.grep_text("^run")["files"] == {"notes.md": ["2: run the helper"]}
    assert engine.grep_text("^run", context_lines=1)["files"]["notes.md"] == ["1: Helper notes", "2: run the helper", "3: end"]
    assert set(engine.grep_code("helper", path_glob="pkg/**")["files"]) == {"pkg/a.py", "pkg/b.py"}
    assert engine.grep_code("helper", limit=1)["truncated"]
    assert engine.grep_body(pattern="GETCWD")["files"] == {"pkg/a.py": ["helper: 11"]}
    with pytest.raises(ValueError, match="exactly one"):
        engine.grep_body()


def test_file_tools(engine):
    assert engine.list_files("**/*.py")["total"] == 2
    assert engine.stat_file("pkg/a.py")["language"] == "python"
    assert engine.stat_file("pkg/none.py") == {"exists": False, "hint": ["pkg/a.py", "pkg/b.py"]} or not engine.stat_file("pkg/none.py")["exists"]
    part = engine.read_file("pkg/b.py", 3, 4)
    assert part["content"] == "def main():\n    helper(1)" and part["lines_total"] == 5
    assert engine.read_file("notes.md")["category"] == "text" and engine.read_file("none")["content"] is None
    assert engine.get_file_summary("pkg/a.py")["functions_total"] == 2


def test_sql_tool(engine):
    answer = engine.sql("SELECT name FROM functions WHERE name LIKE ? ORDER BY name", ["h%"])
    assert answer.rows == [["helper"]]
    with pytest.raises(guard.Refused, match="Did you mean: .*name"):
        engine.sql("SELECT nam FROM functions")
    assert engine.health()["tables"][0] == "calls"


def test_incremental_equals_full(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, TREE)
    tables = indexing.index(spark, str(root))
    sinks.snapshot(tables, str(tmp_path / "stored"))
    before = sinks.load(spark, str(tmp_path / "stored"), list(tables))
    (root / "pkg/b.py").write_text("def other():\n    return 1\n")
    (root / "notes.md").unlink()
    write(root, {"new.go": "package m\nfunc F(a int) int { return g(a) }\n"})
    # What hasn't changed isn't opened: it could not be read.
    scanned = files.scan(spark, str(root)).withColumn("uri", F.when(F.col("path").isin("pkg/b.py", "new.go"), F.col("uri")).otherwise("file:/nowhere"))
    after = indexing.update(before, scanned)
    whole = indexing.index(spark, str(root))
    for name in whole:
        key = lambda r: str(r)
        assert sorted(after[name].select(*whole[name].columns).collect(), key=key) == sorted(whole[name].collect(), key=key), name


CATALOG = """<MetaDataObject xmlns:v8="x"><Catalog uuid="u1"><Properties><Name>Goods</Name><Synonym><v8:item><v8:lang>en</v8:lang><v8:content>Goods</v8:content></v8:item>
<v8:item><v8:lang>ru</v8:lang><v8:content>Товары</v8:content></v8:item></Synonym><Owners><xr:Item>Catalog.Firms</xr:Item></Owners></Properties><ChildObjects>
<Attribute><Properties><Name>Unit</Name><Type><v8:Type>cfg:CatalogRef.Units</v8:Type><v8:Type>xs:string</v8:Type></Type></Properties></Attribute>
<TabularSection><Properties><Name>Parts</Name></Properties><ChildObjects><Attribute><Properties><Name>Part</Name><Type><v8:Type>cfg:CatalogRef.Goods</v8:Type></Type></Properties></Attribute></ChildObjects></TabularSection>
</ChildObjects></Catalog></MetaDataObject>"""
CONFIG = {
    "Catalogs/Goods.xml": CATALOG,
    "Documents/Sale.xml": "<MetaDataObject><Document><Properties><Name>Sale</Name><RegisterRecords><xr:Item>AccumulationRegister.Stock</xr:Item></RegisterRecords></Properties></Document></MetaDataObject>",
    "InformationRegisters/Prices.xml": "<MetaDataObject><InformationRegister><Properties><Name>Prices</Name></Properties><ChildObjects><Dimension><Properties><Name>Item</Name><Type><v8:Type>cfg:CatalogRef.Goods</v8:Type></Type></Properties></Dimension></ChildObjects></InformationRegister></MetaDataObject>",
    "Subsystems/Trade.xml": "<MetaDataObject><Subsystem><Properties><Name>Trade</Name><Content><xr:Item xsi:type='a'>Document.Sale</xr:Item></Content></Properties></Subsystem></MetaDataObject>",
    "FunctionalOptions/Use.xml": "<MetaDataObject><FunctionalOption><Properties><Name>Use</Name><Location>Constant.Use</Location><Content><xr:Object>Document.Sale.Attribute.X</xr:Object></Content></Properties></FunctionalOption></MetaDataObject>",
    "DefinedTypes/D.xml": "<MetaDataObject><DefinedType><Properties><Name>D</Name><Type><v8:Type>cfg:CatalogRef.Goods</v8:Type></Type></Properties></DefinedType></MetaDataObject>",
    "EventSubscriptions/S.xml": "<MetaDataObject><EventSubscription><Properties><Name>S</Name><Source><Type><v8:Type>cfg:DocumentObject.Sale</v8:Type></Type></Source><Event>OnWrite</Event><Handler>CommonModule.Mod.OnWriteSale</Handler></Properties></EventSubscription></MetaDataObject>",
    "ExchangePlans/P/Ext/Content.xml": "<ExchangePlanContent><Item><Metadata>Catalog.Goods</Metadata></Item></ExchangePlanContent>",
    "Catalogs/Goods/Forms/Item/Ext/Form.xml": "<Form><Events><Event name='OnOpen'>OnOpen</Event></Events><ChildItems><InputField name='Unit'><Events><Event name='OnChange'>UnitOnChange</Event></Events></InputField></ChildItems></Form>",
    "Roles/Seller/Ext/Rights.xml": "<Rights><object><name>Catalog.Goods</name><right><name>Read</name><value>true</value></right><right><name>Edit</name><value>false</value></right></object></Rights>",
    "ConfigDumpInfo.xml": "<ConfigDumpInfo><Metadata name='Catalog.Goods' id='1' configVersion='v1'/><Metadata id='2' configVersion='v'/></ConfigDumpInfo>",
    "Catalogs/Firms/Firms.mdo": "<mdclass:Catalog uuid='u2'><name>Firms</name><synonym><key>ru</key><value>Фирмы</value></synonym><attributes uuid='a'><name>Head</name><type><types>CatalogRef.People</types></type></attributes></mdclass:Catalog>",
    "broken.xml": "<MetaDataObject><open>",
}


def test_configuration(spark):
    rows = config_xml.read(spark.createDataFrame(list(CONFIG.items()), "path string, content string")).cache()
    objects = {r.full_name: r.synonym for r in config_xml.metadata_objects(rows).collect()}
    assert objects["Catalog.Goods"] == "Товары" and objects["Catalog.Firms"] == "Фирмы" and objects["Document.Sale"] is None
    links = {(r.from_object, r.from_path, r.to_object, r.link_kind) for r in config_xml.data_links(rows).collect()}
    assert links == {
        ("Catalog.Goods", "Unit", "Catalog.Units", "attr"), ("Catalog.Goods", "Parts.Part", "Catalog.Goods", "tabular_attr"), ("Catalog.Goods", "", "Catalog.Firms", "owner"),
        ("Document.Sale", "", "AccumulationRegister.Stock", "recorder"), ("InformationRegister.Prices", "Item", "Catalog.Goods", "register_dim"), ("Subsystem.Trade", "", "Document.Sale", "subsystem_content"),
        ("FunctionalOption.Use", "", "Constant.Use", "functional_option_location"), ("FunctionalOption.Use", "", "Document.Sale", "functional_option_content"),
        ("DefinedType.D", "", "Catalog.Goods", "defined_type_content"), ("ExchangePlan.P", "", "Catalog.Goods", "exchange_plan_content"), ("Catalog.Firms", "Head", "Catalog.People", "attr"),
    }
    (form,) = config_xml.metadata_forms(rows).collect()
    assert (form.owner_full_name, form.form_name) == ("Catalog.Goods", "Item") and '"element":"Unit"' in form.handlers_json
    (sub,) = config_xml.event_subscriptions(rows).collect()
    assert (sub.handler_module, sub.handler_proc, sub.event, sub.sources_json) == ("Mod", "OnWriteSale", "OnWrite", '["DocumentObject.Sale"]')
    assert [(r.role_name, r.object_name, r.right_name) for r in config_xml.role_rights(rows).collect()] == [("Seller", "Catalog.Goods", "Read")]
    assert [tuple(r) for r in config_xml.manifest(rows).collect()] == [("Catalog.Goods", "v1")]
    assert '"attribute":[{"name":"Parts.Part"' in {r.full_name: r.attributes_json for r in config_xml.structures(rows).collect()}["Catalog.Goods"]


def test_object_tools(spark):
    rows = config_xml.read(spark.createDataFrame(list(CONFIG.items()), "path string, content string")).cache()
    tables = {"objects": config_xml.metadata_objects(rows), "links": config_xml.data_links(rows), "forms": config_xml.metadata_forms(rows), "subscriptions": config_xml.event_subscriptions(rows), "rights": config_xml.role_rights(rows)}
    tables["usages"] = spark.createDataFrame([("Catalog.Goods", "f", "manager", 3)], "object_ref string, file_path string, usage_kind string, line long")
    engine = Engine(spark, tables)
    assert engine.get_object_structure("catalog.goods")["name"] == "Goods"
    assert engine.get_object_structure("Catalog.Good")["did_you_mean"][0] == "Catalog.Goods"
    assert engine.get_object_structure(name_like="sal")["results"][0]["full_name"] == "Document.Sale"
    assert engine.get_object_profile("Catalog.Goods")["data_links"]["in"]["register_dim"] == 1
    assert engine.get_data_links("Document.Sale", "out")["out_by_kind"] == {"recorder": 1}
    assert engine.find_data_path("InformationRegister.Prices", "Catalog.Firms")["path"][-1]["link_kind"] == "owner"
    assert engine.get_register_writers("AccumulationRegister.Stock")["writers"] == ["Document.Sale"]
    found = engine.find_references("Catalog.Goods")
    assert found["role_rights"]["total"] == 1 and found["code_usages"]["sample"][0]["line"] == 3
    assert engine.get_form_handlers("Catalog.Goods", "Item", "Unit")["handlers"][0]["handler"] == "UnitOnChange"
    assert engine.get_event_subscriptions(source="document.sale")["total"] == 1
    with pytest.raises(KeyError, match="indexed"):
        engine.search_terms("x")


def test_sinks(spark, tmp_path):
    first = spark.createDataFrame([(f"p{i}", i) for i in range(40)], "path string, v long")
    stored = sinks.bucketed_files(first, buckets=4)
    sinks.write_entities(stored, str(tmp_path / "t"))
    changed = spark.createDataFrame([("p3",), ("p9",)], "path string")
    fresh = spark.createDataFrame([("p3", 300)], "path string, v long")
    old = spark.read.parquet(str(tmp_path / "t")).select("path", "v", "part")
    sinks.write_changes(spark, str(tmp_path / "t"), fresh, changed, buckets=4)
    got = {r.path: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {f"p{i}": i for i in range(40) if i != 9} | {"p3": 300}
    # A partition that loses all its rows goes.
    lost = old.filter("part = 1").select("path")
    names = [r.path for r in lost.collect()]
    sinks.write_changes(spark, str(tmp_path / "t"), fresh.limit(0), spark.createDataFrame([(n,) for n in names], "path string"), buckets=4)
    assert names and not (tmp_path / "t/part=1").exists() and spark.read.parquet(str(tmp_path / "t")).count() == 39 - len(set(names) - {"p9"})
    sinks.snapshot({"a": first}, str(tmp_path / "s"))
    assert sinks.load(spark, str(tmp_path / "s"), ["a"])["a"].count() == 40
    both = sinks.repositories({"x": first, "y": first.limit(3)})
    assert [tuple(r) for r in sinks.repository_stats(both).collect()] == [("x", 40), ("y", 3)]
    assert sinks.missing_content(first, first.filter("v < 30"), "path").count() == 10
    assert sinks.enrichment_candidates(first.select(F.col("path").alias("proc_key")), first.limit(0).select(F.col("path").alias("proc_key"))).count() == 40
    assert sinks.drifted({"a": 1000, "b": 5000}, {"a": 1600, "b": 5100, "c": 10}) == ["a"]
    with pytest.raises(ValueError, match="repositories"):
        sinks.repositories({})
