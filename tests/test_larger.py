"""Queries on tables that only larger data show: keys far apart, changes over many files, rows of a large row group."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from orrery.operators import search
from orrery.plans.catalogue import ORACLES, QUERIES
from orrery.streaming import debounce


def same_as_sql(spark, folder, name, table):
    """The rows of a query over one table, after they were held against its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    assert want == sorted((tuple(r[c] for c in names) for r in QUERIES[name](spark, folder).collect()), key=repr)
    return want


def test_changes_in_any_order_of_files(spark, tmp_path):
    r, began = random.Random(1), datetime.datetime(2024, 1, 1)
    rows = [(i, began + datetime.timedelta(seconds=r.randrange(400)), r.randrange(20) if i % 50 else None, r.choice(["view", "click"]), r.choice([10.0, 95.0])) for i in range(1200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.repartition(12).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a task and so a file of the stream for each file
    try:
        assert len(same_as_sql(spark, str(tmp_path), "event_debounce_stream", "events")) > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_late_change_of_a_deleted_path(spark):
    shape = "path string, kind string, ts long, value long"
    table = spark.createDataFrame([("a", "Deleted", 5, 1), ("b", "Modified", 5, 1), ("c", "Modified", 5, 1)], shape)
    late = spark.createDataFrame([("a", "Modified", 4, 2), ("b", "Deleted", 4, 2), ("c", "Deleted", 6, 2), ("d", "Modified", 1, 2)], shape)
    once = debounce.apply_dated(table, late)
    for found in (once, debounce.apply_dated(once, late)):
        assert sorted((x.path, x.value) for x in debounce.alive(found).collect()) == [("b", 1), ("d", 2)]


def test_definitions_with_keys_far_apart(spark, tmp_path):
    r = random.Random(2)
    rows = [(k * 1000000 + i, r.randrange(10), r.choice("OFP"), r.choice(["1-URGENT", "5-LOW", None])) for i in range(40) for k in range(20)]
    rows += [(None, 1, "O", "2-HIGH"), (None, 11, "O", "2-HIGH"), (7, None, "O", "2-HIGH"), (8, 12, "F", None)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    assert len(same_as_sql(spark, str(tmp_path), "merged_structure", "orders")) == 33


@pytest.mark.parametrize("positions", [False, True])
def test_postings_are_counted_within_rows(spark, positions):
    """One task's memory doesn't grow with the postings of its rows: nothing is aggregated, unless documents have several rows."""
    docs = spark.createDataFrame([(1, "b a b", "x"), (2, None, ""), (3, "...", "a a"), (4, "Straße é b2 b b2", None)], "id long, t string, u string")
    index = search.postings(docs, "id", ["t", "u"], positions)
    assert "Aggregate" not in index._jdf.queryExecution().toString()
    want = {(1, "t", "a"): [1], (1, "t", "b"): [0, 2], (1, "u", "x"): [0], (3, "u", "a"): [0, 1], (4, "t", "straße"): [0], (4, "t", "é"): [1], (4, "t", "b2"): [2, 4], (4, "t", "b"): [3]}
    rows = index.collect()
    assert {(r.doc, r.field, r.term): r.tf for r in rows} == {k: len(v) for k, v in want.items()} and len(rows) == len(want)
    assert not positions or {(r.doc, r.field, r.term): r["at"] for r in rows} == want
    assert dict(index.dtypes)["tf"] == "bigint"
    assert {r.doc: r["size"] for r in search.lengths(docs, "id", ["t", "u"]).collect()} == {1: 4, 2: 0, 3: 2, 4: 5}


def test_postings_of_documents_with_several_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b c b"), (None, "a"), (None, "a"), (2, "a a")], "id long, t string")
    found = sorted(((r.doc, r.term, r.tf) for r in search.postings(docs, "id", ["t"]).collect()), key=repr)
    assert found == [(1, "a", 1), (1, "b", 3), (1, "c", 1), (2, "a", 2), (None, "a", 2)]


@pytest.mark.parametrize("name", ["search_stored_index", "search_stored_overlap", "search_stored_phrase", "search_weighted_fields"])
def test_stored_search_counts_rows_without_tokens(spark, tmp_path, name):
    words = ["steel red", "gizmo blue", "blue gizmo gi", "gi", "red", "", "--"]
    rows = [(i, words[i % 7], None if i % 7 > 4 else "tin", "" if i % 7 > 4 else "big") for i in range(70)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    assert same_as_sql(spark, str(tmp_path), name, "part")
