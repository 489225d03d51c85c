from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire.operators import relational as R


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f"n{i % 3}", i % 4) for i in range(20)], "id int, name string, v int")


def test_lookups(spark, rows):
    assert R.point_lookup(rows, 3).count() == 1
    with pytest.raises(R.NotFound):
        R.point_lookup(rows, 99)
    assert R.in_lookup(rows, []).count() == 0
    assert R.in_lookup(rows, [1, 2, 99]).count() == 2
    assert R.semi_lookup(rows, spark.createDataFrame([(1,), (1,), (5,)], "k int")).count() == 2


def test_pages_meet_and_end(rows):
    seen, cursor = [], None
    while True:
        got, cursor = R.page_of(rows, ["v", "id"], 6, cursor, (int, int), descending=True)
        seen += [(r.v, r.id) for r in got]
        if cursor is None:
            break
    assert seen == sorted(((i % 4, i) for i in range(20)), reverse=True)


@pytest.mark.parametrize("bad", ["", "%%%", "YWJj", "MXxi"])
def test_foreign_cursors_are_refused(bad):
    with pytest.raises(R.InvalidCursor):
        R.decode_cursor(bad, int, int)


def test_cursor_round_trip():
    at = datetime(2024, 5, 6, 7, 8, 9, 123456)
    assert R.decode_cursor(R.encode_cursor(at, "x"), datetime.fromisoformat, str) == (at, "x")


def test_page_limits():
    assert R.page_limit(None) == 50
    for bad in (0, 201):
        with pytest.raises(ValueError):
            R.page_limit(bad)


def test_keyset_filter_reaches_the_scan(spark, data):
    page = R.keyset_page(spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 5, (100, 2))
    plan = page._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_orderkey,100)" in plan and "TakeOrderedAndProject" in plan


def test_edges_once_each(spark):
    edges = spark.createDataFrame([("a", "b", "near", 0.5), ("b", "c", "near", None), ("x", "y", "near", None)], "source_id string, target_id string, kind string, score double")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert R.edges_touching(edges, ids).count() == 2
    nested = {r.id: len(r.edges) for r in R.nest_edges(spark.createDataFrame([("a",), ("b",), ("z",)], "id string"), edges).collect()}
    assert nested == {"a": 1, "b": 2, "z": 0}


def test_missing_partners_fail(spark, rows):
    others = spark.createDataFrame([("n0",), ("n1",)], "k string")
    with pytest.raises(Exception, match="name is missing: n2"):
        R.strict_join(rows, others, "name", "k", "name").collect()


def test_order_of_members(spark):
    units = spark.createDataFrame([("u", ["e2", "e1", "e2"])], "id string, element_ids array<string>")
    elements = spark.createDataFrame([("e1", 1), ("e2", 2)], "id string, page int")
    assert [m.page for m in R.in_order(units, elements).first().members] == [2, 1, 2]


def test_last_and_first_win(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert {r.k: r.v for r in R.last_wins(a, b, key="k").collect()} == {1: "a", 2: "c"}
    d = R.ordered_distinct(spark.createDataFrame([(1, "x", 5), (1, "y", 2)], "k int, v string, at int"), ["k"], "at")
    assert d.first().v == "y"
    assert R.concatenated(a, b).where("family = 1").count() == 1


def test_registration_skips_known_fingerprints(spark):
    new = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "id string, sha256 string")
    old = spark.createDataFrame([("0", "y")], "id string, sha256 string")
    assert [r.id for r in R.register_by_fingerprint(new, old).collect()] == ["1"]


def test_latest_breaks_ties(spark):
    rows = spark.createDataFrame([("d", 1, "a"), ("d", 1, "b"), ("e", 0, "c")], "d string, at int, id string")
    assert {r.d: r.id for r in R.latest_per_key(rows, "d", "at", "id").collect()} == {"d": "b", "e": "c"}


def test_display_status(spark):
    got = spark.createDataFrame([("completed",), (None,)], "s string").select(R.display_status(F.col("s")).alias("x"))
    assert [r.x for r in got.collect()] == ["completed", "pending"]
