"""set_03_node_union: counts whose tasks hold a bounded number of rows, however many there are (F27)."""

import re

import parity
from crashgrid.operators.graph import build
from crashgrid.sources import star
from test_shared_ids import folder  # noqa: F401  (a module's own copy of the tables with shared ids)


def test_type_counts_of_shared_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(build, "PART_ROWS", 3)
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("a", None), (None, "x"), ("c", None)]
    got = build.type_counts(spark.createDataFrame(rows, "node_type string, id string"))
    assert {tuple(r) for r in got.collect()} == {("a", 4, 2), ("b", 1, 1), (None, 1, 1), ("c", 1, 0)}


def test_tasks_follow_the_rows(spark, folder, monkeypatch):  # noqa: F811
    monkeypatch.setattr(build, "PART_ROWS", 1000)
    monkeypatch.setattr(star, "PART_LINES", 500)
    tables = star.Star(spark, folder)
    lines, spread = tables.raw("lineitem").count(), tables.spread()
    assert spread.vic.rdd.getNumPartitions() == lines // 500 + 1
    assert sorted(spread.vic.collect(), key=str) == sorted(tables.vic.collect(), key=str)
    assert sorted(spread.veh.collect(), key=str) == sorted(tables.veh.collect(), key=str)
    nodes = build.graph_from_tables(spread.acc, spread.loc, spread.vic, spread.veh)[0]
    counted = build.type_counts(nodes)
    asked = nodes.count() // 1000 + 1
    plan = re.sub(r"#\d+", "", counted._jdf.queryExecution().executedPlan().toString())
    assert asked > 8 and f"hashpartitioning(node_type, id, {asked})" in plan
    status, _, _, _, detail = parity.compare(spark, parity.duck(folder), folder, "set_03_node_union")
    assert status == "OK", detail
