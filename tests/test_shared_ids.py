"""Vertex rows that share an id: line items whose row ids collide, as happens in larger tables."""

import shutil
from pathlib import Path

import duckdb
import pytest

import parity
from crashgrid.operators.ranking import keep_first

SF = Path("/root/testdata/sf0.001")
NAMES = """g_04_pagerank g_09_component_sizes g_16_ego_counts join_12_scores_with_attributes ml_01_features ml_02_standardise
ml_07_reasons src_09_graph_upsert str_02_components_after_append str_02_pagerank_after_append""".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """sf0.001 with repeated line items, and with others that share the row id but not the age."""
    root = tmp_path_factory.mktemp("shared")
    for f in SF.glob("*.parquet"):
        if f.name != "lineitem.parquet":
            shutil.copy(f, root)
    lines = f"SELECT * {{}} FROM '{SF}/lineitem.parquet'"
    other = "REPLACE (l_suppkey + 131 AS l_suppkey, l_quantity - 1 AS l_quantity)"
    duckdb.sql(
        f"COPY ({lines.format('')} UNION ALL {lines.format('')} WHERE l_orderkey % 40 = 3 UNION ALL"
        f" {lines.format(other)} WHERE l_orderkey % 40 = 7 AND l_quantity > 2) TO '{root}/lineitem.parquet' (FORMAT parquet)")
    return str(root)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_check_sql_where_ids_are_shared(spark, folder, name):
    status, _, _, _, detail = parity.compare(spark, parity.duck(folder), folder, name)
    assert status == "OK", detail


def test_first_victim_of_a_shared_id_does_not_depend_on_the_order_of_rows(spark):
    """win_05: the id leaves the row open, the age decides."""
    rows = [(1, 5, a) for a in (30, 20, 40)]
    for turned in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(turned, "accident_id long, id long, age int").coalesce(1)
        assert [tuple(r) for r in keep_first(df, "accident_id", "id", "age").collect()] == [(1, 5, 20)]
