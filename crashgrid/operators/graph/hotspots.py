"""Location hotspots, composite risk and the viewer extract."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions.bands import lookup, risk_level
from crashgrid.operators.graph.build import edge_sample
from crashgrid.operators.graph.centrality import degree, pagerank, top_nodes
from crashgrid.operators.ranking import concat_first
from crashgrid.session import cut

# fixed value: danger score that counts as full danger
DANGER_SCALE = 30.0


def location_scores(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct reports, danger score and severity counts of every location with reports."""
    firs = vertices.filter("node_type = 'FIR'").select(F.col("id").alias("src"), "severity")
    locations = vertices.filter("node_type = 'Location'").select(F.col("id").alias("dst"), "area", "city", "lat", "lng")
    pairs = edges.select("src", "dst").join(locations.select("dst"), "dst", "left_semi").distinct().join(firs, "src")
    severity = F.coalesce("severity", F.lit("Unknown"))
    scored = pairs.withColumn("severity", severity).groupBy("dst").agg(
        F.count("*").alias("fir_count"),
        F.round(F.sum(lookup(F.col("severity"), fv.DANGER_WEIGHT, 0.5)), 2).alias("danger_score"),
        *[F.count_if(F.col("severity") == s).alias(f"_{s}") for s in fv.SEVERITIES])
    counts = F.array(*[F.struct(F.lit(s).alias("k"), F.col(f"_{s}").alias("v")) for s in fv.SEVERITIES])
    return locations.join(scored, "dst").select(
        F.col("dst").alias("location_id"), "area", "city", "lat", "lng", "fir_count", "danger_score",
        F.map_from_entries(F.filter(counts, lambda e: e["v"] > 0)).alias("severity_breakdown"))


def hotspots(vertices: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return location_scores(vertices, edges).orderBy(F.desc("danger_score"), F.desc("fir_count"), "location_id").limit(n)


def risk_scores(vertices: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Composite 0-100 risk of every location with reports; the n riskiest are returned."""
    found = cut(location_scores(vertices, edges))
    places = found.select(F.col("location_id").alias("id"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(places, "id", "left_semi")
    size = F.broadcast(vertices.agg(F.count("*").alias("_n")))
    deg = ends.groupBy(F.col("id").alias("location_id")).agg(F.count("*").alias("_d")).join(size).select(
        "location_id", F.when(F.col("_n") > 1, F.col("_d") / (F.col("_n") - 1)).otherwise(1.0).alias("_deg"))
    rank = pagerank(vertices, edges).select(F.col("id").alias("location_id"), F.col("score").alias("_rank"))
    joined = found.join(deg, "location_id").join(rank, "location_id")
    fatal = F.coalesce(F.col("severity_breakdown")["Fatal"], F.lit(0)) / F.col("fir_count")
    score = F.col("danger_score") / DANGER_SCALE * 50 + F.col("_deg") * 20 + F.col("_rank") * 100 * 15 + fatal * 15
    return joined.withColumn("risk_score", F.least(F.round(score, 2), F.lit(100.0))).withColumns({
        "risk_level": risk_level(F.col("risk_score")), "fatality_rate": F.round(fatal, 3),
        "graph_centrality": F.round("_deg", 4), "graph_pagerank": F.round("_rank", 4),
    }).drop("_deg", "_rank").orderBy(F.desc("risk_score"), "location_id").limit(n)


def viewer_extract(vertices: DataFrame, edges: DataFrame, nodes: int = 100, links: int = 300):
    """Nodes for display (PageRank leaders, then degree leaders) and an edge sample."""
    by_rank = top_nodes(pagerank(vertices, edges), vertices, nodes).select("node", "node_type", "score")
    by_degree = top_nodes(degree(vertices, edges), vertices, nodes).select("node", "node_type", "score")
    neg = lambda df: df.withColumn("rank", -F.col("score"))
    return concat_first(neg(by_rank), neg(by_degree), "node", "rank").drop("rank"), edge_sample(edges, links)
