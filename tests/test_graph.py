"""Graph operators on the sample graph and against brute force on random graphs."""

import itertools
import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from crashgrid.operators.graph import build, centrality, communities, components, hotspots, paths, relations, sampled


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


def frames(spark, nodes, edges):
    v = spark.createDataFrame([(n, "FIR") for n in nodes], "id string, node_type string")
    e = spark.createDataFrame([(a, b, "R", None, 1.0) for a, b in edges], "src string, dst string, rel_type string, role string, weight double")
    return v, e


def adjacency(nodes, edges):
    adj = {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def brute_betweenness(nodes, edges):
    """Shortest-path counting from every node."""
    adj, score, n = adjacency(nodes, edges), dict.fromkeys(nodes, 0.0), len(nodes)
    for s in nodes:
        dist, sigma, order, queue = {s: 0}, dict.fromkeys(nodes, 0.0), [], deque([s])
        sigma[s] = 1.0
        while queue:
            u = queue.popleft()
            order.append(u)
            for w in adj[u]:
                if w not in dist:
                    dist[w] = dist[u] + 1
                    queue.append(w)
                if dist[w] == dist[u] + 1:
                    sigma[w] += sigma[u]
        delta = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for u in adj[w]:
                if dist[u] == dist[w] - 1:
                    delta[u] += sigma[u] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return {k: x / ((n - 1) * (n - 2)) for k, x in score.items()}


GRAPHS = {
    "path": ("abcde", ["ab", "bc", "cd", "de"]),
    "star": ("abcdef", ["ab", "ac", "ad", "ae", "af"]),
    "cycle": ("abcdef", ["ab", "bc", "cd", "de", "ef", "fa"]),
    "twins": ("abcdefgh", ["ac", "ad", "ae", "bc", "bd", "be", "af", "cg", "ch"]),
    "two parts": ("abcdefg", ["ab", "bc", "ca", "de", "ef"]),
    "pair": ("abc", ["ab"]),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_betweenness_small(spark, name):
    nodes, edges = GRAPHS[name]
    got = scores(centrality.betweenness(*frames(spark, nodes, edges)))
    want = brute_betweenness(list(nodes), edges)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12), k


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_random_bipartite(spark, seed):
    rng = random.Random(seed)
    hubs, firs = [f"h{i}" for i in range(6)], [f"f{i}" for i in range(25)]
    edges = [(f, h) for f in firs for h in rng.sample(hubs, rng.randint(1, 3))]
    edges += [(f, f + "x") for f in firs if rng.random() < 0.4]
    nodes = sorted({x for e in edges for x in e} | set(hubs))
    got = scores(centrality.betweenness(*frames(spark, nodes, edges)))
    want = brute_betweenness(nodes, edges)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12), k


@pytest.mark.parametrize("seed", [1, 2])
def test_sampled_betweenness_within_its_error(spark, seed):
    rng = random.Random(seed)
    hubs, firs = [f"h{i}" for i in range(6)], [f"f{i}" for i in range(25)]
    edges = [(f, h) for f in firs for h in rng.sample(hubs, rng.randint(1, 3))]
    edges += [(f, f + "x") for f in firs if rng.random() < 0.4] + [("y1", "y2"), ("y2", "y3")]
    nodes = sorted({x for e in edges for x in e} | set(hubs) | {"alone"})
    used = []
    got = scores(sampled.sampled_betweenness(*frames(spark, nodes, edges), epsilon=0.05, used=used))
    want = brute_betweenness(nodes, edges)
    assert got.keys() == want.keys() and used == sorted(used)
    assert max(abs(got[k] - want[k]) for k in want) <= 0.05


@pytest.mark.parametrize("name", ["path", "star", "cycle", "twins", "pair"])
def test_sampled_betweenness_small(spark, name):
    nodes, edges = GRAPHS[name]
    got = scores(sampled.sampled_betweenness(*frames(spark, nodes, edges), epsilon=0.1))
    want = brute_betweenness(list(nodes), edges)
    assert got.keys() == want.keys()
    # trees fold whole and are exact
    error = 1e-12 if name in ("path", "star", "pair") else 0.1
    assert max(abs(got[k] - want[k]) for k in want) <= error


def test_sample_ends_where_a_bound_that_needs_no_variance_holds():
    sizes, log = sampled.sample_sizes(1000, 1.0, 0.01, 0.1)
    assert all(b <= 2 * a for a, b in zip(sizes, sizes[1:])) and len(sizes) < sampled.ROUNDS
    assert sampled.error_bound(0.0, sizes[0], log) <= 0.01
    assert 1000 * 2 * 2.718281828 ** (-2 * sizes[-1] * 0.01 ** 2) <= 0.05 * 1.0001


def test_sample_structure(sample_graph):
    v, e = sample_graph
    r = components.graph_summary(v, e).first()
    assert (r["total_nodes"], r["total_edges"], r["num_connected_components"], r["is_connected"]) == (15, 13, 2, False)
    assert (r["avg_node_degree"], r["max_node_degree"], r["density"]) == (1.73, 4, 0.061905)
    assert r["relationship_type_counts"] == {"OCCURRED_AT": 5, "INVOLVES_PERSON": 3, "CLASSIFIED_AS": 5}
    sizes = sorted(x["count"] for x in components.components(v, e).groupBy("component").count().collect())
    assert sizes == [3, 12]
    assert round(scores(centrality.degree(v, e))["FIR/2024/001"], 4) == 0.2857


def test_sample_hotspots(sample_graph):
    rows = [(r["location_id"], r["fir_count"], r["danger_score"]) for r in hotspots.hotspots(*sample_graph).collect()]
    assert rows == [("LOC_BENZ_CIRCLE", 2, 6.0), ("LOC_PNBS", 2, 4.0), ("LOC_RAMAVARAPPADU", 1, 1.0)]


def test_sample_paths(sample_graph):
    v, e = sample_graph
    found = paths.shortest_path(v, e, "FIR/2024/004", "FIR/2024/002")
    assert found.length == 6
    assert found.path == ["FIR/2024/004", "LOC_BENZ_CIRCLE", "FIR/2024/001", "OVERSPEEDING", "FIR/2024/005", "LOC_PNBS", "FIR/2024/002"]
    assert paths.shortest_path(v, e, "FIR/2024/003", "FIR/2024/001").status == "disconnected"
    assert paths.shortest_path(v, e, "nowhere", "FIR/2024/001").status == "not_found"
    enriched = paths.enrich_path(paths.connection_report(v, e, "FIR/2024/004", "FIR/2024/002").select("path"), v)
    assert enriched.count() == 7


@pytest.mark.parametrize("seed", [3, 4])
def test_simple_paths_match_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    edges = [p for p in itertools.combinations(nodes, 2) if rng.random() < 0.35]
    adj = adjacency(nodes, edges)

    def walk(path, limit):
        if path[-1] == "n8":
            yield path
        elif len(path) <= limit:
            for nxt in adj[path[-1]] - set(path):
                yield from walk([*path, nxt], limit)

    v, e = frames(spark, nodes, edges)
    shortest = paths.shortest_path(v, e, "n0", "n8").length
    want = sorted((len(p) - 1, p) for p in walk(["n0"], shortest + 2) if len(p) - 1 <= shortest + 2)[:10]
    got = [(r["length"], r["path"]) for r in paths.simple_paths(v, e, "n0", "n8").collect()]
    assert sorted(got) == want


def test_pagerank_does_not_depend_on_size(spark, sample_graph):
    """Ranks of a graph and of disjoint copies of it differ by the number of copies only."""
    v, e = sample_graph
    copies = spark.range(30).select(F.col("id").cast("string").alias("k"))
    many_v = v.crossJoin(copies).withColumn("id", F.concat("id", F.lit("#"), "k")).drop("k")
    many_e = e.crossJoin(copies).withColumns({c: F.concat(c, F.lit("#"), "k") for c in ("src", "dst")}).drop("k")
    one = {r.id: r.score for r in centrality.pagerank(v, e).collect()}
    many = {r.id: r.score for r in centrality.pagerank(many_v, many_e).collect()}
    assert all(abs(s * 30 - one[i.split("#")[0]]) < 1e-9 for i, s in many.items()) and len(many) == 30 * len(one)


def test_components_of_a_chain_leave_no_tables(spark):
    from crashgrid.session import scratch_root

    root = scratch_root(spark).removeprefix("file://")
    tables = lambda: {p for p in os.listdir(root) if p.startswith("table-")}
    os.makedirs(root, exist_ok=True)
    before = tables()
    links = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    parts = components.linked_components(links)
    assert {tuple(r) for r in parts.collect()} == {(i, 0) for i in range(301)}
    assert len(tables() - before) == 1


def test_pagerank_mass_and_fixed_point(sample_graph):
    v, e = sample_graph
    rank = scores(centrality.pagerank(v, e, tol=1e-12))
    assert sum(rank.values()) == pytest.approx(1.0)
    out = {}
    for r in e.collect():
        out.setdefault(r["src"], []).append(r["dst"])
    lost = sum(x for k, x in rank.items() if k not in out)
    for k, x in rank.items():
        flow = sum(rank[s] / len(d) * d.count(k) for s, d in out.items())
        assert x == pytest.approx(0.15 / 15 + 0.85 * (flow + lost / 15), abs=1e-9)


def modularity(edges, part):
    m = len(edges)
    total = 0.0
    for c in set(part.values()):
        inner = sum(part[a] == c and part[b] == c for a, b in edges)
        degree = sum((part[a] == c) + (part[b] == c) for a, b in edges)
        total += inner / m - (degree / (2 * m)) ** 2
    return total


def test_communities_beat_components_and_score_agrees(spark):
    rng = random.Random(5)
    groups = [[f"{g}{i}" for i in range(8)] for g in "abcd"]
    edges = [p for g in groups for p in itertools.combinations(g, 2) if rng.random() < 0.6]
    edges += [(rng.choice(groups[i]), rng.choice(groups[(i + 1) % 4])) for i in range(4)]
    nodes = [n for g in groups for n in g]
    v, e = frames(spark, nodes, edges)
    parts = communities.communities(v, e)
    part = {r["id"]: r["community"] for r in parts.collect()}
    assert set(part) == set(nodes)
    got = components.modularity(e, parts).first()[0]
    assert got == pytest.approx(modularity(edges, part))
    assert got > 0.55 and len(set(part.values())) == 4
    # no two communities can be merged with a gain
    names = sorted(set(part.values()))
    for a, b in itertools.combinations(names, 2):
        assert modularity(edges, {k: a if x == b else x for k, x in part.items()}) <= got + 1e-9


def test_measures_of_some_vertices_equal_those_of_all(spark):
    """Reports that edges lead to, shared and missing vertex rows, parallel edges, loops and ids that are null."""
    rows = [(i, "FIR") for i in ("f1", "f2", "f3", "f4", "f5")] + [(i, "X") for i in ("a", "b", "b", "p1", "p2", "p3", "p3", "p3", None, None)]
    pairs = [("f1", "a"), ("f1", "b"), ("f1", "p1"), ("f1", "p1"), ("f2", "a"), ("f2", "b"), ("f2", "p2"), ("f3", "b"), ("f3", "p3"),
             ("f4", "a"), ("f4", "gone"), ("p1", "f1"), ("p2", "f2"), ("f3", "f3"), ("f2", None), ("lost", "f4"), ("lost", "b")]
    v = spark.createDataFrame(rows, "id string, node_type string")
    e = spark.createDataFrame([(a, b, "R", None, 1.0) for a, b in pairs], "src string, dst string, rel_type string, role string, weight double")
    of = v.filter("node_type = 'FIR'").select("id")
    facts, of_all = centrality.end_facts(v, e, of), centrality.end_facts(v, e)
    firs = {f"f{i}" for i in range(1, 6)}
    ranks = centrality.pagerank(v, e, facts=of_all, copies=True)
    assert sorted(map(str, scores(centrality.degree(v, e)).items())) == sorted(map(str, scores(centrality.degree(v, e, facts=of_all)).items()))
    assert ranks.count() == len(rows) and scores(ranks) == pytest.approx(scores(centrality.pagerank(v, e)), abs=1e-8)
    assert scores(centrality.betweenness(v, e, facts=of_all)) == pytest.approx(scores(centrality.betweenness(v, e)), abs=1e-12)
    for measure in (centrality.degree, lambda *a, **k: centrality.degree(*a, True, **k), centrality.pagerank, centrality.betweenness):
        every, some = scores(measure(v, e)), scores(measure(v, e, facts=facts))
        assert set(some) == firs and some == pytest.approx({i: every[i] for i in firs}, abs=1e-8)


def test_community_report_lists_are_capped(spark):
    nodes, edges = ["LOC"] + [f"F{i:02d}" for i in range(30)], [(f"F{i:02d}", "LOC") for i in range(30)]
    v, e = frames(spark, nodes, edges)
    v = v.withColumn("node_type", F.when(F.col("id") == "LOC", "Location").otherwise("FIR")).withColumns(
        {c: F.lit(None).cast("string") for c in ("severity", "cause", "area", "city")})
    parts = v.select("id", F.lit("x").alias("community"))
    r = communities.community_report(v, e, parts).first()
    assert (r["size"], r["fir_count"], len(r["firs"]), len(r["key_locations"])) == (31, 30, 20, 1)


def test_community_report_joins_vertices_once(spark, sample_graph):
    """Of vertex rows that share an id each counts; the lists are read from the stored join."""
    v, e = sample_graph
    v = v.unionByName(v.filter("id = 'P_001'"))
    report = communities.community_report(v, e)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    rows = {r["community"]: r.asDict(recursive=True) for r in report.collect()}
    assert rows == {r["community"]: r.asDict(recursive=True) for r in communities.community_report(v, e, communities.communities(v, e)).collect()}
    assert sum(r["size"] for r in rows.values()) == v.count()


def test_stored_tables_are_small(spark):
    from pathlib import Path

    from crashgrid.session import cut, drop_cut

    table = cut(spark.range(10))
    assert all(f.name.endswith(".zstd.parquet") for f in Path(table._scratch).glob("*.parquet")) and table.count() == 10
    drop_cut(table)


def test_previous_in_key_spans_partitions(spark):
    rows = [("hot", f"{i:04d}") for i in range(500)] + [("cold", "1"), ("cold", "2")]
    df = spark.createDataFrame(rows, "k string, o string").repartition(7)
    got = {(r["k"], r["o"]): r["previous"] for r in relations.previous_in_key(df, "k", "o").collect()}
    assert got[("hot", "0000")] is None and got[("cold", "2")] == "1"
    assert all(got[("hot", f"{i:04d}")] == f"{i - 1:04d}" for i in range(1, 500))


def test_previous_row_brings_other_columns_over_tasks(spark):
    rows = [("hot", f"{i:04d}", i) for i in range(300)] + [("a", "1", 7), ("z", "1", 8), (None, "1", 9), (None, "2", 10)]
    df = spark.createDataFrame(rows, "k string, o string, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {(r["k"], r["o"]): (r["previous"], r["previous_n"], r["followed"]) for r in relations.previous_in_key(df, "k", "o", "n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert len(got) == 304 and got[("a", "1")] == got[("z", "1")] == (None, None, False)
    assert got[(None, "1")] == (None, None, True) and got[(None, "2")] == ("1", 9, False)
    assert all(got[("hot", f"{i:04d}")] == (f"{i - 1:04d}" if i else None, i - 1 if i else None, i < 299) for i in range(300))


@pytest.mark.parametrize("listed", [1000, 3, 0])
def test_related_reports_of_many_entities_are_scored_apart(spark, monkeypatch, listed):
    """Against plain counts, with reports on both sides of the bound."""
    monkeypatch.setattr(relations, "LISTED", listed)
    r = random.Random(5)
    own = {f"F{i:02}": {f"P{i}"} | {f"L{r.randrange(6)}" for _ in range(r.randrange(0, 3))} | {f"C{r.randrange(3)}" for _ in range(r.randrange(0, 3))}
           for i in range(25)}
    kind = {"P": "SAME_PERSON", "L": "SAME_LOCATION", "C": "SAME_CRIME_TYPE"}
    types = {"P": "INVOLVES_PERSON", "L": "OCCURRED_AT", "C": "CLASSIFIED_AS"}
    e = spark.createDataFrame([(a, x, types[x[0]]) for a, s in own.items() for x in s], "src string, dst string, rel_type string")
    v = spark.createDataFrame([], "id string, node_type string, vehicle_number string")
    expected = set()
    for x in {x for s in own.values() for x in s}:
        firs = sorted(a for a in own if x in own[a])
        expected |= {(b, a, x, kind[x[0]], round(len(own[a] & own[b]) / len(own[a] | own[b]), 4)) for a, b in zip(firs, firs[1:])}
    got = [tuple(x) for x in relations.related_by_entity(v, e).collect()]
    assert len(got) == len(expected) and set(got) == expected
    pairs = {}
    for b, a, _, k, score in expected:
        pairs.setdefault((b, a, score), set()).add(k)
    got = [tuple(x) for x in relations.related_reports(v, e).collect()]
    assert len(got) == len(pairs) and set(got) == {(b, a, ",".join(sorted(k)), score) for (b, a, score), k in pairs.items()}


def test_chain_of_a_missing_entity_has_no_entity(spark):
    rows = [("F1", "L0", "OCCURRED_AT"), ("F2", "L0", "OCCURRED_AT"), ("F1", None, "INVOLVES_PERSON"), ("F2", None, "INVOLVES_PERSON"), ("F2", "P", "INVOLVES_PERSON")]
    e = spark.createDataFrame(rows, "src string, dst string, rel_type string")
    v = spark.createDataFrame([], "id string, node_type string, vehicle_number string")
    got = sorted(map(str, (tuple(r) for r in relations.related_by_entity(v, e).collect())))
    assert got == ["('F2', 'F1', 'L0', 'SAME_LOCATION', 0.25)", "('F2', 'F1', None, 'SAME_PERSON', 0.25)"]


def test_graph_from_tables_edge_cases(spark):
    acc = spark.sql("""SELECT * FROM VALUES (1L, 'A/1', 'Over Speeding', 'Fatal'), (2L, 'A/1', 'Rash', 'Grievous'), (3L, '', 'Under Investigation', NULL)
        AS t(id, fir_number, cause, severity)""").withColumns(
        {"incident_date": F.lit(None).cast("timestamp_ntz"), "confidence_score": F.lit(None).cast("double")})
    loc = spark.sql("""SELECT * FROM VALUES (10L, 1L, 'addr', ' Benz ', 'City', 0.0D, 80.1D), (11L, 2L, NULL, 'BENZ', NULL, 16.5D, 80.6D), (12L, 3L, 'x', NULL, '', NULL, NULL),
        (13L, 3L, NULL, '', NULL, NULL, NULL) AS t(id, accident_id, address, area, city, latitude, longitude)""")
    vic = spark.createDataFrame([(1, 1, None, 20, "Male")], "id long, accident_id long, victim_name string, age int, gender string")
    veh = spark.createDataFrame([(5, 3, "Car", "AP1", "Unknown"), (6, 3, "Van", "AP2", "Ravi")],
                                "id long, accident_id long, vehicle_type string, vehicle_number string, driver_name string")
    v, e = build.graph_from_tables(acc, loc, vic, veh)
    rows = {r["id"]: r for r in v.collect()}
    assert rows["A/1"]["severity"] == "Grievous" and rows["FIR_3"]["severity"] == "Unknown"
    assert rows["LOC_10"]["lat"] is None and rows["LOC_10"]["area"] == " Benz "
    assert {"LOC_12", "LOC_13"} <= set(rows) and rows["LOC_13"]["area"] == "Unknown Area" and rows["LOC_13"]["city"] == "Vijayawada"
    assert "P_DRV_6" in rows and "P_DRV_5" not in rows and rows["P_1"]["name"] == "Person 1"
    pairs = sorted((r["src"], r["dst"]) for r in e.collect())
    assert pairs.count(("A/1", "LOC_10")) == 2 and ("A/1", "RASH") in pairs and ("A/1", "OVER_SPEEDING") in pairs
    assert not any(d.startswith("UNDER") for _, d in pairs)


def test_upsert_overwrites_and_keeps(spark):
    schema = ("id int, fir_number string, date_time string, cause string, severity string, location struct<address:string,area:string,city:string,lat:double,lng:double>,"
              "victims array<struct<name:string,age:int,gender:string,injury:string>>, vehicles array<struct<type:string,number:string,driver_name:string>>, confidence_score double")
    one = spark.createDataFrame([(1, "F1", "x", "drunk", "Fatal", ("a", "b", "c", 0.0, 1.0), [("n", 3, "Male", "i")], [], 0.5)], schema)
    two = spark.createDataFrame([(2, "F1", "y", "rash", "Grievous", ("a", "b", "c", 2.0, 1.0), [], [("Car", "AP", "d")], 0.9)], schema)
    v, e = build.graph_upsert(*build.graph_from_records(one, "id"), two, "id")
    firs = [r for r in v.collect() if r["node_type"] == "FIR"]
    assert len(firs) == 1 and firs[0]["severity"] == "Grievous"
    assert sorted(r["rel_type"] for r in e.collect()) == [
        "CLASSIFIED_AS", "CLASSIFIED_AS", "INJURED_IN", "INVOLVES_PERSON", "INVOLVES_VEHICLE", "OCCURRED_AT"]
    kept, edges = build.subgraph(v, e, persons=False)
    assert {r["rel_type"] for r in edges.collect()} == {"CLASSIFIED_AS", "INVOLVES_VEHICLE", "OCCURRED_AT"}


def test_near_groups_same_points(spark):
    v = spark.createDataFrame([("LOC_1", 16.5, 80.6), ("LOC_2", 16.5, 80.6), ("LOC_3", 16.51, 80.6), ("LOC_4", 17.5, 80.6)],
                              "id string, lat double, lng double").withColumn("node_type", F.lit("Location"))
    got = {(r["src"], r["dst"]): round(r["distance_km"], 2) for r in relations.near(v, 2.0).collect()}
    assert got == {("LOC_1", "LOC_2"): 0.0, ("LOC_1", "LOC_3"): 1.11}


def test_every_related_pair_follows_from_membership(spark, sample_graph):
    v, _ = sample_graph
    shared = [(1, "LOC_PNBS"), (2, "LOC_PNBS"), (3, "LOC_PNBS"), (2, "OVERSPEEDING"), (3, "OVERSPEEDING"), (5, "OVERSPEEDING")]
    e = spark.createDataFrame([(f"FIR/2024/00{n}", d, "R", None, 1.0) for n, d in shared + shared[:1]], "src string, dst string, rel_type string, role string, weight double")
    members = {(int(r["src"][-1]), r["entity"], r["relation_type"]) for r in relations.report_entities(v, e).collect()}
    assert members == {(n, d, "SAME_LOCATION" if d[:3] == "LOC" else "SAME_CRIME_TYPE") for n, d in shared}
    assert relations.report_entities(v, e).count() == len(shared)
    pairs = {(a, b, k) for a, d, k in members for b, other, _ in members if d == other and a < b}
    assert (1, 3, "SAME_LOCATION") in pairs and len(pairs) == 6  # the chain alone has no pair (1, 3)
    chain = {(int(r["dst"][-1]), int(r["src"][-1]), r["entity"]): r["similarity_score"] for r in relations.related_by_entity(v, e).collect()}
    assert chain == {(1, 2, "LOC_PNBS"): 0.5, (2, 3, "LOC_PNBS"): 1.0, (2, 3, "OVERSPEEDING"): 1.0, (3, 5, "OVERSPEEDING"): 0.5}
    both = {(r["dst"][-1], r["src"][-1]): r["relation_type"] for r in relations.related_reports(v, e).collect()}
    assert both == {("1", "2"): "SAME_LOCATION", ("2", "3"): "SAME_CRIME_TYPE,SAME_LOCATION", ("3", "5"): "SAME_CRIME_TYPE"}


def test_community_members_are_whole(spark):
    from crashgrid.plans.catalog import QUERIES
    from crashgrid.sources.star import Star

    rows = QUERIES["g_07_community_members"](spark, "/root/testdata/sf0.001").collect()
    vertices, edges = build.graph_from_tables(*(getattr(Star(spark, "/root/testdata/sf0.001"), n) for n in ("acc", "loc", "vic", "veh")))
    part = {r["id"]: r["community"] for r in rows}
    assert len(rows) == len(part) and set(part) == {r["id"] for r in vertices.select("id").collect()}
    kinds = {r["id"]: r["node_type"] for r in vertices.select("id", "node_type").collect()}
    sizes = {c: sum(kinds[i] == "FIR" for i in part if part[i] == c) for c in set(part.values())}
    parts = spark.createDataFrame(list(part.items()), "id string, community string")
    report = {r["community"]: (r["fir_count"], len(r["firs"] or [])) for r in communities.community_report(vertices, edges, parts).collect()}
    assert {c: n for c, (n, _) in report.items()} == sizes
    assert any(n > listed for n, listed in report.values())  # members that the report alone leaves out


def test_components_and_core_match_a_walk(spark):
    """Chains, loops, mutual edges, leaves of one and of several edges, sources without hubs, ids apart."""
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("d", "p1"), ("d", "p1"), ("d", "p2"), ("e", "h"), ("f", "h"), ("f", "k"), ("g", "k"),
             ("x", "x"), ("k", "m"), ("q", "d"), ("t", "u"), ("z", "0"), ("z", "g")]
    ids = sorted({i for p in pairs for i in p} | {"alone"})
    v = spark.createDataFrame([(i,) for i in ids], "id string")
    e = spark.createDataFrame([(a, b, "R", None, 1.0) for a, b in pairs], "src string, dst string, rel_type string, role string, weight double")
    name = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            name[a] = name[b] = min(name[a], name[b])
    got = components.components(v, e).collect()
    assert {(r.id, r.component) for r in got} == set(name.items()) and len(got) == len(ids)
    parts = components.core(e)
    assert {tuple(r) for r in parts.leaves.collect()} == {("c", "b", 1), ("p1", "d", 2), ("p2", "d", 1), ("m", "k", 1), ("u", "t", 1), ("0", "z", 1)}
    assert {tuple(r) for r in parts.links.collect()} == {
        ("a", "b", 1), ("b", "a", 1), ("e", "h", 1), ("f", "h", 1), ("f", "k", 1), ("g", "k", 1), ("q", "d", 1), ("z", "g", 1)}


def test_report_entities_read_vehicles_only_for_typed_edges(spark, sample_graph):
    """Typed edges tell the kind of their end, so vertices other than vehicles are not looked up."""
    v, e = sample_graph
    all_of_them = {tuple(r) for r in relations.report_entities(v, e).collect()}
    assert {tuple(r) for r in relations.report_entities(v.filter("node_type = 'Vehicle'"), e).collect()} == all_of_them and len(all_of_them) == 13


def test_paths_run_over_vertices_that_several_edges_touch(spark):
    """Persons and vehicles that hang on one report take no part, except as ends; a chain of sources stays."""
    rows = [("r1", "h"), ("r2", "h"), ("r1", "p1"), ("r2", "p2"), ("r2", "p2"), ("r2", "r3"), ("r3", "p3")]
    e = spark.createDataFrame(rows, "src string, dst string")
    v = spark.createDataFrame(sorted({(x,) for r in rows for x in r}), "id string")
    kept = {tuple(r) for r in paths.inner_links(e, "p1").collect()}
    assert {(a, b) for a, b in kept if a < b} == {("h", "r1"), ("h", "r2"), ("p1", "r1"), ("p2", "r2"), ("r2", "r3")}
    assert paths.shortest_path(v, e, "p1", "p3").path == ["p1", "r1", "h", "r2", "r3", "p3"]


def test_simple_paths_through_hubs_match_plain_search(spark):
    """Many dead beginnings sort first, so the search must widen."""
    rows = [("a", "h1"), ("z", "h2"), ("z", "h3")] + [(f"m{i:03d}", h) for i in range(150) for h in ("h1", "h2")] + [("n1", "h1"), ("n1", "h3"), ("n2", "h2"), ("n2", "h3")]
    e = spark.createDataFrame(rows, "src string, dst string")
    near = {}
    for x, y in rows:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    v = spark.createDataFrame([(x,) for x in near], "id string")

    def walk(path, most):
        if path[-1] == "z":
            yield len(path) - 1, path
        elif len(path) <= most:
            for x in near[path[-1]] - set(path):
                yield from walk([*path, x], most)

    for cap in (10, 200):
        got = [(r["length"], r["path"]) for r in paths.simple_paths(v, e, "a", "z", cap=cap).collect()]
        assert got == sorted(walk(["a"], 6))[:cap]


def test_plans_of_degree_and_rank_shuffle_each_side_once(spark, sample_graph):
    plan = centrality.degree(*sample_graph)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_pagerank_of_vertices_without_edges(spark):
    v = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    e = spark.createDataFrame([], "src string, dst string, weight double")
    assert sorted((r.id, round(r.score, 9)) for r in centrality.pagerank(v, e, copies=True).collect()) == [("a", 0.333333333), ("b", 0.333333333), ("b", 0.333333333)]
