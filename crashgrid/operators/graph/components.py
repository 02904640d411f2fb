"""Undirected views, connected components and structure summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from crashgrid.session import cut, drop_cut


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbour pairs (a, b) in both directions, without self-loops."""
    e = edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


@dataclass
class Core:
    """A graph without the vertices that hang on one other vertex; self-loops are left out."""

    leaves: DataFrame  # (id, at, w): no edges of their own, w edges and all from ``at``
    ends: DataFrame  # the table that the leaves are read from
    hubs: DataFrame  # (id): other vertices that edges lead to
    sources: DataFrame  # (id): vertices that edges leave
    links: DataFrame  # (src, dst, w): the edges from sources to hubs, counted

    def drop(self) -> None:
        drop_cut(self.ends, self.hubs, self.sources, self.links)


def core(edges: DataFrame) -> Core:
    """Set the leaves aside, so that later steps run on the links between sources and hubs only.

    In an incident graph persons and vehicles are leaves and locations and causes are hubs, so the links
    are two a report and the hubs are few enough to be broadcast.  Each edge is shuffled twice, once
    by either end.
    """
    e = edges.filter("src <> dst").select("src", "dst")
    sources = cut(e.select(F.col("src").alias("id")).distinct())
    ends = e.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("at"), F.max("src").alias("_other"), F.count("*").alias("w"))
    leaf = F.col("_own").isNull() & (F.col("at") == F.col("_other"))
    ends = cut(ends.join(sources.withColumn("_own", F.lit(True)), "id", "left").select("id", F.when(leaf, F.col("at")).alias("at"), "w"))
    leaves, hubs = ends.filter("at IS NOT NULL"), cut(ends.filter("at IS NULL").select("id"))
    links = cut(e.join(hubs.withColumnRenamed("id", "dst"), "dst").groupBy("src", "dst").agg(F.count("*").alias("w")))
    return Core(leaves, ends, hubs, sources, links)


def core_components(parts: Core) -> DataFrame:
    """(id, component) of the sources and hubs, named by some vertex of theirs.

    A source connects all its hubs and belongs to the smallest of them, so sources are contracted
    before the components of the hubs are searched.
    """
    first = cut(parts.links.groupBy("src").agg(F.min("dst").alias("m")))
    pairs = parts.links.join(first, "src").filter("dst <> m").select(F.col("m").alias("a"), F.col("dst").alias("b")).distinct()
    # a source that is a hub as well meets its own hubs
    both = first.join(parts.hubs.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("a"), F.col("m").alias("b"))
    known = cut(linked_components(pairs.unionByName(both)))
    hubs = parts.hubs.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    others = parts.sources.join(parts.hubs, "id", "left_anti").join(first.withColumnRenamed("src", "id"), "id", "left")
    others = others.join(known.withColumnRenamed("id", "m"), "m", "left").select("id", F.coalesce("component", "m", "id").alias("component"))
    found = cut(hubs.unionByName(others))
    drop_cut(first, known)
    return found


def components(vertices: DataFrame, edges: DataFrame, copies: bool = False) -> DataFrame:
    """(id, component): the smallest vertex id of each connected component.

    Vertex rows that share an id give one row, with ``copies`` as many as they are.
    """
    parts = core(edges)
    inner = core_components(parts)
    hung = parts.leaves.select(F.col("id").alias("_leaf"), F.col("at").alias("id")).join(inner, "id")
    known = cut(inner.unionByName(hung.select(F.col("_leaf").alias("id"), "component")))
    parts.drop()
    drop_cut(inner)
    names = cut(known.groupBy("component").agg(F.min("id").alias("_name")))
    known = known.join(names, "component").select("id", F.col("_name").alias("component"))
    ids = vertices.select("id")
    joined = (ids if copies else ids.distinct()).join(known, "id", "left")
    return cut(joined.select("id", F.coalesce("component", "id").alias("component")))


def linked_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b): the smallest id that it is connected with.

    Alternating stars: each round every larger end moves to the smallest neighbour of its smaller
    end, then all smaller ends of an id move to the smallest of them, until only stars are left.
    The links shrink from round to round, and the smallest neighbours are stored before they are
    joined, so that both sides of the join are plain shuffles, which adaptive execution splits at
    hot ids.  The tables of a round are deleted once the next one stands.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    stars = cut(pairs.distinct())
    while True:
        ends = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        moved = cut(ends.groupBy("u").agg(F.min("v").alias("m")).filter("m < u").select(F.col("u").alias("lo"), "m"))
        large = cut(stars.join(moved, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct())
        low = cut(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")))
        # ids with one smaller end keep it; the others' ends are joined to their smallest
        several = low.filter("n > 1").select("hi", "m")
        joined = large.join(several, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = cut(low.select("hi", F.col("m").alias("lo")).unionByName(joined).distinct())
        settled = joined.isEmpty() and after.join(after.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty()
        drop_cut(stars, moved, large, low)
        stars = after
        if settled:
            heads = stars.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
            return stars.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(heads)


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Modularity of a partition (id, community) of the undirected multigraph without loops."""
    e = edges.filter("src <> dst").select("src", "dst")
    a = parts.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = parts.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    pairs = e.join(a, "src").join(b, "dst").groupBy("ca", "cb").agg(F.count("*").alias("n"))
    ends = pairs.select(F.col("ca").alias("c"), "n", F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0).alias("inner")).unionByName(
        pairs.select(F.col("cb").alias("c"), "n", F.lit(0).cast("long").alias("inner")))
    per = ends.groupBy("c").agg(F.sum("n").alias("d"), F.sum("inner").alias("l"))
    m = F.broadcast(pairs.agg(F.sum("n").alias("m")))
    return per.join(m).agg(
        F.coalesce(F.sum(F.col("l") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("modularity"))


def graph_summary(vertices: DataFrame, edges: DataFrame, with_components: bool = True) -> DataFrame:
    """Totals, type counts, degree statistics, density and connectivity in one row."""
    n = vertices.agg(F.count("*").alias("total_nodes"))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    top = ends.groupBy("id").agg(F.count("*").alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("max_node_degree"))
    kinds = vertices.groupBy("node_type").agg(F.count("*").alias("c")).agg(
        F.map_from_entries(F.collect_list(F.struct("node_type", "c"))).alias("node_type_counts"))
    rels = edges.groupBy("rel_type").agg(F.count("*").alias("c")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("total_edges"),
        F.map_from_entries(F.collect_list(F.struct("rel_type", "c"))).alias("relationship_type_counts"))
    row = n.crossJoin(rels).crossJoin(kinds).crossJoin(top)  # single rows
    size, count = F.col("total_nodes"), F.col("total_edges")
    row = row.withColumns({
        "avg_node_degree": F.round(2 * count / size, 2),
        "density": F.when(size > 1, F.round(count / (size * (size - 1)), 6)).otherwise(0.0),
    })
    if with_components:
        parts = components(vertices, edges, copies=True).agg(F.count_distinct("component").alias("num_connected_components"))
        row = row.crossJoin(parts).withColumn("is_connected", F.col("num_connected_components") == 1)
    return row
