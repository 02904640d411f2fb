"""Shortest and bounded simple paths between two vertices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from crashgrid.operators.graph.components import undirected
from crashgrid.session import cut, drop_cut


@dataclass
class PathResult:
    """Outcome of a path search: found flags, hop count and one shortest path."""

    status: str  # 'connected', 'disconnected' or 'not_found'
    length: int | None = None
    path: list[str] | None = None


def _start(links: DataFrame, node: str) -> DataFrame:
    return links.sparkSession.createDataFrame([(node,)], "id string")


def next_level(links: DataFrame, level: DataFrame, before: DataFrame | None) -> DataFrame:
    """Vertices (id) one hop beyond ``level``.

    A neighbour of a level lies in it, in the one before or in the next, so these two are all that
    has to be left out: the plan has the same size at every depth.
    """
    reached = links.join(level.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(level, "id", "left_anti")
    return cut(reached.join(before, "id", "left_anti") if before is not None else reached)


def inner_links(edges: DataFrame, *ends: str) -> DataFrame:
    """Neighbour pairs, without targets that one edge alone touches: no path leads through those, unless to ``ends``.

    Targets are counted by a hash; where hashes meet, more edges stay than need to.
    """
    e = edges.filter("src <> dst").select("src", "dst")
    touched = F.explode(F.array(F.struct(F.xxhash64("dst").alias("h"), F.lit(1).alias("k")), F.struct(F.xxhash64("src").alias("h"), F.lit(0).alias("k")))).alias("t")
    counted = e.select(touched).groupBy("t.h").agg(F.sum("t.k").alias("k"), F.count("*").alias("n"))
    kept = cut(counted.filter("k > 0 AND n > 1").select("h"))  # targets of several edges, or with edges of their own
    inner = e.withColumn("h", F.xxhash64("dst")).join(kept, "h", "left_semi").select("src", "dst")
    return cut(undirected(inner.unionByName(e.filter(F.col("dst").isin(*ends)))))


def shortest_path(vertices: DataFrame, edges: DataFrame, a: str, b: str, links: DataFrame | None = None) -> PathResult:
    """The shortest path of ``a`` and ``b`` that is the smallest by node ids.

    Both ends are searched at once: the smaller of the two outer levels grows, until they meet.  Of the
    levels of ``a`` those vertices are kept that lead to a meeting point, and the path is read off,
    one row a hop.
    """
    present = {r[0] for r in vertices.filter(F.col("id").isin(a, b)).select("id").distinct().collect()}
    if not {a, b} <= present:
        return PathResult("not_found")
    if a == b:
        return PathResult("connected", 0, [a])
    links = links if links is not None else inner_links(edges, a, b)
    sides, sizes = ([_start(links, a)], [_start(links, b)]), [1, 1]
    while True:
        k = 0 if sizes[0] <= sizes[1] else 1
        grown = sides[k]
        grown.append(next_level(links, grown[-1], grown[-2] if len(grown) > 1 else None))
        sizes[k] = grown[-1].count()
        if not sizes[k]:
            drop_cut(*sides[0], *sides[1])
            return PathResult("disconnected")
        meeting = cut(sides[0][-1].join(sides[1][-1], "id", "left_semi"))
        if not meeting.isEmpty():
            break
        drop_cut(meeting)
    leading = [meeting]  # of a's levels, the outer one first: what lies on a shortest path
    for level in reversed(sides[0][1:-1]):
        near = links.join(leading[-1].select(F.col("id").alias("b")), "b").select(F.col("a").alias("id"))
        leading.append(cut(level.join(near, "id", "left_semi")))
    ahead = leading[::-1] if len(sides[0]) > 1 else []
    path = [a]
    for level in [*ahead, *reversed(sides[1][:-1])]:
        step = links.filter(F.col("a") == path[-1]).select(F.col("b").alias("id")).join(level, "id", "left_semi")
        path.append(step.agg(F.min("id")).first()[0])
    drop_cut(*sides[0], *sides[1], *leading)
    return PathResult("connected", len(path) - 1, path)


def simple_paths(vertices: DataFrame, edges: DataFrame, a: str, b: str, slack: int = 2, cap: int = 10):
    """First ``cap`` simple paths of at most shortest + slack hops, by length then by node ids.

    The beginnings of the paths of one length grow hop by hop from ``a``, over vertices from which a walk of
    just the remaining hops leads to ``b``.  Of all beginnings only the smallest are kept, as paths are ordered
    by their beginnings; what is larger than one that was left out is not known to be complete, so the search
    repeats with more of them until the paths found lie below all of those.  At most ``cap`` paths of a
    length reach the driver.
    """
    links = inner_links(edges, a, b)
    found = shortest_path(vertices, edges, a, b, links)
    spark = vertices.sparkSession
    schema = "length long, path array<string>"
    if found.status != "connected":
        return spark.createDataFrame([], schema)
    if a == b:
        return spark.createDataFrame([(0, [a])], schema)
    limit = found.length + slack
    walks = [_start(links, b)]  # walks[r]: from where r hops lead to b, with neither end on the way
    for _ in range(limit - 1):
        before = links.join(walks[-1].select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        walks.append(cut(before.filter(~F.col("id").isin(a, b))))
    done: list[tuple[int, list[str]]] = []
    for length in range(found.length, limit + 1):
        wanted, width = cap - len(done), 8 * cap
        if not wanted:
            break
        while True:
            paths, bounds = _smallest(links, walks, a, length, width, wanted)
            if not bounds or len(paths) == wanted and all(paths[-1][: len(p)] < p for p in bounds):
                break
            width *= 16
        done += [(length, p) for p in paths]
    drop_cut(links, *walks)
    return spark.createDataFrame(done, schema)


def _smallest(links: DataFrame, walks: list[DataFrame], start: str, length: int, width: int, wanted: int):
    """The smallest paths of ``length`` hops whose beginnings are kept, and per hop the smallest beginning left out.

    All beginnings that end in one vertex continue to the same neighbours, and each needs only as many of the
    smallest as are kept, besides those on its own way; Spark ranks them before it shuffles.
    """
    front, bounds = links.sparkSession.createDataFrame([(start, [start])], "a string, path array<string>"), []
    ranked = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    for hop in range(1, length + 1):
        onward = links.join(F.broadcast(front.select("a").distinct()), "a").join(walks[length - hop].select(F.col("id").alias("b")), "b", "left_semi")
        onward = onward.withColumn("place", ranked).filter(F.col("place") <= width + 1 + hop).select("a", "b")
        grown = onward.join(F.broadcast(front), "a").filter(~F.expr("array_contains(path, b)"))
        grown = grown.select(F.col("b").alias("a"), F.concat("path", F.array("b")).alias("path")).orderBy("path").limit(width + 1)
        after = cut(grown)
        drop_cut(front)
        if after.count() > width:
            bounds.append(after.agg(F.max("path")).first()[0])
            front = after.filter(F.col("path") < F.array(*[F.lit(x) for x in bounds[-1]]))
            front._scratch = after._scratch
        else:
            front = after
    paths = [r["path"] for r in front.orderBy("path").limit(wanted).collect()]
    drop_cut(front)
    return paths, bounds


def enrich_path(paths: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row per path position with the node's type and attributes."""
    from crashgrid.operators.graph.build import with_attrs

    keys = [c for c in paths.columns if c != "path"]
    nodes = paths.select(*keys, F.posexplode("path").alias("position", "node"))
    return with_attrs(nodes, vertices)


def connection_report(vertices: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Status, length and shortest path of two nodes as one row."""
    r = shortest_path(vertices, edges, a, b)
    row = (a, b, r.status, r.length, r.path)
    return vertices.sparkSession.createDataFrame(
        [row], "node_a string, node_b string, status string, length long, path array<string>")
