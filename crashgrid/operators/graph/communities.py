"""Greedy modularity communities by parallel star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crashgrid.operators.graph.components import core, modularity
from crashgrid.session import cut, drop_cut

# nested shares of a star's candidates that are tried when taking all of them would lose modularity
SHARES = [1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125]


def communities(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community): agglomerate while some merge raises modularity.

    Each round every community points at the neighbour with the best gain.  A community
    that more others point at is a centre; the rest attach to their centre.  The gain of
    a whole star is an algebraic sum, so it is checked before the merge: the largest
    share of the candidates with a positive gain joins, or else the single best one.
    Modularity therefore never falls, and the loop ends where no pair can be merged with
    a gain, the stopping rule of greedy agglomeration.  Each round shrinks the frames it
    works on.

    Vertices that hang on one source (``core``) join it before the first round: with weights W of all of
    them and D >= W of the source, both at most m, that gains at least W / m - (2 D W + W W) / (4 m m) > 0.
    """
    return cut(_placed(vertices.select("id").distinct(), _resolved(edges)).select("id", "community"))


def _placed(vertices: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """Add ``community`` to vertex rows: where the vertex went, or its own id."""
    if resolved is None:
        return vertices.withColumn("community", F.col("id"))
    joined = vertices.join(resolved.withColumnRenamed("c", "id"), "id", "left")
    return joined.withColumn("community", F.coalesce("t", "id")).drop("t")


def _resolved(edges: DataFrame) -> DataFrame | None:
    """(c, t): the community t of every vertex c that joined another one, none where there are no edges."""
    parts = core(edges)
    e = parts.links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w")
    links = cut(e.groupBy("a", "b").agg(F.sum("w").cast("double").alias("w")))
    hung = parts.leaves.groupBy(F.col("at").alias("c")).agg(F.sum("w").cast("double").alias("w"))
    m = links.select("w").unionByName(hung.select("w")).agg(F.sum("w")).first()[0]
    if not m:
        return None
    ends = links.select(F.col("a").alias("c"), "w").unionByName(links.select(F.col("b").alias("c"), "w"))
    ends = ends.unionByName(hung.select("c", (2 * F.col("w")).alias("w")))
    mass = cut(ends.groupBy("c").agg((F.sum("w") / (2 * m)).alias("mass")))
    moves = [parts.leaves.select(F.col("id").alias("c"), F.col("at").alias("t"))]
    drop_cut(parts.hubs, parts.sources, parts.links)
    while not (move := _round(links, mass, m)).isEmpty():
        moves.append(move)
        links, mass = _contract(links, mass, move)
    # resolve from the last move backwards: the small late maps are joined first
    resolved = None
    for move in reversed(moves):
        if resolved is None:
            resolved = move
        else:
            later = resolved.select(F.col("c").alias("t"), F.col("t").alias("_final"))
            here = move.join(later, "t", "left").select("c", F.coalesce("_final", "t").alias("t"))
            resolved = here.unionByName(resolved)
    return resolved


def _round(links: DataFrame, mass: DataFrame, m: float) -> DataFrame:
    """Merges (c -> t) of one round."""
    left = mass.select(F.col("c").alias("a"), F.col("mass").alias("ma"))
    right = mass.select(F.col("c").alias("b"), F.col("mass").alias("mb"))
    gains = links.join(left, "a").join(right, "b").withColumn("gain", F.col("w") / m - 2 * F.col("ma") * F.col("mb"))
    gains = gains.filter("gain > 1e-12")
    both = gains.select(F.col("a").alias("c"), F.col("b").alias("t"), "w", F.col("ma").alias("mc"), F.col("mb").alias("mt"), "gain").unionByName(
        gains.select(F.col("b").alias("c"), F.col("a").alias("t"), "w", F.col("mb").alias("mc"), F.col("ma").alias("mt"), "gain"))
    best = cut(both.groupBy("c").agg(
        F.max_by(F.struct("t", "w", "mc", "mt", "gain"), F.struct("gain", "t")).alias("r")).select("c", "r.*"))
    pull = best.groupBy(F.col("t").alias("c")).agg(F.count("*").alias("pull"))
    rank = cut(best.select("c", "t").join(pull, "c", "left").select("c", "t", F.coalesce("pull", F.lit(0)).alias("pull")))
    target = rank.select(F.col("c").alias("t"), F.col("pull").alias("tpull"), F.col("t").alias("tt"))
    second = rank.select(F.col("c").alias("tt"), F.col("pull").alias("ttpull"))
    view = best.join(rank.select("c", "pull"), "c").join(target, "t").join(second, "tt")
    higher = lambda p, i, q, j: (F.col(p) > F.col(q)) | ((F.col(p) == F.col(q)) & (F.col(i) > F.col(j)))
    # t is a centre when the community it points at ranks below it; c attaches when it ranks below t
    joins = cut(view.filter(higher("tpull", "t", "ttpull", "tt") & higher("tpull", "t", "pull", "c"))
                .select("c", "t", "w", "mc", "mt", "gain"))
    bucket = F.pmod(F.xxhash64("c", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    aggs = []
    for i, share in enumerate(SHARES):
        inside = bucket < share
        s = F.sum(F.when(inside, F.col("mc")))
        q = F.sum(F.when(inside, F.col("mc") * F.col("mc")))
        g = F.sum(F.when(inside, F.col("w"))) / m - ((F.first("mt") + s) * (F.first("mt") + s) - F.first("mt") * F.first("mt") - q)
        aggs.append(g.alias(f"g{i}"))
    stars = joins.groupBy("t").agg(*aggs, F.max_by("c", F.struct("gain", "c")).alias("top"))
    share = F.lit(0.0)
    for i in reversed(range(len(SHARES))):
        share = F.when(F.col(f"g{i}") > 1e-12, F.lit(SHARES[i])).otherwise(share)
    stars = stars.select("t", "top", share.alias("share"))
    return cut(joins.join(stars, "t").filter((bucket < F.col("share")) | (F.col("c") == F.col("top")) & (F.col("share") == 0)).select("c", "t"))


def _contract(links: DataFrame, mass: DataFrame, move: DataFrame):
    ma = move.select(F.col("c").alias("a"), F.col("t").alias("ta"))
    mb = move.select(F.col("c").alias("b"), F.col("t").alias("tb"))
    moved = links.join(ma, "a", "left").join(mb, "b", "left").select(
        F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), "w").filter("x <> y")
    new = moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))
    weight = mass.join(move, "c", "left").groupBy(F.coalesce("t", "c").alias("c")).agg(F.sum("mass").alias("mass"))
    return cut(new), cut(weight)


def community_report(vertices: DataFrame, edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """One row per community, most reports first, with at most 20 reports and 10 locations listed.

    The lists are cut by rank before they are collected, so a large community never
    gathers its members in one place.
    """
    rows = vertices.filter("id IS NOT NULL").select("id", "node_type", "severity", "cause", "area", "city")
    # vertices meet their communities and are stored once, of persons and vehicles only what is counted
    placed = _placed(rows, _resolved(edges)) if parts is None else rows.join(parts, "id")
    listed = {"FIR": ("id", "severity", "cause"), "Location": ("id", "area", "city")}
    kept = [F.when(F.col("node_type").isin([k for k, own in listed.items() if c in own]), F.col(c)).alias(c) for c in ("id", "severity", "cause", "area", "city")]
    attrs = cut(placed.select("community", "node_type", *kept))
    sizes = attrs.groupBy("community", "node_type").agg(F.count("*").alias("n"))
    summary = sizes.groupBy("community").agg(
        F.sum("n").alias("size"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("node_type", "n")))).alias("node_type_breakdown"),
        F.coalesce(F.sum(F.when(F.col("node_type") == "FIR", F.col("n"))), F.lit(0)).alias("fir_count"))
    return (
        summary.join(capped_list(attrs.filter("node_type = 'FIR'"), "community", 20, "firs", "id", "severity", "cause"), "community", "left")
        .join(capped_list(attrs.filter("node_type = 'Location'"), "community", 10, "key_locations", "id", "area", "city"), "community", "left")
        .orderBy(F.desc("fir_count"), "community")
    )


def capped_list(df: DataFrame, key: str, n: int, name: str, *columns: str) -> DataFrame:
    """First n rows per key (by the first column) as an array."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(columns[0])
    kept = df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def community_totals(edges: DataFrame, parts: DataFrame) -> DataFrame:
    n = parts.agg(F.count_distinct("community").alias("num_communities"))
    return n.crossJoin(modularity(edges, parts).select(F.round("modularity", 4).alias("modularity_score")))  # single rows
