"""Betweenness from sampled shortest paths with a stated error."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from crashgrid.operators.graph.centrality import _merge_twins, folded
from crashgrid.session import cut, drop_cut
from crashgrid.sources.maintenance import number_rows

# Rounds double the sample, so there are never more.
ROUNDS = 64


def sample_sizes(classes: int, ratio: float, epsilon: float, delta: float) -> tuple[list[int], float]:
    """(numbers of pairs after each round, logarithm in the Bernstein bound).

    The first size is the least at which a score without variance may stop.  At the last one Hoeffding's
    bound holds for whatever variance, so the rounds end there in any case.  Half of ``delta`` goes to
    that, the other half is shared by all rounds and classes.
    """
    log, error = math.log(6 * ROUNDS * classes / delta), epsilon / ratio
    most = math.ceil(math.log(4 * classes / delta) / (2 * error * error))
    sizes = [min(most, math.ceil(4 * log / error))]
    while sizes[-1] < most:
        sizes.append(min(most, 2 * sizes[-1]))
    return sizes, log


def error_bound(variance: float, size: int, log: float) -> float:
    """Empirical Bernstein bound of a mean of ``size`` values between 0 and 1."""
    return math.sqrt(2 * variance * log / size) + 3 * log / size


def _draw(line: DataFrame, first: int, until: int, n: int, seed: int) -> DataFrame:
    """(i, s, t): the classes of two different core vertices for the pairs numbered first to until - 1.

    A pair is two different places among all n vertices.  A core vertex holds as many places as vertices
    folded into it; pairs with an end elsewhere, or both in one core vertex, pass no other core vertex
    and are left out.  Places are looked up by slots of the line of weights, some four a pair.
    """
    spark = line.sparkSession
    width = max(1, n // (4 * (until - first)))

    def place(end: int, among: int):
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(end)), F.lit(among))

    drawn = spark.range(first, until).select(F.col("id").alias("i"), place(0, n).alias("p"), place(1, n - 1).alias("q"))
    drawn = drawn.withColumn("q", F.col("q") + (F.col("q") >= F.col("p")).cast("long"))
    places = drawn.select("i", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(c).alias("p")) for e, c in (("s", "p"), ("t", "q"))])).alias("x"))
    places = places.select("i", "x.*").withColumn("slot", F.floor(F.col("p") / width))
    slots = F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.col("w") - 1) / width))
    held = line.withColumn("slot", F.explode(slots))
    hit = cut(places.join(held, "slot").filter("p >= at AND p < at + w").select("i", "end", "id", "c"))
    s, t = (hit.filter(F.col("end") == e).select("i", F.col("id").alias(f"{e}_id"), F.col("c").alias(e)) for e in "st")
    pairs = cut(s.join(t, "i").filter("s_id <> t_id").select("i", "s", "t"))
    drop_cut(hit)
    return pairs


def _path_shares(pairs: DataFrame, classes: DataFrame, qlinks: DataFrame) -> DataFrame:
    """(c, x, xx): sums over the pairs of the share of shortest paths through one member of class c, and of its square.

    Levels grow from s until t is among them; only the two last ones are needed to tell what is new.
    Shares flow back from t, level by level, over rows on shortest paths only.
    """
    mult = classes.select(F.col("c").alias("v"), "m")
    # two members of one class meet in every neighbour alike
    around = qlinks.join(mult.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.sum("m").alias("d"))
    alike = pairs.filter("s = t").join(around, F.col("s") == F.col("v")).select("v", "d").join(qlinks, "v")
    shares = [cut(alike.select(F.col("u").alias("c"), (1 / F.col("d")).alias("x")))]
    apart = cut(pairs.filter("s <> t"))
    level = cut(apart.select("i", F.col("s").alias("v"), F.lit(1.0).alias("paths"), F.lit(1.0).alias("m")))
    levels, ends, active = [level], [None], level
    while True:
        reached = active.join(qlinks, "v").groupBy("i", F.col("u").alias("v")).agg(F.sum(F.col("paths") * F.col("m")).alias("paths"))
        for known in levels[-2:]:
            reached = reached.join(known.select("i", "v"), ["i", "v"], "left_anti")
        fresh = cut(reached.join(mult, "v").select("i", "v", "paths", "m"))
        if fresh.isEmpty():
            break
        end = cut(fresh.join(apart.select("i", F.col("t").alias("v")), ["i", "v"]).select("i", "v", "paths"))
        levels.append(fresh)
        ends.append(end)
        active = fresh.join(end.select("i"), "i", "left_anti")
    owed = None
    for dist in range(len(levels) - 1, 1, -1):
        at_end = ends[dist].select("i", "v", (1 / F.col("paths")).alias("share"))
        owed = at_end if owed is None else owed.unionByName(at_end)
        back = owed.join(qlinks, "v").groupBy("i", F.col("u").alias("v")).agg(F.sum("share").alias("share"))
        on = cut(back.join(levels[dist - 1], ["i", "v"]).select("i", "v", "paths", "m", "share"))
        shares.append(on.select(F.col("v").alias("c"), (F.col("share") * F.col("paths")).alias("x")))
        shares[-1]._scratch = on._scratch
        owed = on.select("i", "v", (F.col("share") * F.col("m")).alias("share"))
    every = shares[0]
    for part in shares[1:]:
        every = every.unionByName(part)
    summed = cut(every.groupBy("c").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx")))
    drop_cut(apart, *shares, *levels, *[e for e in ends if e is not None], fresh)
    return summed


def sampled_betweenness(
    vertices: DataFrame, edges: DataFrame, epsilon: float = 0.01, delta: float = 0.1, seed: int = 0, used: list[int] | None = None,
) -> DataFrame:
    """Normalised betweenness (id, score) of the undirected simple graph, each score within ``epsilon``.

    With probability 1 - ``delta`` that holds for all vertices at once.  Vertices of degree 1 are folded,
    whose share is exact, and vertices with equal neighbours are one class; pairs of vertices are then
    sampled, and for each the share of its shortest paths through every class is counted exactly.  The
    sample doubles until an empirical Bernstein bound on the largest variance is small enough.  Rows are
    the sampled pairs times what lies no farther from s than t, whatever the number of other pairs.

    The same ``seed`` gives the same pairs for the same graph.  ``used`` collects the size of the sample of
    each round.  Fewer than three vertices score 0; an empty graph gives no rows.
    """
    ids = vertices.select("id").distinct()
    n = ids.count()
    if n < 3:
        return ids.withColumn("score", F.lit(0.0))
    core_links, nodes = folded(edges)
    tree = (F.col("w") - 1) * (F.col("w") - 1) - F.col("sq") + 2 * (F.col("w") - 1) * (F.col("total") - F.col("w"))
    known = nodes.select("id", (tree / ((n - 1.0) * (n - 2.0))).alias("_tree"))
    trees = ids.join(known, "id", "left").select("id", F.coalesce("_tree", F.lit(0.0)).alias("tree"))
    classes, qlinks, members = _merge_twins(core_links, nodes)
    classes = cut(classes)
    count = classes.count()
    if not count:
        return trees.select("id", F.col("tree").alias("score"))
    weighed = members.join(nodes.select("id", F.col("w").cast("long").alias("w")), "id")
    line = cut(number_rows(weighed, "id", w=F.col("w")).select("id", "c", "w", F.col("_at_w").alias("at")))
    ratio, done, totals = n / (n - 2.0), 0, None
    plan, log = sample_sizes(count, ratio, epsilon, delta)
    for size in plan:
        pairs = _draw(line, done, size, n, seed)
        new = _path_shares(pairs, classes, qlinks)
        if totals is not None:
            both = cut(totals.unionByName(new).groupBy("c").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx")))
            drop_cut(totals, new)
            new = both
        drop_cut(pairs)
        totals, done = new, size
        if used is not None:
            used.append(size)
        mean = F.col("x") / size
        variance = totals.agg(F.max(F.col("xx") / size - mean * mean)).first()[0] or 0.0
        if error_bound(max(variance, 0.0), size, log) * ratio <= epsilon:
            break
    drop_cut(line)
    core = members.join(totals, "c").select("id", (F.col("x") * (ratio / done)).alias("core"))
    return trees.join(core, "id", "left").select("id", (F.col("tree") + F.coalesce("core", F.lit(0.0))).alias("score"))
