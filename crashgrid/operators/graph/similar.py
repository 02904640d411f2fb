"""Similar reports: a prefix-filtered join of their entity sets, with every pair above a threshold.

Reports of equal sets form one class, joined once through its smallest report.  A set's entities are put in
order of frequency, rarest first.  Two sets with a Jaccard similarity of at least t share an entity among
the first n - ceil(t n) + 1 of each, so only those are posted.  A posting looks for sets of sizes that can
reach t from its place on; frequent entities come last, so they are posted by few sets and look for few
sizes.  The entity that two sets have first in common makes the pair, once.

Entities of one class alone are counted, not stored: they fill the first places and meet nothing.  Classes with
the same other entities and as many of their own form one kind, so kinds are compared, and a pair of kinds
stands for all pairs of their classes, which are written out from blocks of ids at the end.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from crashgrid.operators.graph.relations import report_entities
from crashgrid.session import cut

# Ids that a block of one kind holds, about: two blocks give the square of it in pairs.
BLOCK = 256


def report_classes(links: DataFrame) -> DataFrame:
    """(id, class, n_entities): the smallest report with the same entities, for (src, entity) rows without repeats."""
    marks = [F.bit_xor(F.xxhash64("entity", F.lit(k))) for k in range(2)]
    sets = links.groupBy("src").agg(F.count("*").alias("n_entities"), F.struct(*marks).alias("mark"))
    heads = sets.groupBy("n_entities", "mark").agg(F.min("src").alias("class"))
    return sets.join(heads, ["n_entities", "mark"]).select(F.col("src").alias("id"), "class", "n_entities")


def _least_common(n: Column, m: Column, t: Fraction) -> Column:
    """How many entities sets of n and m must share: ceil(t (n + m) / (1 + t))."""
    return F.ceil(((n + m) * t.numerator) / F.lit(t.numerator + t.denominator) - F.lit(1e-9))


def similar_sets(sets: DataFrame, t: Fraction) -> DataFrame:
    """(src, dst, common, n, m) of all sets (src, own) whose similarity is t or more, src > dst.

    ``own`` holds distinct entities, rarest first in one order for all sets.  With a column ``lone`` a set has
    as many entities more that no other set has; they come first.
    """
    lone = F.col("lone") if "lone" in sets.columns else F.lit(0)
    own = sets.select("src", "own", lone.cast("int").alias("lone"), (lone + F.size("own")).cast("int").alias("n"))
    first = F.col("n") - F.ceil(F.col("n") * t.numerator / F.lit(t.denominator) - F.lit(1e-9)).cast("int") + 1 - F.col("lone")
    posted = own.select("src", "own", "n", "lone", F.posexplode(F.slice("own", F.lit(1), F.greatest(first, F.lit(0)))).alias("place", "entity"))
    posted = posted.withColumn("place", F.col("place") + F.col("lone")).drop("lone")
    # the larger set (by size, then id) looks for the smaller one
    sizes = F.sequence(F.ceil(F.col("n") * t.numerator / F.lit(t.denominator) - F.lit(1e-9)).cast("int"), F.col("n"))
    probe = posted.select("src", "own", "n", "place", "entity", F.explode(sizes).alias("m"))
    probe = probe.filter(F.col("n") - F.col("place") >= _least_common(F.col("n"), F.col("m"), t))
    other = posted.select(F.col("src").alias("dst"), F.col("own").alias("theirs"), F.col("n").alias("m"), F.col("place").alias("there"), "entity")
    need = _least_common(F.col("n"), F.col("m"), t)
    met = probe.join(other, ["entity", "m"]).filter(
        ((F.col("n") > F.col("m")) | (F.col("src") > F.col("dst"))) & (F.col("src") != F.col("dst")) & (F.col("m") - F.col("there") >= need))
    shared = met.select("src", "dst", "n", "m", "entity", F.array_intersect("own", "theirs").alias("common"))
    shared = shared.filter((F.size("common") >= need) & (F.get("common", F.lit(0)) == F.col("entity")))
    return shared.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"), "common", "n", "m")


def report_sets(links: DataFrame, t: Fraction) -> DataFrame:
    """(src, own, lone, n) of the classes that may be similar to another: ``own`` entities of several classes, rarest
    first, and ``lone`` others.

    A class that holds too few of the former for a similarity of t is left out.
    """
    copies = cut(report_classes(links).filter("id <> class").select(F.col("id").alias("src")))
    own = links.filter("src IS NOT NULL AND entity IS NOT NULL").join(copies, "src", "left_anti")
    several = cut(own.groupBy("entity").agg(F.count("*").alias("often")).filter("often > 1"))
    entry = F.struct("often", "entity", "relation_type")
    sets = own.join(several, "entity", "left").groupBy("src").agg(
        F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.when(F.col("often").isNotNull(), entry))).alias("own"))
    enough = F.size("own") >= F.ceil(F.col("n") * t.numerator / F.lit(t.denominator) - F.lit(1e-9))
    return sets.filter(enough).select("src", "own", (F.col("n") - F.size("own")).alias("lone"), "n")


def _blocks(members: DataFrame) -> DataFrame:
    """(kind, block, ids): the ids of each kind in blocks of about BLOCK, so that no kind is gathered whole."""
    sizes = members.groupBy("kind").agg((F.floor(F.count("*") / BLOCK) + 1).alias("_blocks"))
    dealt = members.join(sizes, "kind").withColumn("block", F.pmod(F.xxhash64("src"), F.col("_blocks")))
    return dealt.groupBy("kind", "block").agg(F.collect_list("src").alias("ids"))


def similar_reports(vertices: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(src, dst, relation_type, similarity_score) of all pairs of classes with a similarity of ``threshold`` or more.

    A class stands for its reports (``report_classes``), so reports of one class have similarity 1 and any
    two others that of their classes.  Nothing above the threshold is left out.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    t = Fraction(threshold).limit_denominator(10_000)
    sets = cut(report_sets(cut(report_entities(vertices, edges, by_report=True)), t))
    marks = F.struct(*[F.xxhash64("own", F.lit(k)) for k in range(2)]).alias("mark")
    marked = sets.select("src", "n", F.size("own").alias("k"), marks)
    kinds = cut(marked.groupBy("n", "k", "mark").agg(F.min("src").alias("kind"), F.count("*").alias("classes")))
    members = marked.join(kinds.filter("classes > 1"), ["n", "k", "mark"]).select("src", "kind")
    rest = kinds.filter("classes = 1").select(F.col("kind").alias("src"), "kind")
    blocks = cut(_blocks(members).unionByName(rest.select("kind", F.lit(0).cast("long").alias("block"), F.array("src").alias("ids"))))
    heads = cut(sets.join(kinds.select(F.col("kind").alias("src"), "classes"), "src"))
    # classes of one kind have all but their lone entities in common
    same = heads.filter((F.col("classes") > 1) & (F.size("own") >= _least_common(F.col("n"), F.col("n"), t)))
    same = same.select("src", F.col("src").alias("dst"), F.col("own").alias("common"), "n", F.col("n").alias("m"))
    pairs = similar_sets(heads, t).unionByName(same)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("common", lambda x: x["relation_type"]))), ",")
    score = F.size("common") / (F.col("n") + F.col("m") - F.size("common"))
    pairs = pairs.select("src", "dst", names.alias("relation_type"), F.round(score, 4).alias("similarity_score"))
    left = blocks.select(F.col("kind").alias("src"), F.col("block").alias("_a"), F.col("ids").alias("_left"))
    right = blocks.select(F.col("kind").alias("dst"), F.col("block").alias("_b"), F.col("ids").alias("_right"))
    both = pairs.join(left, "src").join(right, "dst").filter("src <> dst OR _a <= _b")
    inside = (F.col("src") == F.col("dst")) & (F.col("_a") == F.col("_b"))
    each = both.withColumn("_inside", inside).withColumn("_x", F.explode("_left")).withColumn("_y", F.explode("_right"))
    return each.filter("NOT _inside OR _x > _y").select(
        F.greatest("_x", "_y").alias("src"), F.least("_x", "_y").alias("dst"), "relation_type", "similarity_score")
