"""Temperature mixing: source shares raised to an exponent, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from crashgrid.llm.registry import query
from crashgrid.llm.rows import numbered, repeat_rows
from crashgrid.llm.sharding import number_rows
from crashgrid.session import cut, drop_cut
from crashgrid.sources.maintenance import number_rows as running_totals

BLOCK_ROWS = 1024
TARGET_ENTROPY, MAX_REPEATS = 0.9, 4.0
HALVINGS, PASSES = 5, 6  # halvings evaluated in one pass over the sources, passes


def word_count(text: Column) -> Column:
    """Words between blanks; 0 for a null or empty text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("long")


@dataclass(frozen=True)
class Mix:
    """Weights are share ** exponent / z; ``budget`` is the number of tokens to deal out."""

    exponent: float
    z: float
    budget: float
    total: float

    def weight(self, share: Column) -> Column:
        return F.pow(share, F.lit(self.exponent)) / F.lit(self.z)


def solve(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> Mix:
    """The exponent between 0 (equal weights) and 1 (shares as they are) that meets the limits.

    ``sources`` has tokens of each source, all positive.  ``target_entropy``, a share of the entropy of
    equal weights, is what the mix is flattened to, if its own entropy is below that; ``max_repeats``
    bounds how often a source's tokens are dealt out, and goes first.  Without a
    ``budget`` it is the least one at which no source falls short of its own tokens.  Entropy and
    repeats fall as the exponent grows, so each is bisected; a pass over the sources evaluates all
    exponents that the next HALVINGS halvings can ask for, and only those sums reach the driver.
    """
    total, largest, least, n = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count("*")).first()
    if not n:
        return Mix(1.0, 1.0, 0.0, 0.0)
    p, top, low = F.col("tokens") / F.lit(float(total)), largest / total, least / total

    def dealt(a: float, z: float) -> float:
        """Budget over total tokens: repeats of a source are this times share ** (a - 1) / z."""
        return budget / total if budget is not None else z * max(top ** (1 - a), low ** (1 - a))

    def sums(exponents: list[float]) -> dict[float, tuple[float, float]]:
        power = [F.pow(p, F.lit(a)) for a in exponents]
        row = sources.agg(*[F.sum(x) for x in power], *[F.sum(x * F.log(p)) for x in power]).first()
        return {a: (row[i], row[i + len(exponents)]) for i, a in enumerate(exponents)}

    def too_flat(a: float, z: float, zlog: float) -> bool:
        entropy = math.log(z) - a * zlog / z
        repeats = dealt(a, z) / z * max(top ** (a - 1), low ** (a - 1))
        over = target_entropy is not None and n > 1 and entropy > target_entropy * math.log(n)
        return over or max_repeats is not None and a < 1 and repeats > max_repeats

    lo, hi = 0.0, 1.0
    known = sums([lo, hi])
    if not too_flat(lo, *known[lo]):
        hi = lo
    for _ in range(PASSES if hi > lo else 0):
        steps = 2**HALVINGS
        grid = [lo + (hi - lo) * k / steps for k in range(1, steps)]
        known |= sums(grid)
        for _ in range(HALVINGS):
            mid = min(grid, key=lambda a: abs(a - (lo + hi) / 2))
            if too_flat(mid, *known[mid]):
                lo = mid
            else:
                hi = mid
    z = known[hi][0]
    return Mix(hi, z, budget if budget is not None else total * dealt(hi, z), total)


def plan_mix(docs: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS,
             budget: float | None = None, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """_row, doc_id, source, n_tokens, exponent, weight, copies and block of every document.

    A source's quota is its weight times the budget: so many whole passes over its documents, then
    blocks of them in hashed order until the rest of the quota is used up, where the document that
    crosses the line is the last.  ``copies`` is how often a document is dealt out.  Documents are
    put into blocks of BLOCK_ROWS in hashed order within their source.  A null source is a source of
    its own; documents without tokens use no quota and are dealt out once.  A column ``_row`` of
    distinct numbers is used if there is one; other columns are ignored.

    Places and running totals come from range sorts with one offset a range, so a source may hold
    any share of the rows.
    """
    number = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    count = (tokens if tokens is not None else word_count(F.col("text"))).alias("n_tokens")
    key = F.xxhash64(F.lit(seed), "doc_id", "text").alias("key")
    slim = cut(docs.select(number.alias("doc_row"), "doc_id", F.col("source").cast("string").alias("source"), count, key))
    sums = cut(slim.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    mix = solve(sums, target_entropy, max_repeats, budget)
    quota = mix.weight(F.col("tokens") / F.lit(mix.total or 1.0)) * F.lit(mix.budget)
    sources = sums.select(F.col("source").alias("_source"), "tokens", mix.weight(F.col("tokens") / F.lit(mix.total or 1.0)).alias("weight"),
                          F.floor(quota / F.col("tokens") + 1e-9).alias("passes"), quota.alias("quota"))
    sources = sources.withColumn("rest", F.greatest(F.col("quota") - F.col("passes") * F.col("tokens"), F.lit(0.0)))

    numbered, _ = number_rows(slim.filter("n_tokens > 0"), ["source", "key", "doc_id"])
    firsts = numbered.groupBy("source").agg(F.min("_row").alias("_first")).withColumnRenamed("source", "_source")
    placed = numbered.join(cut(firsts), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = cut(placed.withColumn("block", F.floor((F.col("_row") - F.col("_first")) / BLOCK_ROWS)).drop("_first"))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    blocks = running_totals(blocks.withColumn("turn", F.xxhash64(F.lit(seed + 1), "source", "block")), "source", "turn", "block", tokens=F.col("tokens"))
    blocks = cut(blocks.select(F.col("source").alias("_source"), F.col("block").alias("_block"), F.col("_at_tokens").alias("at")))
    starts = cut(blocks.groupBy("_source").agg(F.min("at").alias("start")).withColumnRenamed("_source", "_start_of"))
    blocks = blocks.join(starts, F.col("_source").eqNullSafe(F.col("_start_of"))).select("_source", "_block", (F.col("at") - F.col("start")).alias("at"))
    inside = Window.partitionBy("source", "block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    dealt = placed.join(blocks, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).drop("_source", "_block")
    dealt = dealt.withColumn("before", F.col("at") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    dealt = dealt.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    exponent = F.lit(float(mix.exponent)).alias("exponent")
    # below half a token the rest is rounding only
    copies = (F.col("passes") + ((F.col("rest") > 0.5) & (F.col("before") < F.col("rest"))).cast("long")).alias("copies")
    empty = slim.filter("n_tokens = 0").select(
        F.col("doc_row").alias("_row"), "doc_id", "source", "n_tokens", exponent, F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("copies"), F.lit(None).cast("long").alias("block"))
    full = dealt.select(F.col("doc_row").alias("_row"), "doc_id", "source", "n_tokens", exponent, "weight", copies, "block")
    result = cut(full.unionByName(empty))
    drop_cut(slim, numbered, placed, blocks, starts)
    return result


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, each as often as ``plan_mix`` deals it out."""
    stored = numbered(docs)
    plan = plan_mix(stored, **options)
    dealt = repeat_rows(stored, plan.select("_row", F.col("copies").alias("_value")))
    drop_cut(plan)
    return dealt


@query("op8_mix_sources", "documents")
def op8_mix_sources(documents: DataFrame) -> DataFrame:
    return plan_mix(documents).drop("_row")
