"""Exact top-k by inner product: term-at-a-time accumulation over blocks, then selection and merge."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from crashgrid.llm.registry import query
from crashgrid.session import cut

# Elements in a block of candidates and of queries; with the score arrays they bound a task's memory.
CANDIDATE_ELEMENTS, QUERY_ELEMENTS = 1 << 18, 1 << 21
OUT = "q_row long, query_id long, vec_id long, row long, score long"


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: int64 where that holds every value, else Python integers."""
    y = np.floor(scale * x.astype(np.float64))
    if y.size and np.abs(y).max() >= 2.0**62:
        return np.array([math.floor(v) if np.isfinite(v) else int(scale) * int(w) for v, w in zip(y, x)], dtype=object)
    return y.astype(np.int64)


class Postings:
    """Weights of a block's rows by term (component); components that are zero have no posting."""

    def __init__(self, vectors: pa.ListArray, scale: int):
        start = vectors.offsets.to_numpy()
        values = quantise(vectors.values.to_numpy(zero_copy_only=False)[start[0]:start[-1]], scale)
        start = start - start[0]
        rows = np.repeat(np.arange(len(vectors)), np.diff(start))
        terms = np.arange(len(values)) - np.repeat(start[:-1], np.diff(start))
        some = np.flatnonzero(values)
        self.rows, self.terms, self.values, self.n = rows[some], terms[some], values[some], len(vectors)

    def of_terms(self) -> dict[int, tuple]:
        """term -> (rows, weights); rows is a full slice where every row has the term."""
        order = np.argsort(self.terms, kind="stable")
        names, first = np.unique(self.terms[order], return_index=True)
        parts = zip(names.tolist(), np.split(self.rows[order], first[1:]), np.split(self.values[order], first[1:]))
        return {t: (slice(None) if len(r) == self.n else r, w) for t, r, w in parts}

    def of_rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        cuts = np.searchsorted(self.rows, np.arange(1, self.n))
        return list(zip(np.split(self.terms, cuts), np.split(self.values, cuts)))

    def largest(self) -> int:
        return int(max(abs(self.values.max()), abs(self.values.min()))) if len(self.values) else 0


def block_top(candidates: pa.Table, queries: pa.Table, k: int, scale: int) -> pa.Table:
    """Best k of a block of candidates for every query, the query's own row left out."""
    post, asked = Postings(_chunk(candidates, "vector"), scale), Postings(_chunk(queries, "vector"), scale)
    width = max(int(post.terms.max(initial=0)), int(asked.terms.max(initial=0))) + 1
    bound = post.largest() * asked.largest() * width
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    terms = {t: (r, w.astype(kind)) for t, (r, w) in post.of_terms().items()}
    ids, rows = candidates["vec_id"].to_pylist(), candidates["row"].to_numpy()
    ranked = np.empty(len(ids), dtype=np.int64)  # place by vec_id, nulls last, then by row
    ranked[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))] = np.arange(len(ids))
    place = {r: i for i, r in enumerate(rows.tolist())}
    out: list[tuple] = []
    for q_row, query_id, (names, weights) in zip(queries["row"].to_pylist(), queries["vec_id"].to_pylist(), asked.of_rows()):
        scores = np.zeros(post.n, dtype=kind)
        for t, w in zip(names.tolist(), weights.tolist()):
            if t in terms:
                hit, posted = terms[t]
                scores[hit] += posted * kind(w) if kind is not object else posted * w
        others = np.arange(post.n)
        if q_row in place:
            others = np.delete(others, place[q_row])
        mine = scores[others]
        if len(mine) > k:
            least = np.sort(mine)[-k] if kind is object else np.partition(mine, len(mine) - k)[len(mine) - k]
            others = others[mine >= least]
        best = sorted(others.tolist(), key=lambda i: (-int(scores[i]), ranked[i]))[:k]
        out += [(q_row, query_id, ids[i], int(rows[i]), max(-(2**63), min(2**63 - 1, int(scores[i])))) for i in best]
    columns = list(zip(*out)) or [()] * 5
    return pa.table({n.split()[0]: pa.array(c, pa.int64()) for n, c in zip(OUT.split(", "), columns)})


def _chunk(table: pa.Table, name: str) -> pa.ListArray:
    column = table[name].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each query row of (vec_id, embedding).

    Components become floor(scale * x) and missing ones count as zero, so vectors may differ in
    length; the score is the exact integer inner product (held at the limits of long).  Rows whose
    vector is null or has a null or non-finite component take no part; an empty vector scores 0.
    Ties go to the smaller vec_id, nulls last.  Rows are told apart by their place in the stored
    table, so repeated ids are queries and candidates of their own.  Other columns are ignored.

    Candidates and queries are hashed into blocks of bounded size; each pair of blocks is one group,
    and only its k best rows a query are shuffled, where Spark cuts them again before the merge.
    """
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = cut(vectors.filter(good).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    n, nq, width = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vector"))).first()
    width = max(1, width or 1)
    c_blocks = max(1, math.ceil(n / max(64, CANDIDATE_ELEMENTS // width)))
    q_blocks = max(1, math.ceil(nq / max(64, QUERY_ELEMENTS // width)))
    block = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    columns = ["c", "q", "asking", "row", "vec_id", "vector"]
    candidates = rows.withColumns({"asking": F.lit(False), "c": block(c_blocks)}).withColumn("q", every(q_blocks)).select(columns)
    queries = rows.filter("asks").withColumns({"asking": F.lit(True), "q": block(q_blocks)}).withColumn("c", every(c_blocks)).select(columns)

    def cell(table: pa.Table) -> pa.Table:
        asking = table["asking"].to_numpy(zero_copy_only=False)
        return block_top(table.filter(pa.array(~asking)), table.filter(pa.array(asking)), k, scale)

    found = candidates.unionByName(queries).groupBy("c", "q").applyInArrow(cell, OUT)
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op5_topk_inner_product", "embeddings", """
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
w AS (SELECT vec_id, unnest(range(len(embedding))) AS d, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM w q JOIN w c ON q.d = c.d AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op5_topk_inner_product(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 100 == 0)
