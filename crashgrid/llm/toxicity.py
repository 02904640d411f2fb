"""Toxic passages: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Log-odds come from counts of words and word beginnings in labelled texts, smoothed level by level by
Dirichlet priors.  A linear-time scan finds all maximal scoring segments of a text; a Gumbel law
fitted to clean texts tells how unlikely a segment's score is in a text of that length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crashgrid.llm.memory import hand_back, lean
from crashgrid.llm.registry import QUERIES
from crashgrid.session import cut, drop_cut

WORD = re.compile(r"\w+")
BUCKETS = 1 << 20
LEVELS = (3, 4, 5, 6, 7)  # lengths of word beginnings, before the whole word
PRIOR = 12.0  # observations that the level above is worth
SURE = 1e-4  # the smoothed rate of a token stays so far from 0 and 1
DRIFT = 1.5  # taken from each token's log-odds, so that segments do not grow over neutral text
LABELLED_ROWS = 200_000
HELD = 150_000


def slots(word: str) -> list[int]:
    """Buckets of a word's beginnings and of the word itself, shortest first."""
    parts = [word[:n] for n in LEVELS if n <= len(word)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass"), len(p)) % BUCKETS for p in parts] + [zlib.crc32(word.encode("utf-8", "surrogatepass"), 99) % BUCKETS]


class TokenScores(dict):
    """Token -> log-odds less the drift, computed when first met; at most HELD are remembered."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray):
        self.toxic, self.clean = toxic, clean
        t, c = float(toxic[-1]), float(clean[-1])  # the last places hold the totals
        self.rate = (t + 1) / (t + c + 2)

    def __missing__(self, word: str) -> float:
        rate = self.rate
        for s in slots(word):
            t, c = float(self.toxic[s]), float(self.clean[s])
            rate = (t + PRIOR * rate) / (t + c + PRIOR)
        rate = min(max(rate, SURE), 1 - SURE)
        score = float(np.log(rate / (1 - rate)) - np.log(self.rate / (1 - self.rate))) - DRIFT
        if len(self) >= HELD:
            self.clear()
        self[word] = score
        return score

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), dtype=np.float64, count=len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in linear time.

    Candidates are kept with the running totals before and after them; a positive token joins every
    earlier candidate that it extends (left total smaller, right total smaller than its own).
    """
    after = np.cumsum(scores)
    out: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    back: list[int] = []  # nearest earlier candidate with a smaller total before, or -1
    for i in np.flatnonzero(scores > 0).tolist():
        right = float(after[i])
        left, start = right - float(scores[i]), i
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = back[j]
            if j < 0 or out[j][3] >= right:
                out.append((start, i + 1, left, right))
                back.append(j)
                break
            start, left = out[j][0], out[j][2]
            del out[j:], back[j:]
            j -= 1
    return [(a, b, r - le) for a, b, le, r in out]


@dataclass
class Calibration:
    """Gumbel law of the best segment in clean text (rate, log of K) and weights of the final logistic."""

    rate: float
    log_k: float
    weights: np.ndarray
    significance: float = 0.05

    def excess(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """rate * score - ln(K * n): minus the log of the number of such segments expected by chance."""
        return self.rate * score - self.log_k - np.log(np.maximum(n, 1))

    def p_value(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.expm1(-np.exp(np.clip(-self.excess(score, n), -700, 700)))

    def features(self, best: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the best segment and of the sum over significant ones, both as excess, with slow growth."""
        grow = lambda x: np.sign(x) * np.log1p(np.abs(x))
        x = self.excess(best, n)
        return np.stack([np.ones_like(x), grow(x), np.log1p(np.maximum(total, 0))], axis=1)

    def probability(self, best: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(best, total, n) @ self.weights, -30, 30)))

    def summed(self, values: np.ndarray, words: int) -> float:
        """Summed excess of the significant ones among the segment scores of a text of so many words."""
        n = np.full(len(values), words)
        good = self.p_value(values, n) < self.significance
        return float(np.maximum(self.excess(values, n)[good], 0).sum())

    def passages(self, scores: np.ndarray) -> tuple[list[tuple[int, int, float, float]], float, float]:
        """((start, end, score, p) of significant segments, best score, summed excess of those)."""
        found = segments(scores)
        if not found:
            return [], 0.0, 0.0
        value, n = np.array([s for _, _, s in found]), np.full(len(found), len(scores))
        p = self.p_value(value, n)
        good = np.flatnonzero(p < self.significance)
        return [(*found[i], float(p[i])) for i in good], float(value.max()), float(np.maximum(self.excess(value, n)[good], 0).sum())


def fit_gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Maximum likelihood of P(best <= s) = exp(-K n exp(-rate s)) over clean texts: (rate, ln K)."""
    if len(best) < 10 or best.std() < 1e-9:
        return 1.0, 0.0
    n, rate = np.maximum(n, 1).astype(float), 1.0
    for _ in range(200):
        w = n * np.exp(-rate * (best - best.min()))
        new = 1 / max(1e-6, best.mean() - (w * best).sum() / w.sum())
        if abs(new - rate) < 1e-9 * rate:
            break
        rate = (rate + new) / 2
    return rate, float(np.log(len(best) / (n * np.exp(-rate * best)).sum()))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(best: np.ndarray, n: np.ndarray, totals, labels: np.ndarray) -> Calibration:
    """``totals(calibration)`` gives the summed excess of each text once the Gumbel law is known."""
    rate, log_k = fit_gumbel(best[labels == 0], n[labels == 0])
    cal = Calibration(rate, log_k, np.zeros(3))
    cal.weights = fit_logistic(cal.features(best, totals(cal), n), labels) if len(labels) else np.array([-3.0, 1.0, 1.0])
    return cal


@dataclass
class Model:
    toxic: np.ndarray
    clean: np.ndarray
    calibration: Calibration


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Fit on at most ``labelled_rows`` labelled documents that are not held out, those of smallest hash.

    That bound, a parameter, makes the labels small enough to broadcast, so texts are not shuffled.
    Equal texts count once in all, so copies do not outvote the rest.  The texts are split in two
    halves by hash: each is measured with the counts of the other to calibrate, and the final counts
    are those of both.  Of a document's labels the largest holds; null labels and ids are ignored.
    Rows that repeat a document with the same text are one text, so they are measured once.  One pass
    over the texts stores the scores of their segments: the best ones give the Gumbel law, and then the
    excess of all significant ones is summed, as in scoring.  The driver holds four arrays of BUCKETS counts and five numbers for each
    labelled text; a document of several texts has all of them.
    """
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    marks = cut(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows))
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marks), "doc_id")
    chosen = chosen.select("doc_id", "text", "label", F.xxhash64("text").alias("h"))
    rows = cut(chosen.groupBy("doc_id", "h").agg(F.count("*").alias("times")))
    copies = cut(rows.groupBy("h").agg(F.sum("times").alias("count")).filter("count > 1"))  # fewer than half of the labelled texts
    repeated = cut(rows.filter("times > 1"))
    # only texts that repeat within a document are shuffled, one of each from a task
    tagged = chosen.join(F.broadcast(repeated), ["doc_id", "h"], "left")
    once = tagged.filter("times > 1").groupBy("doc_id", "h", "label", "times").agg(F.first("text").alias("text"))
    chosen = tagged.filter("times IS NULL").unionByName(once) if not repeated.isEmpty() else tagged
    chosen = chosen.join(F.broadcast(copies), "h", "left").withColumn("weight", F.coalesce("times", F.lit(1)) / F.coalesce("count", F.lit(1)))
    chosen = chosen.select("text", "label", "weight", "h", F.pmod("h", F.lit(2)).cast("int").alias("half"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(BUCKETS + 1) for _ in range(4)]  # toxic and clean of each half
        held: list[Counter] = [Counter() for _ in sums]

        def settle():
            for total, counter in zip(sums, held):
                for word, w in counter.items():
                    total[slots(word)] += w
                    total[-1] += w
                counter.clear()

        for b in batches:
            for text, label, weight, half in zip(b.column("text"), *(b.column(c).to_pylist() for c in ("label", "weight", "half"))):
                counter = held[2 * half + (label <= 0)]
                for word, k in Counter(WORD.findall(text.as_py().lower())).items():
                    counter[word] += k * weight
                if sum(map(len, held)) > HELD:
                    settle()
        settle()
        some = np.flatnonzero(sum(sums))
        for part in np.array_split(some, max(1, len(some) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(s[part].astype(np.float32)) for s in sums)], names=["slot", *names])

    names = ["t0", "c0", "t1", "c1"]
    rows = chosen.mapInArrow(lean(count), "slot int, t0 float, c0 float, t1 float, c1 float").groupBy("slot").agg(
        *[F.sum(c).cast("float").alias(c) for c in names]).toArrow()
    counts = np.zeros((4, BUCKETS + 1), dtype=np.float32)
    counts[:, rows["slot"].to_numpy()] = [rows[c].to_numpy() for c in names]
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = [TokenScores(*shared.value[2:]), TokenScores(*shared.value[:2])]
        for b in batches:
            n, values = [], []
            for t, h in zip(b.column("text"), b.column("half").to_pylist()):
                n.append(len(s := other[h].of(t.as_py())))
                values.append([v for _, _, v in segments(s)])
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("label"), pa.array(n, pa.int64()), pa.array(values, pa.list_(pa.float64()))], names=["h", "label", "n", "values"])

    stored = cut(chosen.mapInArrow(lean(measure), "h long, label int, n long, values array<double>"))

    def measured(cal: Calibration | None = None) -> dict[str, np.ndarray]:
        """h, label, n, best and summed excess (0 before the law is known) of each text, in a fixed order."""

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                total = [cal.summed(np.array(v, dtype=float), n) if cal else 0.0 for v, n in zip(b.column("values").to_pylist(), b.column("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in found[:-1]), pa.array(total, pa.float64())], names=found)

        found = ["h", "label", "n", "best", "total"]
        tops = stored.withColumn("best", F.coalesce(F.array_max("values"), F.lit(0.0)))
        got = tops.mapInArrow(lean(judge), "h long, label int, n long, best double, total double").toArrow()
        columns = {c: got[c].to_numpy() for c in found}
        order = np.lexsort([columns[c] for c in ("best", "n", "label", "h")])
        return {c: v[order] for c, v in columns.items()}

    first = measured()
    y = (first["label"] > 0).astype(float)
    cal = calibrate(first["best"], first["n"], lambda c: measured(c)["total"], y)
    shared.unpersist()
    drop_cut(stored)
    return Model(counts[0] + counts[2], counts[1] + counts[3], cal)


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """doc_id, score (0 to 1) of every text, and with ``passages`` the significant ones.

    A passage has start and end in characters, its score and its p-value.  A null text counts as
    empty; a text without words gets the score of no evidence.  Ids may be null or repeat; other
    columns are not read.
    """
    shared, cal = docs.sparkSession.sparkContext.broadcast((model.toxic, model.clean)), model.calibration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = TokenScores(*shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))
        for b in batches:
            best, total, sizes, spans = [], [], [], []
            for value in b.column("text"):
                text = value.as_py() or ""
                found, top, excess = cal.passages(s := scores.of(text))
                best.append(top)
                total.append(excess)
                sizes.append(len(s))
                if passages:
                    at = [m.span() for m in WORD.finditer(text.lower())] if found else []
                    spans.append([{"start": at[a][0], "end": at[e - 1][1], "score": v, "p": p} for a, e, v, p in found])
            out = [b.column("doc_id"), pa.array(cal.probability(*map(np.array, (best, total, sizes))) if best else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(spans, kind)] * passages, names=["doc_id", "score"] + ["passages"] * passages)

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, score double" + ", passages array<struct<start:int,end:int,score:double,p:double>>" * passages
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    model = train(docs, labels)
    shared, cal = docs.sparkSession.sparkContext.broadcast((model.toxic, model.clean)), model.calibration

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = TokenScores(*shared.value)
        for texts in batches:
            found = [(cal.passages(s := scores.of(t or ""))[1:], len(s)) for t in texts]
            yield pd.Series(cal.probability(*(np.array(c, dtype=float) for c in zip(*((*f, n) for f, n in found)))) if found else [], dtype=float)
        scores.clear()
        hand_back()

    return docs.withColumn("_toxicity", toxicity("text")).filter(F.col("_toxicity") < threshold).drop("_toxicity")


def _op3(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES["op3_toxicity"] = _op3
