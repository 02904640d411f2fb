"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words, down to its last one.  Every passage is measured (what its
bytes are, how words repeat within it and within the document, hashed words), encoded by a learned layer,
and weighted by gated attention, softmax of w . (tanh(V h) * sigmoid(U h)); the weighted representation is
scored by a logistic.  Only documents have labels: encoder, attention and logistic are fitted together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crashgrid.llm.registry import QUERIES
from crashgrid.llm.toxicity import held_out
from crashgrid.session import cut, drop_cut

WORDS = 64
LABELLED_ROWS = 20_000  # documents that the model is fitted on, at most about so many
FITTED_BYTES = 24 << 20  # and so much text in all,
LONGEST_FITTED = FITTED_BYTES // 64  # of texts no longer than this
CHUNK_BYTES = 1 << 20  # of texts measured at once, unless one text is longer
BUCKETS = 256
HIDDEN, GATES = 24, 16
EPOCHS, BATCH, RATE, DECAY = 14, 128, 4e-3, 1e-4

MARKS = b".,!?|#$%&*;:-'\"()/@_<>=+\\[]{}~^`"
SPACE, BREAK, LOWER, UPPER, DIGIT, LEAD, TAIL, CONTROL = range(len(MARKS), len(MARKS) + 8)
CLASSES = CONTROL + 1
WORD_FEATURES = ["words", "length", "distinct", "again", "again_after_one", "pair_seen", "triple_seen", "single", "capital", "shouted", "ends_sentence", "ends_symbol"]
SIZE = CLASSES + len(WORD_FEATURES) + BUCKETS


def byte_classes() -> np.ndarray:
    kinds = np.full(256, CONTROL, dtype=np.int64)
    kinds[32], kinds[9:14] = SPACE, BREAK
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[192:], kinds[128:192] = LOWER, UPPER, DIGIT, LEAD, TAIL
    kinds[np.frombuffer(MARKS, dtype=np.uint8)] = np.arange(len(MARKS))
    return kinds


KINDS = byte_classes()
STEP = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(1024, STEP, dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _seen(keys: np.ndarray) -> np.ndarray:
    """Whether a key stands at an earlier place too."""
    out = np.ones(len(keys), dtype=bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text, first and last byte of each passage).

    A text without words has one passage, of zeros.  What a text gives does not depend on the others.
    """
    coded = [t.encode("utf-8", "replace") for t in texts]
    begins = np.cumsum([0, *(len(c) + 1 for c in coded)])
    letters = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
    kind = KINDS[letters]
    blank = (kind == SPACE) | (kind == BREAK)
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = np.searchsorted(begins, start, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(start)) - (np.cumsum(n_words) - n_words)[doc]
    opens = np.flatnonzero(place % WORDS == 0)
    passage = np.cumsum(place % WORDS == 0) - 1
    many = np.diff(np.append(opens, len(start)))
    first, last = start[opens], end[np.append(opens[1:], len(start)) - 1] if len(start) else start
    rows = np.zeros((len(opens), SIZE), dtype=np.float32)
    if len(opens):
        # bytes of each kind; those between two passages belong to none
        inside = np.zeros(len(letters) + 1, dtype=np.int64)
        inside[first] += 1
        inside[last] -= 1
        inside = np.cumsum(inside[:-1]) > 0
        of_byte = np.repeat(np.arange(len(opens)), last - first)
        rows[:, :CLASSES] = np.bincount(of_byte * CLASSES + kind[inside], minlength=len(opens) * CLASSES).reshape(-1, CLASSES) / (last - first)[:, None]
        # words
        length = end - start
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        heads = np.cumsum(length) - length
        word_kind = kind[~blank]
        word = _mix(np.add.reduceat((letters[~blank].astype(np.uint64) + np.uint64(1)) * POWERS[at & 1023], heads))
        upper, lower = (np.add.reduceat((word_kind == k).astype(np.int64), heads) for k in (UPPER, LOWER))
        final = kind[end - 1]
        salt = _mix((doc + 1).astype(np.uint64) * STEP)
        pair = _mix(word[:-1] * STEP + word[1:])
        triple = _mix(pair[:-1] * STEP + word[2:])
        same = [np.append(np.zeros(k, dtype=bool), (doc[k:] == doc[:-k]))[:len(doc)] for k in (1, 2)]

        def later(flags: np.ndarray, k: int) -> np.ndarray:
            """Flags of the words that have a k-th word before them in their text; false for the others."""
            out = np.zeros(len(doc), dtype=bool)
            out[same[k - 1]] = flags
            return out

        flags = [
            ~_seen(word ^ _mix((passage + 1).astype(np.uint64) * STEP)), later((word[1:] == word[:-1])[same[0][1:]], 1), later((word[2:] == word[:-2])[same[1][2:]], 2),
            later(_seen(pair[same[0][1:]] ^ salt[1:][same[0][1:]]), 1), later(_seen(triple[same[1][2:]] ^ salt[2:][same[1][2:]]), 2), length == 1, kind[start] == UPPER,
            (upper > 1) & (lower == 0), np.isin(final, [MARKS.index(c) for c in b".!?"]), final < len(MARKS),
        ]
        rows[:, CLASSES] = np.log(many) / 4
        rows[:, CLASSES + 1] = np.log1p(np.bincount(passage, length) / many)
        for k, f in enumerate(flags):
            rows[:, CLASSES + 2 + k] = np.bincount(passage, f, minlength=len(opens)) / many
        slot = passage * BUCKETS + (word % np.uint64(BUCKETS)).astype(np.int64)
        rows[:, CLASSES + len(WORD_FEATURES):] = np.sqrt(np.bincount(slot, minlength=len(opens) * BUCKETS).reshape(-1, BUCKETS) / many[:, None])
    n_passages = np.maximum(np.bincount(doc[opens], minlength=len(texts)), 1)
    filled = np.zeros((int(n_passages.sum()), SIZE), dtype=np.float32)
    spans = np.zeros((len(filled), 2), dtype=np.int64)
    has = np.repeat(n_words > 0, n_passages)
    filled[has] = rows
    spans[has] = np.stack([first - begins[doc[opens]], last - begins[doc[opens]]], axis=1)
    return filled, n_passages, spans


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Scaling of the features, encoder (w, b), gated attention (v, u, g) and logistic (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """x: scaled passages; sizes: passages of each document."""
        p, starts = self.p, np.cumsum(sizes) - sizes
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * s) @ p["g"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": sigmoid(z @ p["c"] + p["d"])}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by the chain rule through logistic, attention and encoder."""
        p, f, starts = self.p, self.forward(x, sizes), np.cumsum(sizes) - sizes
        off = (f["score"] - y) / len(y)
        dz = np.repeat(off[:, None] * p["c"], sizes, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), sizes))
        gate = de[:, None] * p["g"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"w": x.T @ dx, "b": dx.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds,
                "g": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ off, "d": off.sum(keepdims=True)}

    def score(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each document, attention of each passage)."""
        if not len(sizes):
            return np.zeros(0), np.zeros(0)
        f = self.forward(self.scaled(x), sizes)
        return f["score"].astype(float), f["a"]


def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, seed: int = 0) -> Model:
    """Adam on batches of documents; without documents, a model that scores all alike."""
    r = np.random.default_rng(seed)
    p = {"w": r.normal(0, SIZE ** -0.5, (SIZE, HIDDEN)), "b": np.zeros(HIDDEN), "v": r.normal(0, 0.2, (HIDDEN, GATES)),
         "u": r.normal(0, 0.2, (HIDDEN, GATES)), "g": r.normal(0, 0.2, GATES), "c": r.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    if not len(y):
        return Model(np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32), {k: np.zeros_like(v, dtype=np.float32) for k, v in p.items()})
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, {k: v.astype(np.float32) for k, v in p.items()})
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    model.p["d"][:] = np.log(rate / (1 - rate))
    x, starts = model.scaled(x).astype(np.float32), np.cumsum(sizes) - sizes
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    steps, total = 0, EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for at in range(0, len(y), BATCH):
            docs = order[at:at + BATCH]
            n = sizes[docs]
            places = np.arange(n.sum()) + np.repeat(starts[docs] - (np.cumsum(n) - n), n)
            grads = model.gradients(x[places], n, y[docs].astype(np.float32))
            steps += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * steps / total))
            for k, g in grads.items():
                g = g + DECAY * model.p[k] if k in "wc" else g
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model.p[k] -= (rate * (first[k] / (1 - 0.9 ** steps)) / (np.sqrt(second[k] / (1 - 0.99 ** steps)) + 1e-8)).astype(np.float32)
    return model


# -------------------------------------------------------------------------------- on Spark
def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(t or "")
        size += len(part[-1])
    if part:
        yield part


def sample(docs: DataFrame, labels: DataFrame, labelled_rows: int, fitted_bytes: int, longest: int) -> DataFrame:
    """text and label (mean over equal texts) of the labelled documents to fit on, by hash and none held out.

    Both bounds become thresholds of a hash: of ids by their number, of texts by their bytes.  So the
    labels are few enough to broadcast, and only chosen texts are shuffled, one of each from a task.
    """
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    spread, usable = 1 << 20, cut(usable)
    share = int(spread * min(1.0, labelled_rows / max(usable.count(), 1)))
    marks = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < share)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marks), "doc_id")
    texts = texts.filter(F.octet_length("text") <= longest).withColumn("h", F.xxhash64("text"))
    known = cut(texts.groupBy("h").agg(F.avg("label").alias("label"), F.max(F.octet_length("text")).alias("size")))
    sizes = known.groupBy(F.pmod("h", F.lit(1024)).alias("slot")).agg(F.sum("size").alias("size"))
    slots, total = 0, 0
    for slot, size in sorted((r[0], r[1]) for r in sizes.collect()):
        total += size
        if total > fitted_bytes:
            break
        slots = slot + 1
    chosen = known.filter(F.pmod("h", F.lit(1024)) < slots).select("h", "label")
    one = texts.select("h", "text").join(F.broadcast(chosen.select("h")), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    result = cut(one.join(F.broadcast(chosen), "h"))
    drop_cut(usable, known)
    return result


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, fitted_bytes: int = FITTED_BYTES, longest: int = LONGEST_FITTED) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out.

    About ``labelled_rows`` documents, ``fitted_bytes`` of text in all, none longer than ``longest``: those
    of smallest hash.  Equal texts are one, with their mean label; of a document's labels the largest
    holds; null labels and ids are ignored.  Passages are measured in tasks; the driver holds some SIZE
    numbers for every WORDS words of the sample.
    """
    stored = sample(docs, labels, labelled_rows, fitted_bytes, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in _chunks(b.column("text").to_pylist()):
                rows, n, _ = measure(part)
                cuts = np.concatenate([[0], np.cumsum(n)])
                here = b.slice(at, len(part))
                at += len(part)
                data = [rows[a:z].astype(np.float16).tobytes() for a, z in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([here.column("h"), here.column("label"), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["h", "label", "n", "data"])

    got = stored.mapInArrow(run, "h long, label double, n long, data binary").toArrow().sort_by("h")
    drop_cut(stored)
    sizes, y = got["n"].to_numpy(), got["label"].to_numpy()
    x = np.empty((int(sizes.sum()), SIZE), dtype=np.float32)
    at = 0
    for data, n in zip(got["data"], sizes):
        x[at:at + n] = np.frombuffer(data.as_py(), dtype=np.float16).reshape(n, SIZE)
        at += n
    return fit(x, sizes, y)


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every text; with ``passages``, also their bytes and attention.

    All passages of a text take part, however many.  A null text counts as empty; a text without words
    is one passage of zeros.  Ids may be null or repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("attention", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in _chunks(b.column("text").to_pylist()):
                rows, n, spans = measure(part)
                values, attention = shared.value.score(rows, n)
                out = [b.column("doc_id").slice(at, len(part)), pa.array(values, pa.float64())]
                at += len(part)
                if passages:
                    each = [{"start": int(s), "end": int(e), "attention": float(a)} for (s, e), a in zip(spans, attention)]
                    cuts = np.concatenate([[0], np.cumsum(n)])
                    out.append(pa.array([each[a:z] for a, z in zip(cuts, cuts[1:])], kind))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score"] + ["passages"] * passages)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double" + ", passages array<struct<start:bigint,end:bigint,attention:double>>" * passages
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        parts = [shared.value.score(*measure(p)[:2])[0] for p in _chunks(list(texts))]
        return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return docs.withColumn("_quality", quality("text")).filter(F.col("_quality") >= threshold).drop("_quality")


def _op12(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op12_quality_classifier"] = _op12
