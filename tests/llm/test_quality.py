"""Quality classifier: measures against plain counts, gradients, attention, held-out rows, odd inputs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crashgrid.llm import quality as Q

SF = "/root/testdata/sf0.01"


def some_texts(seed):
    r = random.Random(seed)
    words = ["the", "The", "NOISE!!", "a", "ér", "x|y", "end.", "12", "$$$", "of"]
    blanks = [" ", "\n", "  ", "\t"]
    texts = ["".join(r.choice(blanks) * (r.random() < 0.1) + r.choice(words) + r.choice(blanks) for _ in range(r.randrange(0, 300))) for _ in range(12)]
    return ["", " \n ", "one", *texts]


def plain(text):
    """The same measures by loops, without the hashed words."""
    coded = text.encode()
    words = coded.split()
    spans, at = [], 0
    for w in words:
        at = coded.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    rows, pairs, triples = [], set(), set()
    for k in range(0, len(words), Q.WORDS):
        part = words[k:k + Q.WORDS]
        body = coded[spans[k][0]:spans[min(k + Q.WORDS, len(words)) - 1][1]]
        kinds = Counter(int(Q.KINDS[c]) for c in body)
        seen, f = set(), Counter()
        for i, w in enumerate(part, k):
            f["distinct"] += w not in seen
            seen.add(w)
            f["again"] += i > 0 and words[i - 1] == w
            f["again_after_one"] += i > 1 and words[i - 2] == w
            pair, triple = tuple(words[i - 1:i + 1]), tuple(words[i - 2:i + 1])
            f["pair_seen"] += i > 0 and pair in pairs
            f["triple_seen"] += i > 1 and triple in triples
            pairs.add(pair) if i else None
            triples.add(triple) if i > 1 else None
            upper, lower = (sum(a <= c <= z for c in w) for a, z in ((65, 90), (97, 122)))
            f["single"] += len(w) == 1
            f["capital"] += 65 <= w[0] <= 90
            f["shouted"] += upper > 1 and not lower
            f["ends_sentence"] += w[-1:] in (b".", b"!", b"?")
            f["ends_symbol"] += w[-1] in Q.MARKS
        n = len(part)
        rows.append([*(kinds[c] / len(body) for c in range(Q.CLASSES)), np.log(n) / 4, np.log1p(sum(map(len, part)) / n), *(f[x] / n for x in Q.WORD_FEATURES[2:])])
    return rows or [[0.0] * (Q.CLASSES + len(Q.WORD_FEATURES))]


@pytest.mark.parametrize("seed", range(3))
def test_measures(seed):
    texts = some_texts(seed)
    rows, n, spans = Q.measure(texts)
    expected = [plain(t) for t in texts]
    assert n.tolist() == [len(e) for e in expected]
    np.testing.assert_allclose(rows[:, :Q.CLASSES + len(Q.WORD_FEATURES)], np.concatenate(expected), atol=1e-5)
    at = 0
    for t, k in zip(texts, n):
        alone, _, own = Q.measure([t])
        np.testing.assert_array_equal(alone, rows[at:at + k])
        np.testing.assert_array_equal(own, spans[at:at + k])
        assert sum(len(t.encode()[a:b].split()) for a, b in own) == len(t.split())
        at += k


def test_gradients():
    r = np.random.default_rng(0)
    sizes, y = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = r.normal(0, 1, (8, Q.SIZE))
    model = Q.Model(np.zeros(Q.SIZE), np.ones(Q.SIZE), {"w": r.normal(0, 0.1, (Q.SIZE, 5)), "b": r.normal(0, 0.1, 5), "v": r.normal(0, 1, (5, 3)), "u": r.normal(0, 1, (5, 3)),
                                                         "g": r.normal(0, 1, 3), "c": r.normal(0, 1, 5), "d": r.normal(0, 1, 1)})

    def loss():
        s = model.forward(x, sizes)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, grad in model.gradients(x, sizes, y).items():
        flat = model.p[name].reshape(-1)
        for k in r.integers(0, len(flat), 4):
            old, step = flat[k], 1e-6
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * step) - grad.reshape(-1)[k]) < 1e-5, name


def test_attention_finds_the_passage_that_decides():
    r = np.random.default_rng(1)
    sizes = r.integers(2, 9, 1500)
    starts, x, y = np.cumsum(sizes) - sizes, np.zeros((int(sizes.sum()), Q.SIZE), dtype=np.float32), r.integers(0, 2, 1500).astype(float)
    x[:, 1:8] = r.normal(0, 1, (len(x), 7))
    marked = starts + r.integers(0, sizes)
    x[marked, 0], x[marked, 1] = 3, np.where(y > 0, 2, -2)  # the first says where to look, the second what to say
    end = starts[1000]
    model = Q.fit(x[:end], sizes[:1000], y[:1000])
    values, attention = model.score(x[end:], sizes[1000:])
    assert ((values > 0.5) == y[1000:]).mean() > 0.95
    assert attention[marked[1000:] - end].mean() > 2 * attention.mean()


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels)
    got = {r.doc_id: r.score for r in Q.score(docs.repartition(5), model).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    kept = labels.filter(Q.held_out(F.col("doc_id"))).collect()
    assert np.mean([(got[r.doc_id] >= 0.5) == (r.quality == 1) for r in kept]) > 0.97
    shown = Q.score(docs, model, passages=True).limit(50).collect()
    assert all(abs(sum(p.attention for p in r.passages) - 1) < 1e-5 for r in shown)
    good = Q.keep_good(docs.withColumn("score", F.lit("clash")), labels)
    assert good.columns == [*docs.columns, "score"] and {r.doc_id for r in good.collect()} == {d for d, s in got.items() if s >= 0.5}


def test_learns_nothing_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (Q.train(docs, x) for x in (labels, turned))
    assert all(np.array_equal(one.p[k], other.p[k]) for k in one.p)


def test_odd_inputs(spark):
    kinds = "doc_id long, text string, label string, h string, size int"
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate([None, "", "ok words.", "BAD!! " * 60_000, "ok words.", "ok words."])] + [(2, "ok words.", "", "", 2), (None, "x", "", "", 3)]
    docs = spark.createDataFrame(rows, kinds)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    got = Q.score(docs, model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1
    empty = Q.train(docs.limit(0), labels)
    assert [r.score for r in Q.score(docs, empty).collect()] == [0.5] * 8 and Q.score(docs.limit(0), model).count() == 0
    assert Q.keep_good(docs.limit(0), labels.limit(0)).count() == 0
    bounded = Q.sample(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")),
                       spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")), 400, 1 << 20, 1 << 10).count()
    assert 300 < bounded < 500
