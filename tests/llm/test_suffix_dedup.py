import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from crashgrid.llm import suffix_dedup as sd


def brute(texts):
    """(removed, spans, sha256 of the rest) by comparing all windows as bytes."""
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i:i + 200]] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - 199):
            if seen[d[i:i + 200]] > 1:
                gone[i:i + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = [prose(60) for _ in range(4)], prose(150)
    texts = [None, "", "short", "x" * 199, "y" * 450, "é" * 300, base, base, prose(30)]
    for _ in range(30):
        parts = [prose(r.randrange(5, 80))] + [x for _ in range(r.randrange(3)) for x in (r.choice(shared)[r.randrange(60):], prose(r.randrange(3, 40)))]
        texts.append(" ".join(parts))
    for _ in range(8):  # near copies: single letters differ
        t = list(base)
        for _ in range(r.randrange(1, 4)):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    return texts + [shared[0] + shared[0], prose(4000) + shared[1]]


@pytest.mark.parametrize("seed,large", [(1, sd.LARGE_GROUP), (2, 3)])
def test_report_equals_brute_force(spark, seed, large, monkeypatch):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, h string, n int").repartition(5)
    full = sd.repeated_texts
    monkeypatch.setattr(sd, "repeated_texts", lambda d: full(d, large))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeat_report(df).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, i


def test_pieces_of_a_long_text_are_joined(monkeypatch):
    text = "".join(random.Random(3).choice("abc") for _ in range(5000)).encode()
    whole = {(p, d) for _, p, lo, hi, _ in zip(*(c.tolist() for c in sd.anchors([text]))) for d in range(lo, hi + 1)}
    monkeypatch.setattr(sd, "SEGMENT", 700)
    parts = {(p, d) for _, p, lo, hi, _ in zip(*(c.tolist() for c in sd.anchors([text]))) for d in range(lo, hi + 1)}
    assert whole == parts and len(whole) == 5000 - 199


def test_suffix_sort_is_the_sort_of_the_bytes():
    r = random.Random(4)
    contexts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 30))) for _ in range(300)]
    group = np.array([r.randrange(9) for _ in contexts])
    order = sd.Suffixes(group, contexts, np.zeros(300, dtype=np.int64)).sort()
    assert [(group[i], contexts[i]) for i in order] == sorted(zip(group.tolist(), contexts))


def test_a_shared_hash_falls_back_to_bytes(monkeypatch):
    contexts = [b"a" * 250, b"b" * 250, b"a" * 250]
    monkeypatch.setattr(sd.PrefixHashes, "of", lambda self, s, e, parts=2: (np.zeros(len(s)) + (e - s)).astype(np.uint64))
    out = sd.repeated(np.zeros(3, dtype=np.int64), contexts, np.zeros(3, dtype=np.int64), np.full(3, 50))
    assert out.tolist() == [[0, 50], [-1, -1], [0, 50]]


def test_removed_text(spark):
    base = " ".join(str(i) for i in range(120))
    rows = [(1, base + " tail one", "a"), (2, base + " end", "b"), (3, "alone", "c"), (4, None, "d")]
    out = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1].text == "tail one" and out[2].text == "end" and out[3].text == "alone" and out[4].text is None
    assert out[1].n_removed == len(base) + 1 and out[3].n_removed == 0 and out[2].source == "b"
    assert sd.repeat_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
