"""Tokenizer alignment against token-by-token interval comparison with the tokenizer libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from crashgrid.llm import alignment as A

BYTES_A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
BYTES_A.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
LETTER = {c: b for b, c in enumerate(A.byte_letters())}
ALIGNER = A.Aligner(open(P.path("byte_bpe_50k.json"), "rb").read(), open(P.path("piece_bpe_32k.model"), "rb").read())


def spans(words):
    out, at = [], 0
    for k, w in words:
        out.append((k, at, at + len(w)))
        at += len(w)
    return out


def brute_one(text):
    """(A spans, B spans, groups, links) of a text from the libraries' own tokens."""
    if not text:
        return [], [], [], []
    a = [(k, bytes(LETTER[c] for c in BYTES_A.id_to_token(k))) for k in BYTES_A.encode(" " + text, add_special_tokens=False).ids]
    b = [(k, bytes([int(p[3:5], 16)]) if PIECES.is_byte(k) else p.replace("▁", " ").encode()) for k in PIECES.encode(text) for p in [PIECES.id_to_piece(k)]]
    whole = (" " + text).encode()
    if any(b"".join(w for _, w in side) != whole for side in (a, b)):
        return [], [], [], []
    a, b = spans(a), spans(b)
    both = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, low = [], 0
    for high in both:
        groups.append(tuple([k for k, s, e in side if low <= s < high] for side in (a, b)))
        low = high
    return a, b, groups, [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]


def brute(texts):
    found = [brute_one(t) for t in texts]
    counts = Counter(p for *_, links in found for p in links)
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    for a, b, groups, links in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        yield (len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
               hashlib.sha256(text.encode()).hexdigest() if groups else "")


TEXTS = [None, "", " ", "  two  spaces ", "<|endoftext|> and <s> </s> <unk>", "tab\tline\n\nend", "▁ block", "naïve café – “quotes” 😀👩‍👩‍👧", "日本語のテキスト 漢字", "a" * 3000,
         "\x00\x01 control", "<0x41> A", "don't they'll I've", "é composed é", "१२३ ٣٤ 12345", "　  x", "x"]


@pytest.mark.parametrize("held", [A.HELD_PAIRS, 40, 0])
def test_alignment_of_a_corpus(spark, held):
    r = random.Random(held)
    words = "the of and thing error ontological über ción 12 3.14 ... -- (x) naïve".split()
    texts = TEXTS + [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(60)] + ["same text here"] * 9 + ["the " * 20_000]
    rows = [(i if i % 7 else 7, t, "clash", 5) for i, t in enumerate(texts)]
    got = A.align(spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int").repartition(3), held=held)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    small = [t if t is None or len(t) < 50_000 else None for t in texts]
    if held == A.HELD_PAIRS:  # the long text alone has too many pairs for the plain form
        rows_seen = Counter(r[0] for r in got.collect())
        assert rows_seen == Counter(r[0] for r in rows)
    frame = spark.createDataFrame([(*r[:1], t, *r[2:]) for r, t in zip(rows, small)], "doc_id long, text string, pairs string, n_a int").repartition(3)
    assert sorted(tuple(r) for r in A.align(frame, held=held).collect()) == sorted((r[0], *x) for r, x in zip(rows, brute(small)))


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_one_batch(texts):
    for text, (n_a, n_b, n_groups, n_links, digest, pairs, times) in zip(texts, ALIGNER.align(texts) if texts else []):
        a, b, groups, links = brute_one(text)
        assert (n_a, n_b, n_groups, n_links) == (len(a), len(b), len(groups), len(links))
        assert dict(zip(pairs.tolist(), times.tolist())) == Counter(x * ALIGNER.width + y for x, y in links)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.integers(0, 2 ** 30))
def test_coalescing_and_expansion(sizes, cut):
    total = sum(sizes)
    other = np.diff([0, *sorted({c for c in range(1, total) if (cut >> (c % 30)) & 1}), total])
    a, b = A.merged_ends(np.array(sizes)), A.merged_ends(other)
    group_a, group_b = A.coalesce(*a, *b)
    common = sorted(set(a[1].tolist()) & set(b[1].tolist()))
    for (_, ends), group in ((a, group_a), (b, group_b)):
        assert group.tolist() == np.searchsorted(common, ends).tolist()
    pairs = [(i, j) for i in range(len(sizes)) for j in range(len(other)) if a[0][i] < b[1][j] and b[0][j] < a[1][i]]
    assert list(zip(*(x.tolist() for x in A.expand(*a, *b)))) == pairs
