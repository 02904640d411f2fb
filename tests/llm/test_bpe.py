import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from crashgrid.llm import bpe

TEXTS = [
    "", " ", "Hello World", "don't we'll I'D they've ’s", "ÉTÉ Ωmega ΣΑΣ ΟΔΟΣ İstanbul ǅ ﬁ", "é ñ Å", "a<|endoftext|>B <|startoftext|>",
    "<|ENDOFTEXT|> <|endoftext|", "x y z\x1cq\x85w", "1234 ½ ٣ 四", "日本語テキスト 한국어", "🙂🙃 family 👨‍👩‍👧", "!!!??? ... --- '''s 's't", "the " * 500,
    "ab" * 3000, "thanonontioniner achlichkeit éreeuxaux", "\n\t mixed\r\nlines ", "﻿bom ​ zero", "a\u0000b",
]


@pytest.fixture(scope="module")
def content():
    return bpe.read_tokenizer()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    t = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def encoder(content, tmp_path, words):
    t = bpe.Tokenizer(content)
    words = sorted(set(words))
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(words, t.merge(words)))
    return bpe.Encoder(t, bpe.Lexicon(str(tmp_path / "lexicon")))


def fuzz(n):
    r = random.Random(5)
    chars = "abcdeTHE 'sé.,!ñΣσ1ß\n\t世́🙂-"
    return ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("lexicon", [[], ["hello", "the", "world", "é", "aba", "abc", "bc", "c"]])
def test_same_ids_and_text_as_the_library(content, library, tmp_path, lexicon):
    e = encoder(content, tmp_path, lexicon)
    texts = TEXTS + fuzz(400)
    for text, ids in zip(texts, e.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, text
        assert e.tokenizer.decode(want).decode() == library.decode(want, skip_special_tokens=False)


def test_lexicon_ranks_are_those_of_the_sorted_words(content, tmp_path):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randrange(1, 9))) for _ in range(800)})
    e = encoder(content, tmp_path, words)
    order = sorted(words, key=str.encode)
    assert e.lexicon.ranks(order).tolist() == list(range(len(order)))
    others = [w for w in ("d", "ab" * 20, "aé!") if w not in words]
    assert (e.lexicon.ranks(others) == -1).all()
    assert len(e.lexicon.finals) < sum(map(len, words)) / 2  # suffixes are shared


def test_long_words_merge_like_short_ones(content):
    t = bpe.Tokenizer(content)
    for w in ("hello", "aaaaaaa", "thetheand", "é" * 9, "x"):
        assert t._merge_one(w.encode()).tolist() == t.merge([w])[0].tolist()


def test_on_spark(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, TEXTS[2]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe.encode(df)
    assert coded.columns == ["doc_id", "ids", "n_tokens"]
    back = {r.doc_id: r for r in bpe.decode(coded).collect()}
    assert all(len(r.ids) == r.n_tokens and r.text == library.decode(r.ids, skip_special_tokens=False) for r in back.values())
    assert bpe.round_trip(df.limit(0)).count() == 0
