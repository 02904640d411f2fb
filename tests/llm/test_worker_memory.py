"""What Python workers hold at a time: one worker a task for token ids, few characters, few bytes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from crashgrid.llm import bpe
from crashgrid.llm.memory import exchange_few_rows

SF = "/root/testdata/sf0.001"


def test_ids_are_decoded_by_the_worker_that_made_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.encode(spark, docs, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    apart = bpe.decode(bpe.encode(docs.select("doc_id", "text", "lang", "source")))
    want = apart.withColumn("n_decoded", F.length("text").cast("long")).drop("text")
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_nulls_and_wide_characters_are_decoded(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "日本語 🙂 é", 7), (4, "Don't", 8)], "doc_id long, text string, n_decoded int")
    coded = bpe.encode(df, decoded=True)
    assert coded.columns == ["doc_id", "ids", "n_tokens", "n_decoded"]
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert {r.doc_id: r.n_decoded for r in coded.collect()} == {k: len(t) for k, t in texts.items()}


def plain_encoder(tmp_path):
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon([], []))
    return bpe.Encoder(bpe.Tokenizer(bpe.read_tokenizer()), bpe.Lexicon(str(tmp_path / "lexicon")))


def test_long_texts_are_split_few_at_a_time(tmp_path):
    encoder = plain_encoder(tmp_path)
    texts, taken, words = [f"{i} " + "a b " * 50_000 for i in range(12)], [], encoder.tokenizer.words
    encoder.tokenizer.words = lambda t: (taken.append(len(t)), words(t))[1]
    ids = encoder.encode(texts)
    first = next(ids)
    assert sum(taken) <= bpe.SPLIT_CHARS  # all twelve were split before the first was given out
    assert [first, *ids] == [i for t in texts for i in encoder.encode([t])]


def test_remembered_words_are_bounded_in_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "HELD_BYTES", 100_000)
    encoder = plain_encoder(tmp_path)
    texts = [chr(97 + i) * 40_000 for i in range(20)]
    for t in texts:
        assert len(np.frombuffer(next(encoder.encode([t])), dtype="<u4")) > 0
        assert sum(len(w) + len(i) for w, i in encoder.known.items()) <= 100_000 + 5 * 40_000  # what came last, besides


def test_batches_are_bounded_in_bytes(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {n: spark.conf.get(n) for n in names}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    try:
        exchange_few_rows(spark)
        texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
        found = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 40 and max(r["size"] for r in found) <= 6_000_000
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
