"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from crashgrid.llm import toxicity
from test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "minhash near-dedup", "mixing", "bpe"]
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    start = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(start, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(start, model).filter("score < 0.7").collect()}
    assert {r.doc_id for r in seen[1]} == clean
    last = {}
    for r in seen[1]:
        key = r.text.translate({c: c + 32 for c in range(65, 91)})
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in seen[2]) == sorted(last.values())
    rows = sorted(seen[2], key=lambda r: r.doc_id)
    parts, _ = brute_components([r.text for r in rows])
    assert sorted(r.doc_id for r in seen[3]) == sorted(rows[i].doc_id for i in set(parts))
    assert {r.doc_id for r in seen[4]} == {r.doc_id for r in seen[3]}  # none lost, some repeated
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in seen[4]}
    assert Counter(r.doc_id for r in seen[5]) == Counter(r.doc_id for r in seen[4])
    for r in seen[5]:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_queries_with_check_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op2_warc_round_trip", "op5_topk_inner_product", "op10_exact_dedup"):
        df = entry.queries()[name](spark, SF)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want)), name


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
