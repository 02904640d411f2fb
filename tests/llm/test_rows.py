"""Rows by number: the pipeline's stages neither copy nor shuffle the texts of a stored table."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crashgrid.llm import exact_dedup, minhash, mixing, rows
from crashgrid.session import scratch_root


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Long texts of random words in several files, with copies, near copies and repeated rows."""
    r = random.Random(27)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(400)) for _ in range(500)]
    texts += [t.upper() for t in texts[:40]] + [t + " end" for t in texts[40:90]] + [None, "", None]
    data = [(i, t, f"s{i % 3 if i % 5 else 0}", i % 7) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("rows") / "documents.parquet")
    kinds = "doc_id long, text string, source string, _value int"  # a column with a name that is used inside
    spark.createDataFrame(data + data[:3], kinds).withColumnRenamed("_value", "n_chars").repartition(7).write.parquet(path)
    return spark.read.parquet(path), sum(f.stat().st_size for f in Path(path).glob("*.parquet"))


def scratch_bytes(spark):
    root = scratch_root(spark).removeprefix("file:")
    return sum(f.stat().st_size for f in Path(root).rglob("*") if f.is_file())


@pytest.mark.parametrize("stage", [exact_dedup.keep_distinct, minhash.keep_one, mixing.mix_documents])
def test_stages_neither_copy_nor_shuffle_stored_texts(spark, stored, stage):
    table, size = stored
    before = scratch_bytes(spark)
    out = stage(table)
    assert scratch_bytes(spark) - before < size / 4
    plan = re.sub(r"#\d+L?", "", out._jdf.queryExecution().executedPlan().toString())
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert out.columns == table.columns and out.count() > 500


def test_numbers_do_not_depend_on_the_plan(spark, stored):
    table, _ = stored
    first = Counter((r._row, r.doc_id) for r in rows.numbered(table).select("_row", "doc_id").collect())
    assert max(Counter(n for n, _ in first).values()) == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        again = rows.numbered(table).filter("doc_id % 2 = 0").select("doc_id", "text", "_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert Counter((r._row, r.doc_id) for r in again) == {k: n for k, n in first.items() if k[1] % 2 == 0}


@pytest.mark.parametrize("most", [rows.MOST_WORDS, 0])
def test_marked_rows(spark, stored, most, monkeypatch):
    monkeypatch.setattr(rows, "MOST_WORDS", most)
    table, _ = stored
    frames = [table, table.unionByName(table), spark.range(300).toDF("doc_id"), table.limit(0), table.withColumn("doc_id", F.explode(F.array(F.lit(1), F.col("doc_id"))))]
    for df in frames:
        number = rows.numbered(df)
        if most:
            number = number.localCheckpoint()
        seen = [(r._row, r.doc_id) for r in number.select("_row", "doc_id").collect()]
        assert len(seen) == len({n for n, _ in seen}) == df.count()
        copies = {n: k % 6 for k, (n, _) in enumerate(sorted(seen))}
        marks = spark.createDataFrame(list(copies.items()), "_row long, _value long")
        got = rows.repeat_rows(number, marks)
        assert got.columns == df.columns
        want = Counter()
        for n, i in seen:
            want[i] += copies[n]
        assert Counter(r.doc_id for r in got.select("doc_id").collect()) == +want
        left = rows.without_rows(number, marks.filter("_value = 0"))
        assert Counter(r.doc_id for r in left.select("doc_id").collect()) == Counter(i for n, i in seen if copies[n])
