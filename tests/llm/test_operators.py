"""Operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crashgrid.llm import exact_dedup, minhash, mixing, pii, sharding, topk, toxicity, warc
from crashgrid.session import scratch_path

DOCS = "doc_id long, text string, source string, _row_ string, n string"


def docs(spark, texts, schema=DOCS, parts=3):
    rows = [(i, t, f"s{i % 3}", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(parts)


# ------------------------------------------------------------------------------ 1: PII
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(out)]


def pii_texts(seed):
    r = random.Random(seed)
    def card():
        body = "".join(r.choice("0123456789") for _ in range(15))
        return next(body + c for c in "0123456789" if pii.luhn(body + c))
    make = [lambda: f"u{r.randrange(99)}.x@mail{r.randrange(9)}.example.com", lambda: ".".join(str(r.randrange(300)) for _ in range(4)), card,
            lambda: f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}", lambda: "".join(r.choice("0123456789") for _ in range(16)), lambda: "wörd", lambda: "a.b@c", lambda: "1.2.3.4.5"]
    return [" ".join(r.choice([*make, *[lambda: "filler"] * 6])() for _ in range(r.randrange(1, 30))) for _ in range(250)]


def test_pii_base_spans_and_recovered_ones(spark):
    texts = [None, "", "é" * 9, "a_b@c.d_e@f.g", "x@y.z@w.v", "@ @a.b", "+1 (826) 555-4081 190.137.223.204", "9" * 3000, *pii_texts(1)]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(spark, texts)).collect()}
    added = 0
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == base_spans(t or ""), t
        for s in got[i]:
            if not s.base:
                added += 1
                assert all(s.end <= b.start or b.end <= s.start for b in got[i] if b.base)
                assert s.kind == "email" or pii.valid(pii.KINDS.index(s.kind), t[s.start:s.end])
    assert added > 0 and ("phone", 0, 17) in [(s.kind, s.start, s.end) for s in got[6]]
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[0] is None and clean[3] == "[EMAIL][EMAIL]" and clean[2] == texts[2]
    assert pii.find_pii(docs(spark, texts).limit(0)).count() == 0


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.integers(0, 4, (3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 1) & (x[:, 3] < 2)).astype(int)
    assert (((pii.Boosted().fit(x[:2000], y[:2000]).predict(x[2000:]) > 0.5) == y[2000:]).mean()) > 0.99


def test_pii_learns_from_all_candidates_however_they_are_split(spark):
    texts = [f"{t} call a{i}@b.example or 10.0.{i % 256}.{i * 7 % 256}" for i, t in enumerate(pii_texts(3) * 12)]
    labels = sum(int((pii.examine(t)[1][:, 3] >= 0).sum()) for t in texts)
    assert (np.concatenate([pii.examine(t)[1] for t in texts])[:, 0] == pii.EMAIL).sum() > 2500
    one, many = (pii.train(pii.candidates(docs(spark, texts, parts=n))) for n in (1, 5))
    assert one.rows == many.rows == labels and one.thresholds == many.thresholds
    assert all(np.array_equal(a, b) for s, t in zip(one.model.nodes, many.model.nodes, strict=True) for a, b in zip(s, t))


def test_quantiles_of_counted_values():
    x = np.random.default_rng(1).integers(0, 9, 500).astype(float)
    q = np.linspace(0, 1, 32)
    assert np.allclose(pii.quantiles(*np.unique(x, return_counts=True), q), np.quantile(x, q))


# ----------------------------------------------------------------------------- 2: WARC
def test_warc_round_trip_in_small_ranges(spark):
    body = ["x" * 150, None, "", "y" * 99, "é" * 60, "z" * 5000]
    rows = [(i, f"http://h/{i}\r\nX: 1%0A", body[i % 6], "clash") for i in range(30)] + [(30, None, "solo " * 40, "clash"), (None, "u", "x" * 150, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").repartition(3)
    files = warc.write_archives(pages, scratch_path(spark, "warc"), file_bytes=2000)
    assert files.count() > 3
    got = {r.page_id: r for r in warc.read_archives(files, split_bytes=300, payloads=True).collect()}
    assert len(got) == len(rows)
    for page, url, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "").encode() == data and p is not None]
        revisit = len(data) >= 100 and page != min(same)
        r = got[page]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", min(same)) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == data
    empty = warc.write_archives(pages.limit(0), scratch_path(spark, "warc"))
    assert warc.read_archives(empty).count() == 0


# ------------------------------------------------------------------------- 3: toxicity
def brute_segments(s):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    best = max(((sum(s[a:b]), a - b, -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a, b = best[3:]
    return brute_segments(s[:a]) + [(a, b, best[0])] + [(x + b, y + b, v) for x, y, v in brute_segments(s[b:])]


def test_segments_are_the_maximal_ones():
    r = random.Random(2)
    for _ in range(300):
        s = [r.choice([-5, -3, -2, -1, 1, 2, 4]) + r.random() / 64 for _ in range(r.randrange(14))]
        got = toxicity.segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(s)]


def test_scores_of_tokens_stay_finite():
    toxic, clean = (np.zeros(toxicity.BUCKETS + 1, dtype=np.float32) for _ in range(2))
    toxic[toxicity.slots("vile")], toxic[-1], clean[toxicity.slots("mild")], clean[-1] = 1e9, 1e9, 1e9, 9e9
    s = toxicity.TokenScores(toxic, clean).of("vile mild new " * 20)
    assert np.isfinite(s).all() and s[0] > 5 > 0 > s[1]
    x = toxicity.calibrate(np.array([0.0, 9.0] * 50), np.full(100, 60), lambda c: np.zeros(100), np.array([0.0, 1.0] * 50))
    assert np.isfinite(x.weights).all()


def test_toxicity_sums_stored_segment_scores_as_scoring_does():
    """The excess summed from segment scores alone is that of a text's passages, bit by bit."""
    r = np.random.default_rng(7)
    cal = toxicity.Calibration(0.8, -1.5, np.zeros(3))
    for words in (0, 1, 40, 3000):
        scores = r.normal(-0.4, 2.0, words)
        values = np.array([v for _, _, v in toxicity.segments(scores)], dtype=float)
        assert cal.summed(values, words) == cal.passages(scores)[2]


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    texts, marks = [None, "", "!?"], [0, 0, 0]
    for _ in range(600):
        toxic = r.random() < 0.2
        t = [r.choice(words) for _ in range(r.randrange(20, 300))]
        for _ in range(3 if toxic else 0):
            t.insert(r.randrange(len(t)), "vile" + r.choice(["", "xo", "ry", "ck"]))
        texts.append(" ".join(t))
        marks.append(int(toxic))
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    df = docs(spark, texts)
    model = toxicity.train(df, labels)
    got = {x.doc_id: x for x in toxicity.score(df, model, passages=True).collect()}
    test = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i].score >= 0.7) == bool(marks[i]) for i in test)
    assert right / len(test) > 0.95 and all(0 <= x.score <= 1 for x in got.values())
    for i in test:
        assert all("vile" in texts[i][p.start:p.end] for p in got[i].passages if p.p < 1e-4)
    kept = {x.doc_id for x in toxicity.keep_clean(df, labels).collect()}
    assert kept == {i for i, x in got.items() if x.score < 0.7} and {0, 1, 2} <= kept
    assert toxicity.score(df.limit(0), model).count() == 0
    nothing = toxicity.train(df, labels.limit(0))
    assert toxicity.score(df, nothing).filter("score >= 0.7").count() == 0


# ------------------------------------------------------------------------- 4: sharding
@pytest.mark.parametrize("n", [1, 2, 5, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation_with_inverse(n):
    f = sharding.Feistel(n, seed=n)
    y = f.forward(np.arange(n))
    assert sorted(y.tolist()) == list(range(n)) and (f.inverse(y) == np.arange(n)).all()


def test_shards(spark):
    texts = [None, "", "same", "same", "é" * 2000] + [f"t{i}" for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "rep")] * 40 + [(None, "null id")]
    make = lambda k: spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash")).repartition(k)
    a, b = ([tuple(r) for r in sharding.shard(make(k)).collect()] for k in (1, 7))
    assert sorted(map(str, a)) == sorted(map(str, b))
    per = Counter(r[4] for r in a)
    assert max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r[5] for r in a if r[4] == s) == list(range(c)) for s, c in per.items())
    by = {r[0]: r for r in a}
    assert by[0][1:3] == (1, 0) and by[4][1] == 4001 and by[2][2] == zlib.crc32(b"same")
    path = scratch_path(spark, "shards")
    sharding.write_shards(make(3), path)
    back = spark.read.parquet(path)
    assert back.count() == len(rows) and back.groupBy("shard").count().count() == 16
    assert sharding.shard(make(2).limit(0)).count() == 0


# ---------------------------------------------------------------------------- 5: top-k
def test_top_k_equals_brute_force(spark, monkeypatch):
    r = random.Random(6)
    vec = lambda: [r.choice([0.0, 0.0, r.uniform(-1, 1)]) for _ in range(r.randrange(9))]
    rows = [(i, vec()) for i in range(300)] + [(7, [0.5, 0.5]), (7, [0.5, 0.5]), (None, [1.0]), (301, None), (302, [None]), (303, [float("nan")]), (304, [float("inf")]), (400, [])]
    monkeypatch.setattr(topk, "CANDIDATE_ELEMENTS", 500)
    monkeypatch.setattr(topk, "QUERY_ELEMENTS", 20)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = defaultdict(list)
    for x in topk.top_k(df, F.col("vec_id") % 10 == 0).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in good:
        if i is not None and i % 10 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), j is None, j, ) for j, w in good if j != i]
            want = [(k + 1, j, -s) for k, (s, _, j) in enumerate(sorted(scores, key=lambda t: (t[0], t[1], t[2] or 0))[:10])]
            assert sorted(got.pop(i)) == want
    assert not got
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30]), (1, [1e30]), (2, [-1e30]), (3, [1.0])]
    got = {x.vec_id: x.score for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    assert got[1] == 2**63 - 1 and got[2] == -(2**63) and got[3] == 2**63 - 1


# -------------------------------------------------------------------------- 6: minhash
def near_texts(seed):
    r = random.Random(seed)
    prose = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(40)) for _ in range(n)]
    texts = [None, "", " \n\t", "One two", "one TWO", "ÉA b c d e f", "éa b c d e f", "x " * 3000]
    for _ in range(12):
        base = prose(r.randrange(20, 200))
        for _ in range(r.randrange(1, 9)):
            t = list(base)
            for _ in range(r.randrange(0, len(t) // 12)):
                t[r.randrange(len(t))] = "changed"
            texts.append(" ".join(t))
    hub = prose(120)
    for _ in range(60):  # one large group at the edge of the similarity
        t = list(hub)
        for _ in range(r.randrange(0, 5)):
            t[r.randrange(len(t))] = f"c{r.randrange(999)}"
        texts.append(" ".join(t))
    return texts


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))
    def find(x):
        return x if parent[x] == x else find(parent[x])
    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(x) for x in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("seed,rows", [(1, minhash.BLOCK_ROWS), (2, 8)])
def test_near_duplicates_equal_brute_force(spark, seed, rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    texts = near_texts(seed)
    df = docs(spark, texts)
    want, sizes = brute_components(texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def footer_texts(n, own, footer):
    """Texts of their own words with a common end; and copies of every 500th with one word changed."""
    texts = [" ".join([f"w{i}x{j}" for j in range(own)] + [f"f{j}" for j in range(footer)]) for i in range(n)]
    return texts + [t.replace(f"x{own // 2} ", "changed ") for t in texts[::500]]


def test_texts_with_a_common_footer_meet_nowhere_unless_similar(spark):
    texts = footer_texts(3000, 80, 150)
    df = docs(spark, texts)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == {**{i: i for i in range(3000)}, **{3000 + k: 500 * k for k in range(6)}}
    rows = minhash.sketch(df.withColumn("_row", F.col("doc_id")))
    members = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("id"), "n_shingles", "_text_hash")
    closer = {r.row: r.component for r in minhash.refine(members, df).collect()}
    assert closer == {**{500 * k: 500 * k for k in range(6)}, **{3000 + k: 500 * k for k in range(6)}}


def test_texts_no_member_asks_for_are_dropped_before_the_shuffle(spark):
    docs = spark.createDataFrame([(i if i % 97 else None, f"text {i}" if i % 89 else None) for i in range(3000)], "doc_id long, text string")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), "text")
    asked = texts.limit(200).select(F.struct(F.col("_doc").alias("doc_id")).alias("id"), F.col("_hash").alias("_text_hash"))
    passed = {(r._doc, r.text) for r in minhash.may_be_asked_for(texts, asked).collect()}
    wanted = {(r.id.doc_id, r.text) for r in minhash.with_text(asked, docs).collect()}
    assert len(wanted) == 200 and wanted <= passed and len(passed) < 210
    assert minhash.with_text(asked.limit(0), docs).count() == 0


def test_near_duplicates_of_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A B C D E F"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(r.component_id for r in minhash.near_duplicates(df).collect()) == [1, 1, 1, 3, 3]
    assert minhash.keep_one(df).count() == 3
    assert minhash.near_duplicates(df.limit(0)).count() == 0


# --------------------------------------------------------------------------- 8: mixing
def test_mix_meets_entropy_and_quotas(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 40))), "hot" if i % 3 else f"s{i % 7}", 0) for i in range(3000)]
    rows += [(5000, None, "hot", 0), (5001, "", None, 0), (5002, "one two", None, 0), (5002, "one two", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(4)
    plan = [x.asDict() for x in mixing.plan_mix(df, target_entropy=0.97, max_repeats=None).collect()]
    assert len(plan) == len(rows)
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())
    entropy = lambda a: (lambda w: -sum(x * np.log(x) for x in w))(np.array([(n / total) ** a for n in tokens.values()]) / sum((n / total) ** a for n in tokens.values())) / np.log(len(tokens))
    exponent = plan[0]["exponent"]
    assert 0 < exponent < 1 and abs(entropy(exponent) - 0.97) < 1e-6 and entropy(1.0) < 0.97
    budget = max(n * sum((m / total) ** exponent for m in tokens.values()) / (n / total) ** exponent for n in tokens.values())
    for s, n in tokens.items():
        quota = budget * (n / total) ** exponent / sum((m / total) ** exponent for m in tokens.values())
        dealt = sum(x["n_tokens"] * x["copies"] for x in plan if x["source"] == s)
        assert quota - 1 <= dealt <= quota + 41, s
        assert {x["copies"] for x in plan if x["source"] == s and x["n_tokens"]} <= {quota // n, quota // n + 1, round(quota / n)}
    assert all(x["copies"] == 1 for x in plan if not x["n_tokens"])
    limited = mixing.plan_mix(df, target_entropy=1.0, max_repeats=3.0).agg(F.max("copies")).first()[0]
    assert limited <= 3
    small = mixing.plan_mix(df, target_entropy=None, max_repeats=None, budget=total / 2).agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert abs(small - total / 2) < 41 * len(tokens)
    out = mixing.mix_documents(df, target_entropy=0.97, max_repeats=None)
    assert out.columns == df.columns and out.count() == sum(x["copies"] for x in plan)
    assert mixing.plan_mix(df.limit(0)).count() == 0


# ---------------------------------------------------------------------- 10: exact dedup
def test_exact_dedup_and_its_index(spark):
    texts = [None, "", "Same É", "same É", "same é", "X" * 5000, "x" * 5000]
    df = docs(spark, texts).unionByName(docs(spark, texts[:3])).withColumn("kept", F.lit("clash"))
    rows = exact_dedup.exact_dedup(df).collect()
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = Counter(low(t) for t in texts + texts[:3])
    last = {low(t): i for i, t in enumerate(texts)}
    for r in rows:
        t = low(texts[r.doc_id])
        assert (r.keep_id, r.group_size, r.text_sha256) == (last[t], groups[t], hashlib.sha256(t.encode()).hexdigest())
    assert sum(r.kept for r in rows) == len(groups)  # one row also where the id repeats
    kept = exact_dedup.keep_distinct(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(last.values())
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_digest_index_across_batches(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_test")
    index.drop()
    a = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a"), (8, "c"), (9, "c")], "doc_id long, text string")
    state = lambda df, name: sorted((r.doc_id, r.keep_id, r.kept) for r in index.deduplicate(df, name).collect())
    first = state(a, "a")
    assert first == [(1, 2, False), (2, 2, True), (3, 3, True)]
    assert state(b, "b") == [(7, 2, False), (8, 9, False), (9, 9, True)]
    assert state(a, "a") == first  # a batch run again finds its own rows
    assert spark.table("digest_index_test").count() == 3
    plan = a.join(spark.table("digest_index_test").hint("merge"), F.sha2("text", 256) == F.col("text_sha256"), "left_anti")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the index is not shuffled
    index.drop()


def test_first_batch_takes_the_anti_join(spark, monkeypatch):
    plans, real = [], exact_dedup.cut
    monkeypatch.setattr(exact_dedup, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    rows = exact_dedup.exact_dedup(docs(spark, ["a", "A", "b"])).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in rows) == [(0, 1, False), (1, 1, True), (2, 2, True)]
    assert any("SortMergeJoin" in p and "LeftAnti" in p and "digest_index_" in p for p in plans)


def test_pii_windows_end_at_the_digit_limit_only():
    def proposed(t):
        return {(k, t[a:b]) for k, a, b in pii.proposals(t, pii.base_matches(t))}

    card = " ".join("4111111111111111")
    assert (pii.CARD, card) in proposed(f"+1 826 555 4081 {card}")
    assert (pii.PHONE, "+49 30 12 34 56 78 9") in proposed("+49 30 12 34 56 78 9 190.137.223.204")
    got = proposed("(+1) 826 555-4081 190.137.223.204")
    assert (pii.PHONE, "+1) 826 555-4081") in got and (pii.PHONE, "(+1) 826 555-4081") in got
    assert len(proposed("+(" * 500 + "1" + " 1" * 500)) < 20_000


def test_calibration_sums_all_passages_and_measures_repeats_once(spark, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    texts = [" ".join(some(r.randrange(20, 200))) for _ in range(120)]
    texts += [" ".join(w for _ in range(40) for w in [*some(30), "vile", "vilexo", "vilery"]) for _ in range(30)]
    df = docs(spark, texts)
    df = df.unionByName(df.filter("doc_id = 0").crossJoin(spark.range(200)).drop("id"))
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(150)], "doc_id long, toxic int")
    seen, real = [], toxicity.calibrate

    def spy(best, n, totals, y):
        def kept(cal):
            seen.append((cal, best, n, y, totals(cal)))
            return seen[-1][-1]
        return real(best, n, kept, y)

    monkeypatch.setattr(toxicity, "calibrate", spy)
    toxicity.train(df, labels)
    cal, best, n, y, total = seen[0]
    usable = [i for i in range(150) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(best) == len(usable)
    assert (total[y > 0] > 20.5 * cal.excess(best, n)[y > 0]).any()  # a sum over 20 segments is less
