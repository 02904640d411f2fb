"""The similarity join against all pairs, and its classes."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from crashgrid.operators.graph import similar


def _graph(spark, seed, reports, hot):
    """Reports with persons, a crime type and sometimes a place; one crime type has most of them."""
    r = random.Random(seed)
    edges = set()
    for i in range(reports):
        edges |= {(f"F{i:03}", f"P{r.randrange(25)}") for _ in range(r.randrange(0, 4))}
        edges.add((f"F{i:03}", "C0" if r.random() < hot else f"C{r.randrange(1, 4)}"))
        if r.random() < 0.6:
            edges.add((f"F{i:03}", f"L{r.randrange(6)}"))
    kind = {"F": "FIR", "P": "Person", "C": "CrimeType", "L": "Location"}
    ids = {x for e in edges for x in e}
    v = spark.createDataFrame([(x, kind[x[0]], None) for x in ids], "id string, node_type string, vehicle_number string")
    return v, spark.createDataFrame(sorted(edges), "src string, dst string"), edges


@pytest.mark.parametrize("threshold", [0.3, 0.5, 2 / 3, 1.0])
def test_all_pairs_above_the_threshold(spark, threshold):
    v, e, edges = _graph(spark, 3, 120, 0.7)
    own = {}
    for a, b in edges:
        own.setdefault(a, set()).add(b)
    heads = {}
    for a in sorted(own):
        heads.setdefault(frozenset(own[a]), a)
    names = {"P": "SAME_PERSON", "C": "SAME_CRIME_TYPE", "L": "SAME_LOCATION"}
    expected = set()
    for x, a in heads.items():
        for y, b in heads.items():
            score = Fraction(len(x & y), len(x | y))
            if a > b and score >= Fraction(threshold).limit_denominator(10_000):
                expected.add((a, b, ",".join(sorted({names[k[0]] for k in x & y})), round(float(score), 4)))
    got = [tuple(r) for r in similar.similar_reports(v, e, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and (expected or threshold == 1.0)
    links = e.select("src", F.col("dst").alias("entity"))
    assert {tuple(r) for r in similar.report_classes(links).collect()} == {(a, heads[frozenset(s)], len(s)) for a, s in own.items()}


def test_frequent_entities_meet_only_where_they_decide(spark):
    """A crime type that every report has is not posted by sets that need a second entity in common."""
    rows = [(f"F{i:04}", [("P%d" % i, 1), ("Q%d" % i, 1), ("C", 3000)]) for i in range(3000)]
    sets = spark.createDataFrame([(s, [(n, x, "K") for x, n in o]) for s, o in rows], "src string, own array<struct<often:long,entity:string,relation_type:string>>")
    met = similar.similar_sets(sets, Fraction(1, 2))
    assert met.count() == 0
    first = sets.select(F.slice("own", 1, F.size("own") - 2 + 1).alias("p")).select(F.explode("p.entity").alias("x"))
    assert Counter(r.x for r in first.collect())["C"] == 0


def test_classes_that_differ_in_lone_entities_only_are_one_kind(spark, monkeypatch):
    """Persons of one report alone are not stored, and pairs within a kind and of two kinds come from blocks of ids."""
    monkeypatch.setattr(similar, "BLOCK", 4)
    edges = [(f"F{i:02}", x) for i in range(30) for x in ("L0", "C0", f"P{i}")]
    edges += [(f"G{i:02}", x) for i in range(12) for x in ("L0", "C0", f"Q{i}", f"R{i}")] + [("H", "L0"), ("H", "C0"), ("I", "L1"), ("I", "S")]
    own = {}
    for a, b in edges:
        own.setdefault(a, set()).add(b)
    links = spark.createDataFrame([(a, b, "K") for a, b in edges], "src string, entity string, relation_type string")
    sets = {r["src"]: (sorted(x["entity"] for x in r["own"]), r["lone"], r["n"]) for r in similar.report_sets(links, Fraction(1, 2)).collect()}
    assert sets["F00"] == (["C0", "L0"], 1, 3) and sets["G00"] == (["C0", "L0"], 2, 4) and "I" not in sets
    kind = {"F": "FIR", "G": "FIR", "H": "FIR", "I": "FIR", "L": "Location", "C": "CrimeType"}
    v = spark.createDataFrame([(x, kind.get(x[0], "Person"), None) for x in {x for e in edges for x in e}], "id string, node_type string, vehicle_number string")
    got = similar.similar_reports(v, spark.createDataFrame(edges, "src string, dst string"), 0.5).collect()
    expected = {(a, b, round(len(own[a] & own[b]) / len(own[a] | own[b]), 4)) for a in own for b in own
                if a > b and 2 * len(own[a] & own[b]) >= len(own[a] | own[b])}
    assert len(got) == len(expected) and {(r["src"], r["dst"], r["similarity_score"]) for r in got} == expected
    assert {r["relation_type"] for r in got} == {"SAME_CRIME_TYPE,SAME_LOCATION"}


def test_bad_threshold(spark):
    v, e, _ = _graph(spark, 1, 3, 0.5)
    with pytest.raises(ValueError):
        similar.similar_reports(v, e, 0)
