"""Near-duplicates by MinHash: an inverted join on signature coordinates, confirmed on full shingle sets.

Each document is posted under its (coordinate, value) pairs.  Two documents that agree in at least
MATCHES of COORDINATES coordinates must share one of the COORDINATES - MATCHES + 1 rarest pairs of
each (prefix filter), so only those are joined; unique pairs never join anything.  Documents joined
that way are compared cell by cell: agreeing coordinates are counted, pairs already connected are
skipped, and the rest is confirmed on the full sets.

A text that very many documents share, such as the footer of a site, gives them common coordinates
without making them similar.  Where more documents are joined than a block holds, they are joined once
more by their rarest shingles under the bounds of size and place that a similarity of 3/4 sets
(``refine``); only documents that meet there too are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from crashgrid.llm.memory import hand_back, lean
from crashgrid.llm.registry import query
from crashgrid.llm.rows import numbered, without_rows
from crashgrid.operators.graph.components import linked_components
from crashgrid.session import HOT_SHARE, cut, drop_cut

WORDS = 5
COORDINATES = 64
# At a similarity of 0.75 fewer than 28 of 64 coordinates agree once in some 20 million pairs.
MATCHES = 28
# A cell holds two blocks at most; blocks have about so many documents and shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19
HELD = 150_000
# Sizes of one band differ by this factor at most; rows of shingles leave a task so many at a time.
BAND, SHINGLE_ROWS = 1.1, 1 << 16
# Words of 64 bits that tell before a shuffle which texts may be asked for; so many rows are broadcast at most.
FILTER_WORDS = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = _mix(np.arange(1, 2 * COORDINATES + WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE, _FACTOR, _SALT = _STEPS[:WORDS] | np.uint64(1), _STEPS[WORDS:WORDS + COORDINATES] | np.uint64(1), _STEPS[WORDS + COORDINATES:]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: _WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: five words each, or all words where there are fewer.

    Words are runs of anything but space and control blanks, with A-Z lowered.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(h))
    sums = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        sums += h[i:i + len(sums)] * _PLACE[i]
    return np.unique(_mix(sums + np.uint64(n)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Coordinates of non-empty sets, a row each: 64-bit values that also tell coordinates apart."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    rows = np.empty((len(sets), COORDINATES), dtype=np.uint64)
    for k in range(COORDINATES):
        rows[:, k] = np.minimum.reduceat((flat ^ _SALT[k]) * _FACTOR[k], starts)
    return _mix(rows + _SALT)


def confirm(sets: list[np.ndarray], rows: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the sets' similarities of at least 3/4 connect, as a forest.

    ``side`` is 0 or 1 for a cell of two blocks, where only pairs across count, else 2 throughout.
    Sets that share most with others come first, so that pairs soon fall into one component and
    are skipped.
    """
    n = len(sets)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum([0, *map(len, sets)])
    sizes, mark = np.diff(starts), np.zeros(flat.max() + 1, dtype=bool)
    common = np.bincount(flat)
    weight = np.add.reduceat(common[flat], starts[:-1]) / sizes
    label, links = np.arange(n), []
    for a in np.argsort(-weight, kind="stable").tolist():
        near = (rows == rows[a]).sum(axis=1) >= MATCHES
        near &= (label != label[a]) & ((side == 2) | (side != side[a]))
        near &= (4 * sizes >= 3 * sizes[a]) & (4 * sizes[a] >= 3 * sizes)
        found = np.flatnonzero(near)
        if not len(found):
            continue
        mark[flat[starts[a]:starts[a + 1]]] = True
        lengths = sizes[found]
        firsts = np.cumsum(lengths) - lengths
        at = np.repeat(starts[found] - firsts, lengths) + np.arange(lengths.sum())
        shared = np.add.reduceat(mark[flat[at]].astype(np.int64), firsts)
        mark[flat[starts[a]:starts[a + 1]]] = False
        for b in found[100 * shared >= 75 * (sizes[a] + lengths - shared)].tolist():
            if label[b] != label[a]:
                links.append((a, b))
                label[label == label[b]] = label[a]
    return links


# -------------------------------------------------------------------------------- on Spark
def sketch(docs: DataFrame) -> DataFrame:
    """_row, doc_id, _text_hash, n_shingles, _set (digest of the shingle set) and _pairs (its coordinates).

    Sets that are empty have null for the last two.  A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                sets = [shingle_set(t, hashes) for t in b.column("text").to_pylist()]
                some = [s for s in sets if len(s)]
                values = iter(signatures(some).view(np.int64)) if some else iter(())
                yield pa.RecordBatch.from_arrays([
                    *(b.column(c) for c in ("_row", "doc_id", "_text_hash")), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(values) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], names=["_row", "doc_id", "_text_hash", "n_shingles", "_set", "_pairs"])

    number = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    source = docs.select(number.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_hash"), "text")
    return source.mapInArrow(lean(run), "_row long, doc_id long, _text_hash long, n_shingles long, _set binary, _pairs array<long>")


def prefixes(classes: DataFrame) -> DataFrame:
    """(id, pair): the pairs under which a class is posted.

    Of a class's pairs those that no other class has cannot match; with r others, all but its
    MATCHES - 1 most frequent ones are posted, and none where r is smaller than MATCHES.
    Counts are summed before the shuffle and stored, so that the join back may be split at pairs
    that very many classes have.
    """
    pairs = classes.filter("_pairs IS NOT NULL").select("id", F.explode("_pairs").alias("pair"))
    often = cut(pairs.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = pairs.join(often, "pair").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("p"))
    posted = F.slice("p", F.lit(1), F.greatest(F.size("p") - (MATCHES - 1), F.lit(0)))
    stored = cut(shared.select("id", F.explode(posted).alias("e")).select("id", "e.pair"))
    drop_cut(often)
    return stored


def may_be_asked_for(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``texts`` (_doc, _hash, text) without most of those that no member (id, _text_hash) asks for.

    Members set one bit each in FILTER_WORDS words.  Words with a bit are broadcast, so their number bounds
    it, and a text whose bit is not set stays where it is.  The more members, the more texts pass in vain;
    none that is asked for is lost.
    """

    def place(*columns):
        bit = F.pmod(F.xxhash64(*columns), F.lit(64 * FILTER_WORDS))
        return F.floor(bit / 64).cast("int").alias("_word"), (bit % 64).cast("int").alias("_bit")

    one = F.expr("shiftleft(1L, _bit)")
    words = members.select(*place("id.doc_id", "_text_hash")).groupBy("_word").agg(F.bit_or(one).alias("_bits"))
    placed = texts.select("*", *place("_doc", "_hash"))
    return placed.join(F.broadcast(words), "_word").filter(F.getbit("_bits", F.col("_bit")) == 1).drop("_word", "_bit", "_bits")


def with_text(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The members (id, _text_hash and more) with their ``text``; equal rows of ``docs`` each give one.

    Texts that no member asks for are mostly dropped before the shuffle.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"), "text")
    text = may_be_asked_for(text, members)
    return members.join(text, F.col("id.doc_id").eqNullSafe(text["_doc"]) & (members["_text_hash"] == text["_hash"])).drop("_doc", "_hash")


def large_components(members: DataFrame) -> DataFrame:
    """(component, blocks) of the components that one block does not hold."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    return cut(members.groupBy("component").agg(blocks.alias("blocks")).filter("blocks > 1"))


def shared_shingles(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, shared): those of a member's shingles that others have too, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            for row, text in zip(b.column("row"), b.column("text")):
                found = shingle_set(text.as_py(), hashes).view(np.int64)
                for k in range(0, len(found), SHINGLE_ROWS):
                    part = found[k:k + SHINGLE_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row.as_py())), pa.array(part)], names=["row", "shingle"])

    texts = with_text(members, docs).select(F.col("id._row").alias("row"), "text")
    rows = cut(texts.mapInArrow(lean(run), "row long, shingle long"))
    often = cut(rows.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1"))
    shared = F.sort_array(F.collect_set(F.struct("often", "shingle")))["shingle"].alias("shared")
    result = cut(rows.join(often, "shingle").groupBy("row").agg(shared))
    drop_cut(rows, often)
    return result


def refine(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, component): components of the members that may be similar, by their rarest shingles.

    Sets of n and m shingles with a similarity of 3/4 have 3/7 (n + m) in common.  With the shingles of
    all sets in one order, rarest first, the first common one has at least as many from its place on in
    both.  So a set is posted, for each band of sizes that a similar set may have, under the shingles
    early enough for the smallest size of the band.  What no other set has takes the first places and
    is not posted: sets that share less than they need, however many they are, meet nowhere.  Members of
    one band are linked with the smallest of them, those of two bands with the smallest of the other band.
    Members go by the row of their id, postings by a hash of shingle and bands, so that little is moved.
    """
    shared = shared_shingles(members, docs)
    sets = shared.join(members.select(F.col("id._row").alias("row"), F.col("n_shingles").alias("n")), "row")

    def band(n):
        return F.floor(F.log(n) / F.log(F.lit(BAND))).cast("int")

    n, smallest = F.col("n"), F.floor(F.pow(F.lit(BAND), "other") * (1 - 1e-9))
    wide = sets.select("*", band(n).alias("own"), F.explode(F.sequence(band(F.ceil(n * 3 / 4)), band(F.floor(n * 4 / 3)))).alias("other"))
    need = F.floor((3 * (n + smallest) + 6) / 7)
    early = F.greatest(F.size("shared") - need + 1, F.lit(0)).cast("int")
    side = F.signum(F.col("own") - F.col("other")).cast("int").alias("side")
    spread = wide.select("row", "own", "other", side, F.explode(F.slice("shared", F.lit(1), early)).alias("shingle"))
    posted = cut(spread.select("row", F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "side"))
    firsts = [F.min(F.when(F.col("side") == k, F.col("row"))).alias(c) for k, c in ((-1, "low"), (0, "same"), (1, "high"))]
    heads = cut(posted.groupBy("key").agg(*firsts, F.count("*").alias("sets"))
                .filter("sets > 1 AND (same IS NOT NULL OR low IS NOT NULL AND high IS NOT NULL)").drop("sets"))
    head = F.when(F.col("side") == 0, F.col("same")).when(F.col("side") == 1, F.col("low")).otherwise(F.col("high"))
    touching = posted.join(heads, "key").select(F.col("row").alias("a"), head.alias("b")).filter("a <> b").distinct()
    closer = linked_components(touching).withColumnRenamed("id", "row")
    drop_cut(shared, posted, heads)
    return closer


def link_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links that connect all classes (id, n_shingles, _text_hash, _pairs) that similar pairs connect.

    Classes that share a posted pair form candidate components, found with one link from each class
    to the smallest of the pair; those too large for a block are refined by their shingles.  A component is cut into blocks of bounded size, every two of them
    make a cell, and each cell is one group: bounded memory, at most one link a member as output.
    Only texts of candidate classes reach the cells.
    """
    posted = prefixes(classes)
    heads = cut(posted.groupBy("pair").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").select("pair", "b"))
    touching = posted.join(heads, "pair").select(F.col("id").alias("a"), "b").distinct()
    parts = cut(linked_components(touching))
    drop_cut(posted, heads)
    members = cut(parts.join(classes.select("id", "n_shingles", "_text_hash", "_pairs"), "id"))
    drop_cut(parts)
    large = large_components(members)
    if not large.isEmpty():
        closer = cut(refine(members.join(large, "component", "left_semi"), docs))
        rest = members.join(large, "component", "left_anti").withColumn("component", F.col("component._row"))
        near = members.drop("component").join(closer, F.col("id._row") == closer["row"]).drop("row")
        again = cut(rest.unionByName(near))
        drop_cut(members, large, closer)
        members, large = again, large_components(again)
    found = with_text(members, docs).select("id", "component", "_pairs", "text")
    dealt = found.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})

    def cell(table: pa.Table) -> pa.Table:
        hashes, ids = _WordHashes(), table["id"].to_pylist()
        first = {tuple(i.values()): k for k, i in reversed(list(enumerate(ids)))}  # a text may come from several equal rows
        keep = sorted(first.values())
        texts = table["text"]
        sets = [shingle_set(texts[k].as_py(), hashes) for k in keep]
        rows = np.array([table["_pairs"][k].as_py() for k in keep], dtype=np.int64)
        block = table["block"].to_numpy()[keep]
        same = table["x"][0].as_py() == table["y"][0].as_py()
        side = np.full(len(keep), 2) if same else (block == table["y"][0].as_py()).astype(int)
        links = confirm(sets, rows, side) if len(keep) > 1 else []
        del texts, sets, rows, hashes
        if len(keep) > 256:
            hand_back()
        kind = table["id"].type
        return pa.table({"a": pa.array([ids[keep[a]] for a, _ in links], kind), "b": pa.array([ids[keep[b]] for _, b in links], kind)})

    id_kind = classes.schema["id"].dataType.simpleString()
    columns = ["id", "component", "_pairs", "text", "block", "x", "y"]
    links = cut(dealt.select(columns).groupBy("component", "x", "y").applyInArrow(cell, f"a {id_kind}, b {id_kind}"))
    drop_cut(members, large)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, _row, n_shingles, component_id, _component_row of every document.

    Documents are linked when their shingle sets have a similarity of 0.75 or more; the component is
    named by its smallest doc_id (nulls last) and the row that has it (the first read, where ids
    repeat).  Documents without words are linked with nothing.  A column ``_row`` of distinct numbers
    is used if there is one; other columns are ignored.  An empty table gives no rows.

    Equal sets become one class before anything is joined, so copies cost one row each.  Sets with
    over 1/HOT_SHARE of the rows, fewer than HOT_SHARE, are joined back by broadcast.
    """
    rows = cut(sketch(docs))
    alone = rows.filter("_set IS NULL")
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    classes = cut(rows.filter("_set IS NOT NULL").groupBy("_set").agg(
        F.min(me).alias("id"), F.count("*").alias("size"), F.first("n_shingles").alias("n_shingles"),
        F.min_by("_text_hash", me).alias("_text_hash"), F.first("_pairs").alias("_pairs")))
    known = cut(linked_components(link_classes(classes, docs)))
    named = classes.select("_set", "id", "size").join(known, "id", "left").select("_set", "size", F.coalesce("component", "id").alias("head"))
    named = cut(named)
    total = rows.count()
    hot = named.filter(F.col("size") * HOT_SHARE > total).drop("size")
    slim = rows.filter("_set IS NOT NULL").select("_row", "doc_id", "n_shingles", "_set")
    tagged = slim.join(F.broadcast(hot.withColumnRenamed("head", "hot_head")), "_set", "left")
    easy = tagged.filter("hot_head IS NOT NULL").withColumnRenamed("hot_head", "head")
    rest = tagged.filter("hot_head IS NULL").drop("hot_head").join(named.drop("size"), "_set")
    both = easy.unionByName(rest).select("doc_id", "_row", "n_shingles", F.col("head.doc_id").alias("component_id"), F.col("head._row").alias("_component_row"))
    result = cut(both.unionByName(alone.select("doc_id", "_row", "n_shingles", F.col("doc_id").alias("component_id"), F.col("_row").alias("_component_row"))))
    drop_cut(rows, classes, known, named)
    return result


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with one of each component left: that of its smallest doc_id.

    Only the numbers of dropped rows meet the documents.
    """
    stored = numbered(docs)
    found = near_duplicates(stored)
    kept = without_rows(stored, found.filter("_row <> _component_row"))
    drop_cut(found)
    return kept


@query("op6_minhash_near_dedup", "documents")
def op6_minhash_near_dedup(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
