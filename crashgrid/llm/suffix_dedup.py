"""Removal of repeated passages: suffixes sorted by hash-compared common extensions.

Every window of WINDOW bytes has an anchor, the position whose GRAM bytes have the smallest hash in
it, so equal windows have equal anchors at equal places.  Only anchors whose gram occurs again are
looked at: the bytes around such positions are sorted as suffixes in a mergesort, whose comparisons
find the common extension by binary search over prefix polynomial hashes.  Runs of suffixes with a
long common extension, told apart further by the hash of what stands left of the anchor, are the
repeats; the first and last repeated window of each anchor are verified byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crashgrid.llm.registry import query
from crashgrid.session import HOT_SHARE, cut, drop_cut

WINDOW, GRAM = 200, 32
PRIME, BASES = np.uint64(2**31 - 1), (1_299_709, 1_000_003_261)
SEGMENT = 1 << 18  # bytes hashed at a time; longer texts overlap by a window
LARGE_GROUP = 20_000  # occurrences of a gram up to which they are sorted in one task
SORT_BYTES = 3 << 20  # of contexts sorted at a time; hashes take some thirty times as much


# -------------------------------------------------------------- prefix polynomial hashes
def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    """base ** 0, 1, ... modulo the prime, 2 ** bits of them."""
    out, step = np.ones(1, dtype=np.uint64), base
    for _ in range(bits):
        out = np.concatenate([out, _mod(out * np.uint64(step))])
        step = step * step % int(PRIME)
    return out.astype(np.uint32)


class PrefixHashes:
    """Hash of any substring of a piece in constant time; equal bytes have equal hashes in any buffer.

    ``place`` is each byte's place in its piece; a power of the base for each place is all that is
    tabulated, so pieces are short (SEGMENT) or very short (the bytes around an anchor).
    """

    def __init__(self, data: np.ndarray, place: np.ndarray):
        bits = max(10, int(place.max(initial=0)).bit_length())
        self.place, self.sums = place, []
        self.back = [_powers(pow(base, -1, int(PRIME)), bits) for base in BASES]
        for base in BASES:
            powers, carry, sums = _powers(base, bits), np.uint64(0), np.zeros(len(data) + 1, dtype=np.uint32)
            for i in range(0, len(data), SEGMENT):  # bytes count from 1
                part = slice(i, i + SEGMENT)
                terms = powers[place[part]].astype(np.uint64) * (data[part].astype(np.uint64) + np.uint64(1))
                total = _mod(np.cumsum(_mod(terms)) + carry)
                sums[1 + i:1 + i + len(total)], carry = total, total[-1]
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray, parts: int = 2) -> np.ndarray:
        """62-bit hashes of data[start:end]; with ``parts`` = 1 the first 31 bits' half only."""
        shift = self.place[np.minimum(start, len(self.place) - 1)]
        h = [_mod(_mod(s[end].astype(np.uint64) + PRIME - s[start]) * b[shift]) for s, b in zip(self.sums[:parts], self.back)]
        return h[0] if parts == 1 else h[0] << np.uint64(31) | h[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


# ------------------------------------------------------------------------------- anchors
def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, position, least, most, gram hash): the windows that start least to most bytes before a position belong to it."""
    pieces = [(i, at, t[at:at + SEGMENT + WINDOW - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - WINDOW + 1), SEGMENT) if len(t) >= WINDOW]
    found: list[tuple] = []
    batch, size = [], 0
    for p in [*pieces, None]:
        if batch and (p is None or size + len(p[2]) > SEGMENT + WINDOW):
            found.append(_anchors(batch))
            batch, size = [], 0
        if p is not None:
            batch.append(p)
            size += len(p[2])
    return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.array([], dtype=np.int64) for _ in range(5))


def _anchors(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    hashes = PrefixHashes(data, np.arange(len(data), dtype=np.int32) - np.repeat(ends - sizes, sizes).astype(np.int32))
    at = np.arange(len(data) - GRAM + 1)
    low = np.uint64(2**24 - 1)
    ranked = (_mix(hashes.of(at, at + GRAM, 1)) & ~low) | at.astype(np.uint64)
    width, span, best = WINDOW - GRAM + 1, 1, ranked
    while span * 2 <= width:
        best, span = np.minimum(best[:-span], best[span:]), span * 2
    n = len(ranked) - width + 1
    best = np.minimum(best[:n], best[width - span:width - span + n])  # leftmost smallest gram of each window
    piece = np.repeat(np.arange(len(pieces)), sizes)[:n]
    starts = np.flatnonzero(np.arange(n) + WINDOW <= ends[piece])
    anchor, piece = (best[starts] & low).astype(np.int64), piece[starts]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
    last = np.append(new[1:], len(starts)) - 1
    position, owner = anchor[new], piece[new]
    gram = hashes.of(position, position + GRAM)
    offset = np.array([p[1] for p in pieces]) - (ends - sizes)
    return (np.array([p[0] for p in pieces])[owner], position + offset[owner], position - starts[last], position - starts[new], _mix(gram).view(np.int64))


# --------------------------------------------------------------------------- suffix sort
class Suffixes:
    """Bytes around anchors of several groups, as suffixes that start at the anchors."""

    def __init__(self, group: np.ndarray, contexts: list[bytes], most: np.ndarray):
        self.group, self.data = group, np.frombuffer(b"".join(contexts), dtype=np.uint8)
        sizes = np.array([len(c) for c in contexts])
        self.end = np.cumsum(sizes)
        self.at = self.end - sizes + most
        self.hashes = PrefixHashes(self.data, np.arange(len(self.data), dtype=np.int32) - np.repeat(self.end - sizes, sizes).astype(np.int32))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes, by binary search over hashes."""
        lo, hi = np.zeros(len(a), dtype=np.int64), np.minimum(self.end[a] - self.at[a], self.end[b] - self.at[b])
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.hashes.of(self.at[a], self.at[a] + mid) == self.hashes.of(self.at[b], self.at[b] + mid)
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b (a shorter one before its continuations, ties by number)."""
        common = self.extension(a, b)
        a_ends, b_ends = self.at[a] + common >= self.end[a], self.at[b] + common >= self.end[b]
        top = len(self.data) - 1
        differ = self.data[np.minimum(self.at[a] + common, top)] < self.data[np.minimum(self.at[b] + common, top)]
        return np.where(a_ends & b_ends, a < b, np.where(a_ends | b_ends, a_ends, differ))

    def sort(self) -> np.ndarray:
        """Order of the suffixes within each group: a bottom-up mergesort of all groups side by side.

        An element's place in a merged run is its own rank plus its rank in the sibling run, found by
        binary search, so each comparison costs the logarithm of a context's length.
        """
        order = np.argsort(self.group, kind="stable")
        sorted_group = self.group[order]
        first = np.searchsorted(sorted_group, sorted_group, side="left")
        size = np.searchsorted(sorted_group, sorted_group, side="right") - first
        inside, run = np.arange(len(order)) - first, 1
        while run < size.max(initial=1):
            busy = np.flatnonzero(size > run)
            pair = inside[busy] // (2 * run) * (2 * run)
            is_right = (inside[busy] - pair) >= run
            limit = size[busy]
            lo = np.where(is_right, pair, np.minimum(pair + run, limit))
            hi = np.where(is_right, np.minimum(pair + run, limit), np.minimum(pair + 2 * run, limit))
            begin = lo.copy()
            me = order[busy]
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                before = self.less(order[first[busy][open_] + mid], me[open_])
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            own = inside[busy] - np.where(is_right, pair + run, pair)
            merged = order.copy()
            merged[first[busy] + pair + own + (lo - begin)] = me
            order, run = merged, run * 2
        return order


def repeated(group: np.ndarray, contexts: list[bytes], least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(shortest, longest) distance before its anchor at which a window of each occurrence repeats; -1 for none.

    Occurrences of one group share the gram at their anchor; ``contexts`` run from the first window's
    start to the last one's end.
    """
    s, n = Suffixes(group, contexts, most), len(group)
    order = s.sort()
    g, a = group[order], s.at[order]
    common = np.append(0, s.extension(order[:-1], order[1:])) if n else np.array([], dtype=np.int64)
    common[np.append(True, g[1:] != g[:-1])] = -1
    lo, hi = least[order], most[order]
    out, mate = np.full((n, 2), -1, dtype=np.int64), np.full((n, 2), -1, dtype=np.int64)
    for distance in range(int(lo.min(initial=0)), int(hi.max(initial=-1)) + 1):
        run = np.cumsum(common < WINDOW - distance)  # equal from the anchor to the window's end
        has = np.flatnonzero((lo <= distance) & (distance <= hi))
        if len(has) < 2:
            continue
        left = s.hashes.of(a[has] - distance, a[has])  # equal from the window's start to the anchor
        key = _mix(left) ^ _mix(run[has].astype(np.uint64) + np.uint64(1 << 40))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        first, second = has[by[:-1][same]], has[by[1:][same]]
        for x, y in ((first, second), (second, first)):
            fresh = out[x, 0] < 0
            out[x[fresh], 0], mate[x[fresh], 0] = distance, y[fresh]
            out[x, 1], mate[x, 1] = distance, y
    for side in (0, 1):  # verification: the windows really are equal
        some = np.flatnonzero(out[:, side] >= 0)
        for part in np.array_split(some, max(1, len(some) // 4_000)):
            i, d = a[part] - out[part, side], np.arange(WINDOW)
            j = a[mate[part, side]] - out[part, side]
            if (s.data[i[:, None] + d] != s.data[j[:, None] + d]).any():
                return _repeated_by_bytes(group, contexts, least, most)
    result = np.empty_like(out)
    result[order] = out
    return result


def _repeated_by_bytes(group, contexts, least, most) -> np.ndarray:
    """The same from the windows themselves, for the case that two different ones share a hash."""
    seen: dict[tuple, int] = {}
    windows = [(int(g), d, c[m - d:m - d + WINDOW]) for g, c, lo, m in zip(group, contexts, least.tolist(), most.tolist()) for d in range(lo, m + 1)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    out, at = np.full((len(group), 2), -1, dtype=np.int64), 0
    for i, (lo, m) in enumerate(zip(least.tolist(), most.tolist())):
        hits = [d for d in range(lo, m + 1) if seen[windows[at + d - lo]] > 1]
        at += m - lo + 1
        if hits:
            out[i] = hits[0], hits[-1]
    return out


# -------------------------------------------------------------------------------- on Spark
def _key() -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"), text.alias("text")]


def _list_anchors(texts: DataFrame) -> DataFrame:
    """(h, n, grams, places) of each text; within a batch equal texts give one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = {k: i for i, k in enumerate(zip(b.column("h").to_pylist(), b.column("n").to_pylist()))}
            every, text = [k for k in known if k[1] >= WINDOW], b.column("text")
            for at in range(0, len(every), 200):
                keys = every[at:at + 200]
                owner, position, _, _, gram = anchors([text[known[k]].as_py().encode() for k in keys])
                cuts = np.searchsorted(owner, np.arange(len(keys) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v, t)) for v, t in ((gram, pa.int64()), (position, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), *lists], names=["h", "n", "grams", "places"])

    return texts.mapInArrow(run, "h long, n int, grams array<long>, places array<int>")


CONTEXT = "gram long, h long, n int, place int, least int, most int, context binary, large boolean"


def _contexts(touched: DataFrame) -> DataFrame:
    """The bytes around each repeated anchor of (h, n, text, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CONTEXT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                texts = [t.encode() for t in b.column("text").to_pylist()]
                h, n = b.column("h").to_pylist(), b.column("n").to_pylist()
                hits = [{x["gram"]: x["large"] for x in row} for row in b.column("hits").to_pylist()]
                rows = []
                for i, place, least, most, gram in zip(*(c.tolist() for c in anchors(texts))):
                    if gram in hits[i]:
                        rows.append((gram, h[i], n[i], place, least, most, texts[i][place - most:place - least + WINDOW], hits[i][gram]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, kinds)], names=names)

    return touched.mapInArrow(run, CONTEXT)


SPAN = "h long, n int, begin int, stop int"


def _spans(rows: list[pa.Table]) -> pa.RecordBatch:
    t = pa.concat_tables(rows)
    column = lambda c: t[c].to_numpy()
    least, most, place = column("least").astype(np.int64), column("most").astype(np.int64), column("place").astype(np.int64)
    out = repeated(column("gram"), t["context"].to_pylist(), least, most)
    some = np.flatnonzero(out[:, 1] >= 0)
    begin, stop = place[some] - out[some, 1], place[some] - out[some, 0] + WINDOW
    return pa.RecordBatch.from_arrays([pa.array(column("h")[some]), pa.array(column("n")[some]), pa.array(begin, pa.int32()), pa.array(stop, pa.int32())], names=["h", "n", "begin", "stop"])


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """Repeated spans of the groups of a partition that is sorted by gram; whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(t.nbytes for t in held) < SORT_BYTES:
                continue
            t = pa.concat_tables(held)
            whole = int(np.searchsorted(t["gram"].to_numpy(), t["gram"][-1].as_py()))
            if whole:
                yield _spans([t.slice(0, whole)])
            held = [t.slice(whole)]
        if held:
            yield _spans(held)

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, SPAN)


def _large_groups(contexts: DataFrame) -> DataFrame:
    """Repeated spans of grams that occur very often: each window is a row, counted before the shuffle."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d = np.arange(r["least"], r["most"] + 1)
                digest = [hashlib.blake2b(r["context"][r["most"] - x:r["most"] - x + WINDOW], digest_size=16).digest() for x in d.tolist()]
                m = len(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, r["h"])), pa.array(np.full(m, r["n"]), pa.int32()), pa.array(r["place"] - d, pa.int32()), pa.array(digest, pa.binary())], names=["h", "n", "begin", "w"])

    rows = cut(contexts.mapInArrow(windows, "h long, n int, begin int, w binary"))
    again = cut(rows.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w"))
    return rows.join(again, "w").select("h", "n", "begin", (F.col("begin") + WINDOW).cast("int").alias("stop"))


def _cut_out(text: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, what is left) for overlapping spans."""
    kept, at, removed, runs = [], 0, 0, 0
    for s in sorted(spans, key=lambda s: s["begin"]):
        begin, stop = max(s["begin"], at), s["stop"]
        if s["begin"] > at or not runs:
            kept.append(text[at:s["begin"]])
            runs += 1
        if stop > begin:
            removed += stop - begin
            at = stop
    kept.append(text[at:])
    return removed, runs, b"".join(kept)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Exchange at most ``rows`` rows at a time with Python workers: whole texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def repeated_texts(docs: DataFrame, large_group: int = LARGE_GROUP) -> DataFrame:
    """(h, n, n_removed, n_spans, kept, copies) of the distinct texts that lose bytes.

    ``kept`` is what is left.  A text that other rows repeat loses all, if it has a window.  Texts are
    told by hash and length; equal ones meet before the shuffle and are then one row.
    """
    texts = docs.select(*_key())
    listed = cut(_list_anchors(texts))
    pairs = listed.select("h", "n", F.explode(F.arrays_zip("grams", "places")).alias("e")).select("h", "n", F.col("e.grams").alias("gram"), F.col("e.places").alias("place"))
    occurrence = F.xxhash64("h", "n", "place")
    again = cut(pairs.groupBy("gram").agg(F.min(occurrence).alias("x"), F.max(occurrence).alias("y"), F.count("*").alias("c")).filter("x <> y").select(
        "gram", (F.col("c") > large_group).alias("large")))
    hits = pairs.join(again, "gram").groupBy("h", "n").agg(F.collect_set(F.struct("gram", "large")).alias("hits"))
    distinct = texts.groupBy("h", "n").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    touched = cut(distinct.join(hits, ["h", "n"], "left").filter(f"n >= {WINDOW} AND (hits IS NOT NULL OR copies > 1)"))
    any_large = not again.filter("large").isEmpty()
    drop_cut(listed, again)
    found = touched.filter("hits IS NOT NULL").select("h", "n", "text", "hits")
    spans = _sorted_groups(_contexts(found).filter("NOT large"))
    if any_large:
        spans = spans.unionByName(_large_groups(_contexts(found.filter("exists(hits, x -> x.large)")).filter("large")))
    merged = cut(spans.groupBy("h", "n").agg(F.collect_set(F.struct("begin", "stop")).alias("spans")))
    joined = touched.select("h", "n", "text", "copies").join(merged, ["h", "n"], "left").filter("copies > 1 OR spans IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):
            rows = []
            for text, copies, spans in zip(*(b.column(c).to_pylist() for c in ("text", "copies", "spans"))):
                data = text.encode()
                rows.append((len(data), 1, b"") if copies > 1 else _cut_out(data, spans))
            removed, runs, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("n"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), b.column("copies")],
                                             names=["h", "n", "n_removed", "n_spans", "kept", "copies"])

    return joined.mapInArrow(run, "h long, n int, n_removed long, n_spans long, kept binary, copies long")


def _join_texts(rows: DataFrame, lost: DataFrame, total: int) -> DataFrame:
    """Rows (h, n, ...) with what their text loses; texts with over 1/HOT_SHARE of the rows are broadcast."""
    hot = F.broadcast(lost.filter(F.col("copies") * HOT_SHARE > total).withColumn("_hot", F.lit(True)))
    tagged = rows.join(hot, ["h", "n"], "left")
    rest = tagged.filter("_hot IS NULL").select(*rows.columns).join(lost.filter(F.col("copies") * HOT_SHARE <= total), ["h", "n"], "left")
    return tagged.filter("_hot").drop("_hot").unionByName(rest)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` less every byte of a repeated window, and n_removed; other columns pass.

    Bytes that are left but no longer form a character become the replacement character.
    """
    with small_batches(docs.sparkSession):
        lost = cut(repeated_texts(docs))
    lost = lost.select(F.col("h").alias("_h"), F.col("n").alias("_n"), F.col("n_removed").alias("_removed"), F.col("kept").alias("_kept"))
    h, n, _ = _key()
    joined = docs.withColumns({"_h": h, "_n": n}).join(lost, ["_h", "_n"], "left")
    clean = F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.make_valid_utf8(F.col("_kept").cast("string")))
    return joined.withColumns({"text": clean, "n_removed": F.coalesce("_removed", F.lit(0))}).select(*[c for c in docs.columns if c != "n_removed"], "n_removed")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; a null text counts as empty."""
    with small_batches(docs.sparkSession):
        lost = cut(repeated_texts(docs).select("h", "n", "n_removed", "n_spans", F.sha2("kept", 256).alias("lost_sha256"), "copies"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"), F.sha2(text, 256).alias("sha256")))
    joined = _join_texts(rows, lost, rows.count())
    return joined.select(
        "doc_id", F.col("n").cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("lost_sha256", "sha256").alias("kept_sha256"))


@query("op9_suffix_dedup", "documents")
def op9_suffix_dedup(documents: DataFrame) -> DataFrame:
    return repeat_report(documents)
