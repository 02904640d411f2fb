"""Alignment of two tokenizers' tokens by interval coalescing, and how often ids meet across a corpus.

All tokens of both tokenizers are intervals of bytes.  They are sorted by start, the maximum of the ends so
far is accumulated, and a group breaks where a start reaches it; within the groups every token is expanded
into the tokens of the other side that it overlaps (its links).  Many documents are aligned at once, laid
end to end.

A document leaves its distinct (A id, B id) pairs, each with its number of links.  Pairs are summed within
tasks and then over the corpus.  The most frequent pairs, HELD_PAIRS at most, are broadcast; the pairs that
a document has besides are joined with their counts by a shuffle, in which no key is frequent.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F

from crashgrid.llm.bpe import byte_letters, read_tokenizer
from crashgrid.llm.registry import query
from crashgrid.session import cut, drop_cut

HELD_PAIRS = 1 << 20
CHUNK_BYTES = 1 << 20  # of texts aligned at once, unless one text is longer
SUMMED_PAIRS = 1 << 21  # pairs that a task sums at once
SEPARATORS = ["", ",", "|", ";"]  # after a token: nothing, its side goes on, the other side, another group


def merged_ends(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and of every B interval, numbered from 0 in order of bytes."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((end, start))
    furthest = np.maximum.accumulate(end[order])
    breaks = np.empty(len(order), dtype=np.int64)
    breaks[:1] = 0
    breaks[1:] = start[order[1:]] >= furthest[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks)
    return group[:len(start_a)], group[len(start_a):]


def expand(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all overlapping pairs; intervals of one side follow each other."""
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    counts = high - low
    firsts = np.cumsum(counts) - counts
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) + np.repeat(low - firsts, counts)


class Aligner:
    """Both tokenizers with their ids' bytes and decimal names."""

    def __init__(self, byte_bpe: bytes, piece_model: bytes):
        file, letters = json.loads(byte_bpe), {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): k for word, k in file["model"]["vocab"].items() if word not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        bytes_a = [b""] * (max(ranks.values()) + 1)
        for word, k in ranks.items():
            bytes_a[k] = word
        bytes_b = []
        for k in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(k)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        self.bytes = [pa.array(x, pa.binary()) for x in (bytes_a, bytes_b)]
        self.sizes = [np.array([len(w) for w in x]) for x in (bytes_a, bytes_b)]
        self.width = len(bytes_b)  # pair = A id * width + B id
        self.ids = max(map(len, (bytes_a, bytes_b)))
        self.names = pa.array([f"{k}{s}" for s in SEPARATORS for k in range(self.ids)], pa.string())

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A ids of space + text and B ids of the text; none where a side does not give the bytes back."""
        a = [self.a.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) if t else np.zeros(0, np.int64) for t in texts]
        b = [np.fromiter(x, np.int64, len(x)) for x in self.b.encode(texts, num_threads=1)] if texts else []
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            for side, ids in enumerate((a[k], b[k])):
                if not t or not self._gives(side, ids, whole):
                    a[k] = b[k] = np.zeros(0, np.int64)
                    break
        return a, b

    def _gives(self, side: int, ids: np.ndarray, whole: bytes) -> bool:
        return int(self.sizes[side][ids].sum()) == len(whole) and self.bytes[side].take(pa.array(ids)).buffers()[2].to_pybytes()[:len(whole)] == whole

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest of the groups, distinct pairs, links of each) of every text."""
        a, b = self.tokens(texts)
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        at_a, at_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        flat_a, flat_b = np.concatenate(a), np.concatenate(b)
        if not len(flat_a):
            return [(0, 0, 0, 0, "", flat_a, flat_a) for _ in texts]
        start_a, end_a = merged_ends(self.sizes[0][flat_a])
        start_b, end_b = merged_ends(self.sizes[1][flat_b])
        group_a, group_b = coalesce(start_a, end_a, start_b, end_b)

        # places in the output: a group's A ids, then its B ids
        groups = int(group_a[-1]) + 1
        many_a, many_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(flat_a)) + (np.cumsum(many_b) - many_b)[group_a]
        place_b = np.arange(len(flat_b)) + np.cumsum(many_a)[group_b]
        codes = np.empty(len(flat_a) + len(flat_b), dtype=np.int64)
        codes[place_a] = flat_a + self.ids
        codes[place_b] = flat_b + self.ids
        codes[place_a[np.append(group_a[1:] != group_a[:-1], True)]] += self.ids
        last_b = place_b[np.append(group_b[1:] != group_b[:-1], True)]
        codes[last_b] += 2 * self.ids
        stops = (at_a + at_b)[1:]
        some = np.flatnonzero(n_a)
        codes[stops[some] - 1] -= 3 * self.ids
        text = self.names.take(pa.array(codes))
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[:len(codes) + 1]
        letters = memoryview(text.buffers()[2])

        link_a, link_b = expand(start_a, end_a, start_b, end_b)
        owner = np.repeat(np.arange(len(texts)), n_a)[link_a]
        pairs = flat_a[link_a] * self.width + flat_b[link_b]
        span = len(self.bytes[0]) * self.width
        distinct, times = np.unique(owner * span + pairs, return_counts=True)
        cuts = np.searchsorted(distinct, np.arange(len(texts) + 1) * span)
        n_links = np.bincount(owner, minlength=len(texts))
        out = []
        for k in range(len(texts)):
            if not n_a[k]:
                out.append((0, 0, 0, 0, "", flat_a[:0], flat_a[:0]))
                continue
            here = slice(cuts[k], cuts[k + 1])
            digest = hashlib.sha256(letters[offsets[stops[k] - n_a[k] - n_b[k]]:offsets[stops[k]]]).hexdigest()
            out.append((int(n_a[k]), int(n_b[k]), int(group_a[at_a[k + 1] - 1] - group_a[at_a[k]]) + 1, int(n_links[k]), digest, distinct[here] - k * span, times[here]))
        return out


@lru_cache(maxsize=1)
def _aligner(byte_bpe: bytes, piece_model: bytes) -> Aligner:
    return Aligner(byte_bpe, piece_model)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


# -------------------------------------------------------------------------------- on Spark
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, byte_bpe: bytes, piece_model: bytes) -> DataFrame:
    """_row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every document."""
    files = docs.sparkSession.sparkContext.broadcast((byte_bpe, piece_model))
    names = ["_row", "doc_id", *FIGURES, "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        for b in batches:
            at = 0
            for part in _chunks([t or "" for t in b.column("text").to_pylist()]):
                rows, here = aligner.align(part), b.slice(at, len(part))
                at += len(part)
                *figures, digests, pairs, times = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [here.column("_row"), here.column("doc_id"), *(pa.array(f, pa.int64()) for f in figures), pa.array(digests, pa.string()),
                     _lists(pairs, pa.int64()), _lists(times, pa.int64())], names=names)

    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, f"_row long, doc_id long, {', '.join(f'{f} long' for f in FIGURES)}, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(documents: DataFrame, width: int) -> DataFrame:
    """pair, n (links over all documents), best (whether no pair of its B id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, size = [], [], 0

        def summed() -> pa.RecordBatch:
            keys, place = np.unique(np.concatenate(pairs), return_inverse=True)
            n = np.zeros(len(keys), dtype=np.int64)
            np.add.at(n, place, np.concatenate(times))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

        for b in batches:
            pairs.append(b.column("pairs").flatten().to_numpy())
            times.append(b.column("times").flatten().to_numpy())
            size += len(pairs[-1])
            if size > SUMMED_PAIRS:
                yield summed()
                pairs, times, size = [], [], 0
        if size:
            yield summed()

    counts = cut(documents.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    with_b = counts.withColumn("_b", F.col("pair") % width)
    highest = with_b.groupBy("_b").agg(F.max("n").alias("_top"))  # at most one row an id of the vocabulary
    result = cut(with_b.join(F.broadcast(highest), "_b").select("pair", "n", (F.col("n") == F.col("_top")).alias("best")))
    drop_cut(counts)
    return result


def frequent(counts: DataFrame, held: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """(pairs, n, best) of the pairs above some count, at most ``held`` of them, and the other pairs."""
    step = F.floor(8 * F.log2("n"))
    least, total = None, 0
    for s, n in sorted(((r[0], r[1]) for r in counts.groupBy(step).count().collect()), reverse=True):
        total += n
        if total > held:
            break
        least = s
    chosen = counts.filter(step >= least) if least is not None else counts.limit(0)
    rows = chosen.orderBy("pair").toArrow()
    return rows["pair"].to_numpy(), rows["n"].to_numpy(), rows["best"].to_numpy(), counts.filter(step < least) if least is not None else counts


def scores(documents: DataFrame, counts: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """_row, n_best and count_sum of every document: over its links, how many have a best pair, and the sum of counts."""
    *top, others = frequent(counts, held)
    shared = documents.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for b in batches:
            pairs, times = (b.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            sizes = np.diff(b.column("pairs").offsets.to_numpy())
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            at = at[known]
            sums, bests = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
            sums[known], bests[known] = times[known] * n[at], times[known] * best[at]
            kept = pa.array(np.concatenate([[0], np.cumsum(total((~known).astype(np.int64)))]), pa.int32())
            left = [pa.ListArray.from_arrays(kept, pa.array(x[~known], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(total(sums)), pa.array(total(bests)), *left], names=["_row", "count_sum", "n_best", "pairs", "times"])

    known = cut(documents.select("_row", "pairs", "times").mapInArrow(run, "_row long, count_sum long, n_best long, pairs array<long>, times array<long>"))
    rare = known.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    found = rare.join(others, "pair").groupBy("_row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return known.select("_row", "count_sum", "n_best").join(found, "_row", "left").select("_row", total("n_best", "more_best"), total("count_sum", "more"))


def align(docs: DataFrame, byte_bpe: bytes | None = None, piece_model: bytes | None = None, held: int = HELD_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    A is a byte-level BPE file (its ids of space + text), B a sentencepiece model with a leading space;
    special tokens' strings in a text are plain text.  A null or empty text, and one whose bytes either
    side does not give back, has no tokens: zeros and the empty string.  Repeated ids keep their rows;
    other columns are ignored.  An empty table gives no rows.
    """
    byte_bpe, piece_model = byte_bpe or read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), piece_model or read_tokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    documents = cut(aligned(docs, byte_bpe, piece_model))
    counts = pair_counts(documents, _aligner(byte_bpe, piece_model).width)
    return documents.join(scores(documents, counts, held), "_row").select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")


@query("op11_align_tokenizers", "documents")
def op11_align_tokenizers(documents: DataFrame) -> DataFrame:
    return align(documents)
