"""BPE with word ends: frequent words from a memory-mapped acyclic transducer, all others merged exactly.

The tokenizer file (normal form C, lower case, word pattern, byte-level symbols with a word-end
suffix, ranked merges) is given by path; nothing is trained.  Which words are in the transducer
changes the speed only, never the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import struct
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from crashgrid.llm.memory import lean
from crashgrid.llm.registry import query
from crashgrid.session import cut, drop_cut

LEXICON_WORDS = 50_000
# Words of more bytes are merged one by one with a heap, shorter ones many at a time.
LONG_WORD = 48
# So many characters of text are split at once (or one text that is longer); words and ids remembered take so many bytes.
SPLIT_CHARS, HELD_BYTES = 1 << 20, 1 << 22
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Ids of words by exact merging, straight from the tokenizer file's content."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters])
        self.final = np.array([vocab[c + end] for c in letters])
        pairs = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, merges))]
        self.ranks = {(a, b): (rank, ab) for a, b, rank, ab in pairs}
        table = np.array(pairs)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank, self.key_id = keys[order], table[order, 2], table[order, 3]

    def words(self, text: str) -> list[str]:
        """The words and special tokens of a text, in order."""
        if any(mark in text for mark in self.special):
            parts = self.marks.split(text)
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._plain(p))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text.isascii():
            # letters are lowered one by one, so the end of a word does not change a sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return WORDS.findall(text.lower())

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        data = [w.encode() for w in words]
        out: list[np.ndarray | None] = [None] * len(words)
        short = sorted((i for i, d in enumerate(data) if len(d) <= LONG_WORD), key=lambda i: len(data[i]))
        for a in range(0, len(short), 20_000):
            part = short[a:a + 20_000]
            for i, ids in zip(part, self._merge_many([data[i] for i in part])):
                out[i] = ids
        for i, d in enumerate(data):
            if out[i] is None:
                out[i] = self._merge_one(d)
        return out

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted merges, or -1."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _merge_many(self, data: list[bytes]) -> list[np.ndarray]:
        """Leftmost merge of lowest rank, again and again, in all words at once."""
        n, sizes = len(data), np.array([len(d) for d in data])
        width = int(sizes.max(initial=1))
        raw = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), dtype=np.uint8).reshape(n, width)
        ids = self.inner[raw].astype(np.int64)
        ids[np.arange(n), sizes - 1] = self.final[raw[np.arange(n), sizes - 1]]
        never = len(self.keys)
        done = np.empty(n, dtype=object)
        rows, alive = np.arange(n), sizes.copy()
        places = self._lookup(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 0), -1)
        places[np.arange(1, width)[None, :] >= sizes[:, None]] = -1
        rank = np.where(places >= 0, self.key_rank[places], never)
        while rows.size:
            if rank.shape[1] == 0:
                best, can = None, np.zeros(rows.size, dtype=bool)
            else:
                best = rank.argmin(axis=1)
                can = rank[np.arange(rows.size), best] < never
            for r, i in zip(rows[~can].tolist(), np.flatnonzero(~can).tolist()):
                done[r] = ids[i, :alive[i]].astype(np.uint32)
            if not can.any():
                break
            rows, alive, ids, rank, places, best = rows[can], alive[can], ids[can], rank[can], places[can], best[can]
            m = np.arange(rows.size)
            merged = self.key_id[places[m, best]]
            # everything right of the merged pair moves one place to the left
            cols = np.arange(ids.shape[1] - 1)
            ids = np.where(cols[None, :] <= best[:, None], ids[:, :-1], ids[:, 1:])
            ids[m, best] = merged
            cols = np.arange(rank.shape[1] - 1)
            left = cols[None, :] < best[:, None]
            rank, places = np.where(left, rank[:, :-1], rank[:, 1:]), np.where(left, places[:, :-1], places[:, 1:])
            alive = alive - 1
            for at, ok in ((best - 1, best > 0), (best, best < alive - 1)):  # the pairs beside the new symbol
                i = np.flatnonzero(ok)
                found = self._lookup(ids[i, at[i]], ids[i, at[i] + 1])
                places[i, at[i]] = found
                rank[i, at[i]] = np.where(found >= 0, self.key_rank[found], never)
        return list(done)

    def _merge_one(self, data: bytes) -> np.ndarray:
        """The same for one long word: a heap of merges over a linked list of symbols."""
        ids = self.inner[np.frombuffer(data, dtype=np.uint8)].tolist()
        ids[-1] = int(self.final[data[-1]])
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*self.ranks[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.ranks]
        heap = [(rank, i, ab, a, b) for rank, ab, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, ab, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = ab, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in self.ranks:
                    rank, new = self.ranks[p]
                    heapq.heappush(heap, (rank, x, new, *p))
        return np.array([x for x in ids if x >= 0], dtype=np.uint32)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the tokens' names with spaces between: this tokenizer file names no decoder."""
        return b" ".join(map(self.names.__getitem__, ids))


# --------------------------------------------------------------------------- the lexicon
def compile_lexicon(words: list[str], ids: list[np.ndarray]) -> bytes:
    """Minimal acyclic transducer of the words as one block of integers.

    States with the same right language are one (suffixes are shared).  Each arc carries the number
    of words that sort before its branch, so the sum along a word's path is its rank, which gives
    the place of its ids.  Layout: five counts, then arc keys (state * 256 + byte, sorted), arc
    targets, arc outputs, final flags, offsets of ids, ids.
    """
    entries = sorted((w.encode(), i) for w, i in zip(words, ids))
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    sizes: list[int] = []
    states: list[tuple] = []

    def freeze(node: list) -> int:
        """The number of the state that equals ``node`` = [final, {byte: state}]."""
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(states)
            states.append(key[1])
            finals.append(node[0])
            sizes.append(node[0] + sum(sizes[t] for t in node[1].values()))
        return register[key]

    path: list[list] = [[False, {}]]
    last = b""
    for word, _ in entries:
        shared = len(os.path.commonprefix((last, word)))
        while len(path) > shared + 1:  # what left the path is complete
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = freeze(node)
        path += [[False, {}] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1][last[len(path) - 1]] = freeze(node)
    root = freeze(path[0])
    keys, targets, outputs = [], [], []
    for s, arcs in enumerate(states):
        before = int(finals[s])
        for byte, target in arcs:
            keys.append(s << 8 | byte)
            targets.append(target)
            outputs.append(before)
            before += sizes[target]
    offsets = np.cumsum([0, *[len(i) for _, i in entries]])
    flat = np.concatenate([i for _, i in entries]) if entries else np.array([])
    parts = [keys, targets, outputs, np.array(finals, dtype=int), offsets, flat]
    head = struct.pack("<8i", root, *map(len, parts), 0)
    return head + b"".join(np.asarray(p).astype("<i4").tobytes() for p in parts)


class Lexicon:
    """The compiled transducer, memory-mapped."""

    def __init__(self, file: str):
        data = np.memmap(file, dtype="<i4", mode="r")
        self.root, sizes = int(data[0]), data[1:7]
        ends = 8 + np.cumsum(sizes)
        self.keys, self.targets, self.outputs, self.finals, self.offsets, self.ids = (
            data[e - s:e] for e, s in zip(ends, sizes))

    def ranks(self, words: list[str]) -> np.ndarray:
        """Rank of each word in the lexicon, -1 for others: all words walk their arcs side by side."""
        data = [w.encode() for w in words]
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        rows = np.array([i for i, d in enumerate(data) if len(d) <= LONG_WORD], dtype=np.int64)
        sizes = np.array([len(data[i]) for i in rows], dtype=np.int64)
        width = int(sizes.max(initial=0))
        raw = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in rows), dtype=np.uint8).reshape(len(rows), width)
        state, total = np.full(len(rows), self.root, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for j in range(width + 1):
            ended = sizes == j
            hit = ended & (self.finals[state] == 1)
            out[rows[hit]] = total[hit]
            rows, sizes, raw, state, total = (x[~ended] for x in (rows, sizes, raw, state, total))
            if not rows.size:
                break
            key = state << 8 | raw[:, j]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            rows, sizes, raw, at, total = (x[ok] for x in (rows, sizes, raw, at, total))
            state, total = self.targets[at].astype(np.int64), total + self.outputs[at]
        return out

    def of_rank(self, rank: int) -> np.ndarray:
        return self.ids[self.offsets[rank]:self.offsets[rank + 1]].astype(np.uint32)


def few(texts: list[str], rows: int = 256) -> Iterator[list[str]]:
    """The texts in order, at most ``rows`` at a time and SPLIT_CHARS characters, unless one alone is longer."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and (len(part) == rows or size + len(t) > SPLIT_CHARS):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


class Encoder:
    """Texts to ids, with a memory of the words met lately (at most ``held``, and HELD_BYTES, when texts are split)."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon, held: int = 100_000):
        self.tokenizer, self.lexicon, self.held = tokenizer, lexicon, held
        self.known: dict[str, bytes] = {}
        self.size = 0

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        for part in few(texts):
            split = [self.tokenizer.words(t) for t in part]
            if len(self.known) > self.held or self.size > HELD_BYTES:
                self.known.clear()
                self.size = 0
            self._learn(sorted(set().union(*split) - self.known.keys()))
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))

    def _learn(self, words: list[str]) -> None:
        for mark, i in self.tokenizer.special.items():
            self.known[mark] = struct.pack("<I", i)
        words = [w for w in words if w not in self.tokenizer.special]
        ranks = self.lexicon.ranks(words).tolist()
        unseen = [w for w, r in zip(words, ranks) if r < 0]
        self.known.update((w, self.lexicon.of_rank(r).tobytes()) for w, r in zip(words, ranks) if r >= 0)
        self.known.update((w, i.tobytes()) for w, i in zip(unseen, self.tokenizer.merge(unseen)))
        self.size += sum(len(w) + len(self.known[w]) for w in words)


@lru_cache(maxsize=1)
def _tokenizer(content: bytes) -> Tokenizer:
    return Tokenizer(content)


@lru_cache(maxsize=1)
def _encoder(content: bytes, file: str) -> Encoder:
    """One a worker process, kept from task to task."""
    return Encoder(_tokenizer(content), Lexicon(SparkFiles.get(file)))


# -------------------------------------------------------------------------------- on Spark
def word_counts(docs: DataFrame, content: bytes, held: int = 200_000) -> DataFrame:
    """(word, n) over all texts.  Tasks count up to ``held`` words at a time before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, counts = _tokenizer(content), Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        for b in batches:
            for text in b.column(0):
                if text.is_valid:
                    counts.update(tokenizer.words(text.as_py()))
                if len(counts) > held:
                    yield flush()
                    counts.clear()
        yield flush()

    return docs.select("text").mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def read_tokenizer(path: str | None = None) -> bytes:
    """Content of a tokenizer file; without a path, of the public one of 49k tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def ship_lexicon(docs: DataFrame, content: bytes, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of the documents; returns the file's name on all executors.

    Words enter by steps of their count (eight for each doubling), as long as no more than ``words``
    come to the driver.  Words met once, of over LONG_WORD bytes, and special tokens stay out.
    """
    spark, tokenizer = docs.sparkSession, _tokenizer(content)
    counts = word_counts(docs, content).filter((F.octet_length("word") <= LONG_WORD) & ~F.col("word").isin(list(tokenizer.special)))
    counts = cut(counts.filter("n > 1").withColumn("step", F.floor(8 * F.log2("n"))))
    enough, total = None, 0
    for step, n in sorted(((r[0], r[1]) for r in counts.groupBy("step").count().collect()), reverse=True):
        total += n
        if total > words:
            break
        enough = step
    top = [r.word for r in counts.filter(F.col("step") >= enough).select("word").collect()] if enough is not None else []
    drop_cut(counts)
    block = compile_lexicon(top, tokenizer.merge(top))
    name = f"lexicon-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    with open(os.path.join(folder, name), "wb") as f:
        f.write(block)
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def _texts(b: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in b.column(name).to_pylist()]


def encode(docs: DataFrame, content: bytes | None = None, words: int = LEXICON_WORDS, decoded: bool = False) -> DataFrame:
    """The documents with ``ids`` (array of int) in place of ``text``, and ``n_tokens``.

    A null text counts as empty and has no ids.  Special tokens written in a text are encoded as
    such, as the file's added tokens say; none are added.  With ``decoded`` the ids are decoded in the
    same pass, so in the same worker, and ``n_decoded`` counts the characters.  Other columns pass
    unchanged, except any called like the new ones, which are replaced.
    """
    content = content or read_tokenizer()
    file = ship_lexicon(docs, content, words)
    new = ["ids", "n_tokens"] + ["n_decoded"] * decoded
    rest = [c for c in docs.columns if c not in ("text", *new)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                encoder, ids, back = _encoder(content, file), [], []
                for x in encoder.encode(_texts(b, "text")):
                    ids.append(np.frombuffer(x, dtype="<i4"))
                    if decoded:
                        back.append(len(encoder.tokenizer.decode(ids[-1].tolist()).decode()))
                sizes = np.array([len(i) for i in ids])
                flat = pa.array(np.concatenate(ids) if ids else np.array([], dtype=np.int32), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
                counts = [pa.array(n, pa.int64()) for n in (sizes, back)[:1 + decoded]]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), lists, *counts], names=[*rest, *new])

    added = "ids array<int>, n_tokens long" + ", n_decoded long" * decoded
    return docs.select(*rest, "text").mapInArrow(lean(run), f"{kinds}{', ' if kinds else ''}{added}")


def decode(encoded: DataFrame, content: bytes | None = None) -> DataFrame:
    """The rows with ``text`` decoded from ``ids``; null ids decode to the empty text."""
    content = content or read_tokenizer()

    @F.pandas_udf("string")
    def text_of(ids):
        tokenizer = _tokenizer(content)
        return ids.map(lambda x: "" if x is None else tokenizer.decode(list(x)).decode())

    return encoded.withColumn("text", text_of("ids"))


def round_trip(docs: DataFrame, content: bytes | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text, encoded and decoded in one pass."""
    content = content or read_tokenizer()
    file = ship_lexicon(docs, content, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder, rows = _encoder(content, file), []
            for ids in encoder.encode(_texts(b, "text")):
                back = encoder.tokenizer.decode(np.frombuffer(ids, dtype="<u4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op7_bpe_round_trip", "documents")
def op7_bpe_round_trip(documents: DataFrame) -> DataFrame:
    return round_trip(documents)
