"""Personal data: overlapping candidate spans, boosted trees on format and context, calibrated thresholds.

Base spans (fixed patterns with validation) always stay.  The trees decide on what those miss: numbers
that a greedy pattern swallowed in one rejected match, for instance a card right after a phone number.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crashgrid.llm.registry import query
from crashgrid.session import cut, drop_cut

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
PRECISION = 0.995
UNIT = 1 << 20  # gradients are summed as whole multiples of 1 / UNIT, so no order of rows changes a sum
GRID = 10_000  # thresholds are whole multiples of 1 / GRID
MOST_OCTET = 256  # larger parts of an address are alike

IP_BASE = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD_BASE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_BASE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
HIDDEN = re.compile(r"([A-Za-z0-9._%+-]{1,64})\s?[\[(](?:at|AT)[\])]\s?([A-Za-z0-9-]+(?:(?:\.|\s?[\[(](?:dot|DOT)[\])]\s?)[A-Za-z0-9-]+)+)")
DIGIT, RUN, GROUP = re.compile("[0-9]"), re.compile(r"[+(]*[0-9](?:[\x20().-]{0,3}[0-9])*"), re.compile("[0-9]+")
MOST_DIGITS = 19  # of one candidate
CUES = (("mail", "phone", "tel", "call", "card", "visa", "contact", "fax", "mobil"), ("token", "version", "serial", "isbn", "license", "key", "hash"))
FEATURES = """kind digits groups luhn plus parens dashes dots spaces top_octet length least_group most_group first_digit
left right left_digits right_digits left_letters quoted cue anticue hidden labels suffix""".split()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def valid(kind: int, text: str) -> bool:
    """Whether a match of a numeric kind's pattern passes its check."""
    if kind == IP:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    digits = "".join(GROUP.findall(text))
    if kind == CARD:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, valid): the leftmost non-overlapping matches of each kind's pattern."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:  # the pattern starts where the letters before an @ do
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((EMAIL, start, m.end(), True))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        found += [(k, m.start(), m.end(), valid(k, m[0])) for k, p in ((IP, IP_BASE), (CARD, CARD_BASE), (PHONE, PHONE_BASE)) for m in p.finditer(text)]
    return found


def _heads(text: str, least: int, start: int) -> set[int]:
    """Where a phone whose digits begin at ``start`` may begin: at a plus, or at a bracket right before it."""
    head = start
    while head > least and text[head - 1] in "+(":
        head -= 1
    plus = text.rfind("+", head, start)
    if plus < 0:
        return set()
    return {plus} | ({head} if text[head] == "+" else set()) | ({plus - 1} if plus > head and text[plus - 1] == "(" else set())


def proposals(text: str, matches: list[tuple[int, int, int, bool]]) -> set[tuple[int, int, int]]:
    """Spans of high recall, overlapping as they come: base spans, hidden addresses, windows of digit groups."""
    out = {m[:3] for m in matches if m[3]}
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        out |= {(EMAIL, m.start(), m.end()) for m in HIDDEN.finditer(text)}
    if not DIGIT.search(text):
        return out
    for run in RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [g.span() for g in GROUP.finditer(text, run.start(), run.end())]
        for i, (start, _) in enumerate(groups):
            heads = _heads(text, run.start(), start)
            digits, carded, dotted = 0, True, True
            for j in range(i, len(groups)):
                end = groups[j][1]
                digits += end - groups[j][0]
                if digits > MOST_DIGITS:
                    break
                if j > i:
                    gap = text[groups[j - 1][1]:groups[j][0]]
                    carded, dotted = carded and gap in (" ", "-"), dotted and gap == "."
                if 14 <= digits and carded:
                    out.add((CARD, start, end))
                if 10 <= digits <= 15:
                    out.update((PHONE, head, end) for head in heads)
                if j - i == 3 and dotted:
                    out.add((IP, start, end))
    return out


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 12]
    groups = GROUP.findall(span)
    sizes = list(map(len, groups)) or [0]
    digits = "".join(groups)
    tail, near = re.split(r"[^A-Za-z0-9]+", span), before[-12:]
    low = before.lower()
    return [
        kind, len(digits), len(groups), 14 <= len(digits) <= 19 and luhn(digits), span.startswith("+"), span.count("(") + span.count(")"),
        span.count("-"), span.count("."), span.count(" "), max((min(int(g[:6]), MOST_OCTET) for g in groups), default=0) if kind == IP else 0, end - start,
        min(sizes), max(sizes), int(digits[:1] or 0), _side(before[-1:]), _side(after[:1]), sum(c.isdigit() for c in near),
        sum(c.isdigit() for c in after), sum(c.isalpha() for c in before[-4:]), any(c in "\"'=" for c in before[-3:]),
        any(w in low for w in CUES[0]), any(w in low for w in CUES[1]), kind == EMAIL and "@" not in span, len(tail), len(tail[-1]),
    ]


def examine(text: str) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """(base spans, candidates as rows of kind, start, end, label, features of each).

    Label 1: a base span.  0: any other candidate, except those with label -1, which nothing decides:
    hidden addresses, and spans inside a rejected base match that pass their own check.
    """
    matches = base_matches(text)
    base = sorted((m[:3] for m in matches if m[3]), key=lambda s: (s[1], s[0]))
    refused = [m for m in matches if not m[3]]
    known, rows = set(base), []
    for kind, start, end in sorted(proposals(text, matches)):
        if (kind, start, end) in known:
            label = 1
        elif kind == EMAIL or any(m[1] <= start and end <= m[2] and (m[0], m[1], m[2]) != (kind, start, end) for m in refused) and valid(kind, text[start:end]):
            label = -1
        else:
            label = 0
        rows.append((kind, start, end, label))
    spans = np.array(rows, dtype=np.int32).reshape(-1, 4)
    return base, spans, np.array([features(text, *r[:3]) for r in rows], dtype=np.float32).reshape(-1, len(FEATURES))


# ------------------------------------------------------------------------------ boosting
def quantiles(values: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Linearly interpolated quantiles of ascending values that occur so many times."""
    ends = np.cumsum(counts)
    at = q * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, f(at), side="right")].astype(float) for f in (np.floor, np.ceil))
    return low + (high - low) * (at - np.floor(at))


@dataclass
class Boosted:
    """Gradient-boosted trees for a binary label: logistic loss, histogram splits, Newton leaves."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def cut_bins(self, values: list[tuple[np.ndarray, np.ndarray]]) -> Boosted:
        """Take the edges of the bins from each feature's ascending values and their counts."""
        self.edges = [np.unique(quantiles(v, n, np.linspace(0, 1, self.bins)))[:-1] for v, n in values]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def _places(self, b: np.ndarray, tree: int, levels: int) -> np.ndarray:
        feature, cutoff, _ = self.nodes[tree]
        at, rows = np.ones(len(b), dtype=int), np.arange(len(b))
        for _ in range(levels):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + (b[rows, f] > cutoff[at]), at)
        return at

    def _chances(self, b: np.ndarray, trees: int) -> np.ndarray:
        score = np.full(len(b), self.start)
        for t in range(trees):
            score += self.nodes[t][2][self._places(b, t, self.depth)]
        return 1 / (1 + np.exp(-score))

    def sums(self, b: np.ndarray, n: np.ndarray, positive: np.ndarray, level: int) -> np.ndarray:
        """Gradient and curvature by node of a level of the newest tree, feature and bin, in units.

        Row i stands for n[i] rows with the same bins, positive[i] of them with label 1.
        """
        p, at = self._chances(b, len(self.nodes) - 1), self._places(b, len(self.nodes) - 1, level)
        here = at >= 2 ** level
        slots = ((at[here, None] - 2 ** level) * b.shape[1] + np.arange(b.shape[1])) * (self.bins + 1) + b[here]
        shape = 2 ** level, b.shape[1], self.bins + 1
        parts = [np.rint(v[here] * UNIT) for v in (positive - n * p, n * np.maximum(p * (1 - p), 1e-6))]
        return np.stack([np.bincount(slots.ravel(), np.repeat(v, b.shape[1]), int(np.prod(shape))).reshape(shape) for v in parts]).astype(np.int64)

    def grow(self, n: int, positive: int, sums: Callable[[Boosted, int], np.ndarray]) -> Boosted:
        """Fit the trees; ``sums(model, level)`` are the sums over all rows."""
        rate = np.clip(positive / n, 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        for _ in range(self.trees):
            feature, cutoff, value = (np.zeros(2 ** (self.depth + 1), dtype=k) for k in (int, int, float))
            feature[:] = -1
            self.nodes.append((feature, cutoff, value))
            newton = lambda g, h: self.rate * g / (h + 1)
            for level in range(self.depth):
                if level and (feature[2 ** (level - 1):2 ** level] < 0).all():
                    break
                for node, (g, h) in enumerate(np.moveaxis(sums(self, level) / UNIT, 0, 1), 2 ** level):
                    total = g[0].sum(), h[0].sum()
                    if not level:
                        value[node] = newton(*total)
                    gl, hl = (np.cumsum(v, axis=1)[:, :-1] for v in (g, h))
                    gain = gl**2 / (hl + 1) + (total[0] - gl) ** 2 / (total[1] - hl + 1) - total[0] ** 2 / (total[1] + 1)
                    j, k = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, k] > 1e-6:
                        feature[node], cutoff[node] = j, k
                        value[2 * node:2 * node + 2] = newton(gl[j, k], hl[j, k]), newton(total[0] - gl[j, k], total[1] - hl[j, k])
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        b = self.cut_bins([np.unique(c, return_counts=True) for c in x.T]).binned(x)
        return self.grow(len(y), int(y.sum()), lambda model, level: model.sums(b, np.ones(len(y)), y, level))

    def predict_binned(self, b: np.ndarray) -> np.ndarray:
        return self._chances(b, len(self.nodes))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.predict_binned(self.binned(x))


@dataclass
class Redactor:
    """Fitted trees, and for each kind the least score at which a candidate becomes a span.

    ``rows`` labelled candidates were learned from, for the trees or for the thresholds.
    """

    model: Boosted | None
    thresholds: list[float]
    rows: int = 0

    def choose(self, base: list[tuple[int, int, int]], spans: np.ndarray, x: np.ndarray) -> list[tuple[int, int, int, float, bool]]:
        """(kind, start, end, score, base): base spans, then the best candidates that overlap nothing taken."""
        taken = [(*s, 1.0, True) for s in base]
        if self.model is not None and len(spans):
            scores = self.model.predict(x)
            fit = np.flatnonzero((spans[:, 3] != 1) & (np.floor(scores * GRID) / GRID >= np.array(self.thresholds)[spans[:, 0]]))
            busy = [(s[1], s[2]) for s in base]
            for i in sorted(fit.tolist(), key=lambda i: (-scores[i], spans[i, 1], spans[i, 0])):
                kind, start, end = map(int, spans[i, :3])
                if all(end <= a or b <= start for a, b in busy):
                    busy.append((start, end))
                    taken.append((kind, start, end, float(scores[i]), False))
        return sorted(taken, key=lambda s: (s[1], s[0]))


def threshold(scores: np.ndarray, n: np.ndarray, positive: np.ndarray, precision: float = PRECISION) -> float:
    """The least score, 0.5 at least, at which and above which the precision reaches ``precision``.

    Of each distinct score, n rows have it and ``positive`` of them label 1.  Infinite where no score will do:
    without positives only base spans stay.
    """
    order = np.argsort(-scores)
    right = np.cumsum(positive[order])
    good = np.flatnonzero((right >= precision * np.cumsum(n[order])) & (right > 0))
    return max(0.5, float(scores[order][good[-1]])) if len(good) else float("inf")


# -------------------------------------------------------------------------------- on Spark
def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans, features of each document, packed; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                found = [examine(t.as_py() or "") for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), pa.array([np.array(f[0], dtype=np.int32).tobytes() for f in found], pa.binary()),
                    pa.array([f[1].tobytes() for f in found], pa.binary()), pa.array([f[2].tobytes() for f in found], pa.binary()),
                ], names=["doc_id", "base", "spans", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base binary, spans binary, features binary")


def _unpack(base: bytes, spans: bytes, x: bytes):
    return ([tuple(r) for r in np.frombuffer(base, dtype=np.int32).reshape(-1, 3).tolist()], np.frombuffer(spans, dtype=np.int32).reshape(-1, 4),
            np.frombuffer(x, dtype=np.float32).reshape(-1, len(FEATURES)))


def _labelled(base: pa.Array, ids: pa.Array, spans: pa.Array, x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, label, half, features) of a batch's candidates that have a label.

    The half is a checksum of id and span, so it does not depend on how the rows are split or ordered.
    """
    sizes = np.array([len(s) // 16 for s in spans.to_pylist()], dtype=int)
    rows = np.frombuffer(b"".join(spans.to_pylist()), dtype=np.int32).reshape(-1, 4)
    x = np.frombuffer(b"".join(x.to_pylist()), dtype=np.float32).reshape(-1, len(FEATURES))
    of, known = np.repeat(np.arange(len(sizes)), sizes), rows[:, 3] >= 0
    rows, of, x = rows[known], of[known], x[known]
    names = ids.to_pylist()
    half = np.array([zlib.crc32(f"{names[i]}:{r[0]}:{r[1]}:{r[2]}".encode()) & 1 for i, r in zip(of.tolist(), rows.tolist())], dtype=np.int32)
    return rows[:, 0], rows[:, 3], half, x


def _per_batch(found: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``make`` over the labelled candidates of each batch: a list of columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = make(*_labelled(*(b.column(c) for c in ("base", "doc_id", "spans", "features"))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return found.select("doc_id", "base", "spans", "features").mapInArrow(run, schema)


def _values(kinds, labels, half, x):
    """Each feature's values in the half that the trees are fitted on, counted."""
    counted = [np.unique(x[half == 0, j], return_counts=True) for j in range(x.shape[1])]
    sizes = [len(v) for v, _ in counted]
    return [np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.concatenate([v for v, _ in counted]), np.concatenate([n for _, n in counted]).astype(np.int64)]


def _over(table: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``make`` over the (kinds, bins, n, positive) of each batch of binned rows: a list of columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
                columns = make(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "n", "positive")), bins)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return table.select("kind", "bins", "n", "positive").mapInArrow(run, schema)


def _summed(table: DataFrame) -> Callable[[Boosted, int], np.ndarray]:
    """The sums over a table of binned rows: one block of a fixed size from each task reaches the driver."""

    def sums(model: Boosted, level: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for b in batches:
                if b.num_rows:
                    bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
                    total = total + model.sums(bins, b.column("n").to_numpy(), b.column("positive").to_numpy(), level)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = table.select("bins", "n", "positive").mapInArrow(run, "sums binary").collect()
        whole = sum(np.frombuffer(bytes(r.sums), dtype=np.int64) for r in parts)
        return whole.reshape(2, 2 ** level, len(FEATURES), model.bins + 1)

    return sums


def train(found: DataFrame, precision: float = PRECISION) -> Redactor:
    """Fit the trees on one half of all labelled candidates and set the thresholds on the other.

    Candidates that agree in kind, half and bins are one row with its counts, which is all that the trees
    see of them.  The sums of each level are made in Spark's tasks, the scores of the other half counted
    there too; what reaches the driver does not grow with the candidates.
    """
    values = _per_batch(found, _values, "feature int, value float, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    seen = sorted((r.feature, r.value, r.n) for r in values.collect())  # spans are short, so values are few
    if not seen:
        return Redactor(None, [np.inf] * len(KINDS))
    known = [np.array([r[1:] for r in seen if r[0] == j], dtype=float).T for j in range(len(FEATURES))]
    model = Boosted().cut_bins([(v, n.astype(int)) for v, n in known])

    def to_bins(kinds, labels, half, x):
        bins = pa.array([b.tobytes() for b in model.binned(x)], pa.binary())
        return [kinds, half, bins, np.ones(len(kinds), dtype=np.int64), labels.astype(np.int64)]

    rows = _per_batch(found, to_bins, "kind int, half int, bins binary, n long, positive long")
    table = cut(rows.groupBy("kind", "half", "bins").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")))
    halves = {r[0]: r[1:] for r in table.groupBy("half").agg(F.sum("n"), F.sum("positive")).collect()}
    n, positive = halves[0]
    count = sum(r[0] for r in halves.values())
    if positive in (0, n):
        drop_cut(table)
        return Redactor(None, [np.inf] * len(KINDS), count)
    model.grow(n, positive, _summed(table.filter("half = 0")))

    def to_grid(kinds, n, positive, bins):
        return [kinds, np.floor(model.predict_binned(bins) * GRID).astype(np.int32), n, positive]

    scored = _over(table.filter("half = 1"), to_grid, "kind int, score int, n long, positive long")
    counts = scored.groupBy("kind", "score").agg(F.sum("n"), F.sum("positive")).collect()  # at most GRID + 1 a kind
    drop_cut(table)
    thresholds = []
    for k in range(len(KINDS)):
        mine = np.array([r[1:] for r in counts if r[0] == k], dtype=float).reshape(-1, 3)
        thresholds.append(threshold(mine[:, 0] / GRID, mine[:, 1], mine[:, 2], precision))
    return Redactor(model, thresholds, count)


def find_pii(docs: DataFrame, found: DataFrame | None = None, redactor: Redactor | None = None) -> DataFrame:
    """doc_id and ``spans``: array of (kind, start, end, score, base), in code points, end exclusive, by start and kind.

    Every text is read once; its candidates are stored, the trees fitted on all of them that have a label
    and applied to the stored ones.  Ids may be null or repeat: each row gets its own result.
    """
    found = found or cut(candidates(docs))
    redactor = redactor or train(found)
    names = list(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
        for b in batches:
            rows = [redactor.choose(*_unpack(*r)) for r in zip(*(b.column(c).to_pylist() for c in ("base", "spans", "features")))]
            packed = [[{"kind": names[s[0]], "start": s[1], "end": s[2], "score": s[3], "base": s[4]} for s in r] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed, kind)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")


def redact(docs: DataFrame, redactor: Redactor | None = None) -> DataFrame:
    """The documents with each span of their text replaced by its kind in brackets; overlaps become one."""
    redactor = redactor or train(cut(candidates(docs)))

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            spans, out, at = redactor.choose(*examine(text)), [], 0
            for kind, start, end, *_ in spans:
                if start >= at:
                    out += [text[at:start], f"[{KINDS[kind].upper()}]"]
                at = max(at, end)
            return "".join(out) + text[at:]
        return texts.map(one)

    return docs.withColumn("text", clean("text"))


@query("op1_pii_spans", "documents")
def op1_pii_spans(documents: DataFrame) -> DataFrame:
    found = find_pii(documents)
    line = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
