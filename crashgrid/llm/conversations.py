"""Repair of conversation structure: cheapest edits by weighted CYK parsing over intervals of rows.

The roles of a sound conversation are ``(s?(ua)+)?`` by their initials.  Its places are the start (0),
after the system row (1), after a user row (2) and after an assistant row (3).  The repair grammar is in
Chomsky normal form: a nonterminal (p, q) stands for rows and edits that lead from place p to place q; it
derives one edited row, or (p, r) followed by (r, q).  The cell of a span of rows holds the least
(cost, audit) of every nonterminal, where the audit is the string of the edits' initials, and is closed
under insertions at both ends.  Audits of one span and one cost never begin each other, since the letters
fix the cost, so the least of the whole comes from the least of its parts.

Spans are combined bottom-up by length.  Rows in order are numbered over the whole table and parsed in
blocks of BLOCK rows; conversations that cross blocks have their blocks' cells combined FAN at a time, so
no group is larger than that, however long a conversation is.  Only the digest of the repaired text needs
a conversation in one place: it is streamed there in order, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crashgrid.llm.registry import query
from crashgrid.llm.sharding import number_rows
from crashgrid.session import cut, drop_cut

REROLE, DELETE, INSERT, OPEN_END = 1, 2, 5, 5  # costs of Rerole, Delete, Insert and of a truncated row that stays
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}  # place and initial to the next place
PLACES = range(4)
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
RULES = [(PAIRS.index((p, q)), PAIRS.index((p, r)), PAIRS.index((r, q))) for p, q in PAIRS for r in PLACES if (p, r) in PAIRS and (r, q) in PAIRS]
WHOLE = [PAIRS.index((0, 0)), PAIRS.index((0, 3))]
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
LEAF, BLOCK, FAN = 8, 4096, 64

Cell = tuple  # of (cost, audit) or None, in the order of PAIRS


def join(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out: list = [None] * len(PAIRS)
    for k, a, b in RULES:
        x, y = left[a], right[b]
        if x is not None and y is not None:
            found = (x[0] + y[0], x[1] + y[1])
            if out[k] is None or found < out[k]:
                out[k] = found
    return tuple(out)


def least(one: Cell, other: Cell) -> Cell:
    return tuple(min((v for v in pair if v is not None), default=None) for pair in zip(one, other))


def insertions() -> Cell:
    """The cell of no rows: what inserted rows alone derive, closed."""
    cell: Cell = tuple((0, "") if p == q else None for p, q in PAIRS)
    one = tuple((INSERT, "I") if any(STEPS.get((p, i)) == q for i in "ua") else None for p, q in PAIRS)
    while True:
        wider = least(cell, join(cell, least(cell, one)))
        if wider == cell:
            return cell
        cell = wider


NOTHING = insertions()


@lru_cache(maxsize=64)
def row_cell(initial: str, fault: str) -> Cell:
    """The cell of one row: kept, given another role or deleted, with insertions before and after it."""
    found: dict[tuple[int, int], tuple[int, str]] = {(p, p): (DELETE, "D") for p in PLACES}
    if fault not in "bd":
        extra = OPEN_END if fault == "t" else 0
        for (p, i), q in STEPS.items():
            if i == initial:
                found[p, q] = min(found.get((p, q), (extra, "K")), (extra, "K"))
            if i in "ua":
                edit = (REROLE + extra, "R")
                found[p, q] = min(found.get((p, q), edit), edit)
    return join(join(NOTHING, tuple(found.get(pair) for pair in PAIRS)), NOTHING)


@lru_cache(maxsize=1 << 14)
def leaf_cell(symbols: str) -> Cell:
    """The cell of at most LEAF rows (initial and fault, two letters a row) by all spans and all their splits."""
    n = len(symbols) // 2
    chart = {(i, i + 1): row_cell(symbols[2 * i], symbols[2 * i + 1]) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell = join(chart[i, i + 1], chart[i + 1, i + length])
            for m in range(i + 2, i + length):
                cell = least(cell, join(chart[i, m], chart[m, i + length]))
            chart[i, i + length] = cell
    return chart[0, n]


def join_all(cells: list[Cell]) -> Cell:
    """Cells of neighbouring spans become one, two by two."""
    while len(cells) > 1:
        cells = [join(*cells[k:k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


def parse(symbols: str) -> Cell:
    return join_all([leaf_cell(symbols[k:k + 2 * LEAF]) for k in range(0, len(symbols), 2 * LEAF)])


def answer(cell: Cell) -> tuple[int, str]:
    return min(cell[k] for k in WHOLE if cell[k] is not None)


class Rewriter:
    """Follows an audit over a conversation's rows and gives the repaired lines, one at a time."""

    def __init__(self, audit: str):
        self.edits, self.at, self.place = audit, 0, 0

    def _next_role(self) -> str:
        initial = "a" if self.place == 2 else "u"
        self.place = STEPS[self.place, initial]
        return ROLES[initial]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            yield self._next_role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.place = STEPS[self.place, role[:1]]
            yield role, text
        elif edit == "R":
            yield self._next_role(), text


# -------------------------------------------------------------------------------- on Spark
def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows with what a repair needs to know of each: _digest, _initial, _open.

    ``_initial`` is s, u, a or o for any other role; ``_open`` is b for a blank text, t for one whose last
    character but blanks is none of ``.!?``, else k.  Null roles and texts count as one space.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    initial = F.substring("role", 1, 1)
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    state = F.when(end == "", "b").when(F.right(end, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("_digest"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("_initial"), state.alias("_open"))


ORDER = ["conv_id", "turn", "role", "_digest"]
CELL = "cost array<int>, audit array<string>"
COUNTS = ["n_rows", "blank", "duplicate", "truncated", "illegal"]


def _cell_columns(cells: list[Cell]) -> list[pa.Array]:
    return [pa.array([[None if v is None else v[k] for v in cell] for cell in cells], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.string()))]


def _pieces(table: pa.Table, block: int) -> pa.Table:
    """One row for each conversation's rows in a block: counts, first and last initial, cell."""
    table = table.sort_by("_row")
    numbers, ids = table["_row"].to_pylist(), table["conv_id"].to_pylist()
    initials = "".join(table["_initial"].to_pylist())
    faults = "".join("b" if o == "b" else "d" if again else o for o, again in zip(table["_open"].to_pylist(), table["_again"].to_pylist()))
    starts = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
    found, cells = [], []
    for a, b in zip(starts, [*starts[1:], len(ids)]):
        names, marks = initials[a:b], faults[a:b]
        wrong = sum(names[k:k + 2] not in LEGAL for k in range(b - a - 1))
        found.append((ids[a], numbers[a] // block, a == 0 or b == len(ids), b - a, *(marks.count(f) for f in "bdt"), wrong, names[0], names[-1]))
        cells.append(parse("".join(x + y for x, y in zip(names, marks))))
    names = ["conv_id", "piece", "edge", *COUNTS, "first", "last"]
    kinds = [table["conv_id"].type, pa.int64(), pa.bool_(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    return pa.table([*(pa.array(c, k) for c, k in zip(zip(*found), kinds)), *_cell_columns(cells)], names=[*names, "cost", "audit"])


def _merge(table: pa.Table, fan: int) -> pa.Table:
    """One row for a conversation's neighbouring pieces."""
    rows = table.sort_by("piece").to_pylist()
    out = {**rows[0], "piece": rows[0]["piece"] // fan, "last": rows[-1]["last"]}
    for c in COUNTS:
        out[c] = sum(r[c] for r in rows)
    out["illegal"] += sum(x["last"] + y["first"] not in LEGAL for x, y in zip(rows, rows[1:]))
    cell = join_all([tuple(None if c is None else (c, a) for c, a in zip(r["cost"], r["audit"])) for r in rows])
    plain = [c for c in table.column_names if c not in ("cost", "audit")]
    return pa.table([*(pa.array([out[c]], table[c].type) for c in plain), *_cell_columns([cell])], names=[*plain, "cost", "audit"])


def parse_conversations(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id, n_rows, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``ordered`` rows.

    Texts stay where they are: the rows are numbered by conversation, turn (nulls first), role and digest.
    A row is a duplicate unless its number is the smallest of its (conversation, role, digest), and that
    join is on numbers, which no key can make uneven.
    """
    stored, _ = number_rows(rows.drop("text"), ORDER)
    numbered = stored.select("_row", "conv_id", "role", "_digest", "_initial", "_open")
    first = numbered.groupBy("conv_id", "role", "_digest").agg(F.min("_row").alias("_row")).select("_row", F.lit(False).alias("_again"))
    marked = numbered.drop("role", "_digest").join(first, "_row", "left").withColumn("_again", F.coalesce("_again", F.lit(True)))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, piece long, edge boolean, {', '.join(f'{c} long' for c in COUNTS)}, first string, last string, {CELL}"
    blocks = marked.withColumn("_block", F.floor(F.col("_row") / block)).groupBy("_block")
    pieces = cut(blocks.applyInArrow(lambda t: _pieces(t, block), schema))
    whole, parts = pieces.filter("NOT edge"), pieces.filter("edge")
    held = []
    while not parts.groupBy("conv_id").count().filter("count > 1").isEmpty():
        parts = cut(parts.groupBy("conv_id", F.floor(F.col("piece") / fan)).applyInArrow(lambda t: _merge(t, fan), schema))
        held.append(parts)
    drop_cut(*held[:-1])

    ends = [F.struct(F.get("cost", F.lit(k)).cast("long").alias("cost"), F.get("audit", F.lit(k)).alias("audit")) for k in WHOLE]
    done = whole.unionByName(parts).withColumn("_best", F.least(*ends))
    result = cut(done.select("conv_id", *COUNTS, "_best.cost", "_best.audit"))
    drop_cut(pieces, *held[-1:], stored)
    return result


def rewrite(rows: DataFrame, heads: DataFrame, texts: bool = False) -> DataFrame:
    """The ``heads`` (conv_id, audit, other columns), one a conversation, with ``repaired_sha256`` of the repaired lines.

    With ``texts``, the repaired rows themselves: conv_id, place (from 0), role, text.  Rows are those of
    ``ordered``.  A task sorts its conversations on disk and reads them row by row; it holds one audit and
    a digest's state, whatever the conversation's size.
    """
    rest = [c for c in heads.columns if c != "conv_id"]
    head = heads.select("conv_id", F.lit(0).alias("_kind"), F.struct(*rest).alias("_head"))
    line = rows.select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "_digest", "text")
    sorted_rows = head.unionByName(line, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "_kind", "turn", "role", "_digest")
    id_field = heads.schema["conv_id"]
    kinds = f"conv_id {id_field.dataType.simpleString()}"
    schema = kinds + (", place long, role string, text string" if texts else f", _head {head.schema['_head'].dataType.simpleString()}, repaired_sha256 string")

    class Conversation:
        def __init__(self, key, top):
            self.key, self.top, self.rewriter = key, top, Rewriter(top["audit"].as_py())
            self.digest, self.lines = hashlib.sha256(), 0

        def put(self, lines: Iterator[tuple[str, str]]) -> list[tuple]:
            out = []
            for role, text in lines:
                self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                if texts:
                    out.append((self.key.as_py(), self.lines, role, text))
                self.lines += 1
            return out

        def close(self) -> list[tuple]:
            out = self.put(self.rewriter.inserted())
            return out if texts else [(self.key.as_py(), self.top.as_py(), self.digest.hexdigest())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: Conversation | None = None
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part, out = b.slice(a, 256), []
                for key, kind, top, role, text in zip(*(part.column(c) for c in ("conv_id", "_kind", "_head", "role", "text"))):
                    if kind.as_py() == 0:
                        out += open_one.close() if open_one else []
                        open_one = Conversation(key, top)
                    else:
                        out += open_one.put(open_one.rewriter.row(role.as_py(), text.as_py()))
                yield _batch(out, b, texts)
        if open_one:
            yield _batch(open_one.close(), b, texts)

    done = sorted_rows.select("conv_id", "_kind", "_head", "role", "text").mapInArrow(run, schema)
    return done if texts else done.select("conv_id", *[f"_head.{c}" for c in rest], "repaired_sha256")


def _batch(out: list[tuple], like: pa.RecordBatch, texts: bool) -> pa.RecordBatch:
    kinds = [like.column("conv_id").type, *([pa.int64(), pa.string(), pa.string()] if texts else [like.column("_head").type, pa.string()])]
    names = ["conv_id", *(["place", "role", "text"] if texts else ["_head", "repaired_sha256"])]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with ``_live`` (false for dropped ones): one of six fates by crc32 of ``conv_id:turn``.

    Of twenty remainders, 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes
    its role user; the rest leave it.  Nulls count as one space.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.when(F.col("_fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    drawn = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", fate.alias("_fate"))
    return drawn.select("conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                        (F.col("_fate") != 0).alias("_live"), F.explode(times).alias("_copy")).drop("_copy")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, n_rows, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows are taken by turn (nulls first), then role and digest of the text.  Null ids are one conversation;
    null roles and texts count as one space.  Equal rows of a conversation are duplicates.  Other columns
    are ignored; an empty table gives no rows.
    """
    lines = ordered(rows)
    return rewrite(lines, parse_conversations(lines))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations, in their new order from place 0."""
    lines = ordered(rows)
    return rewrite(lines, parse_conversations(lines).select("conv_id", "audit"), texts=True)


def repair_damaged(conversations: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id, gaps in the turns, faults, cost, audit and repaired_sha256 of every conversation after ``damage``.

    Conversations of which nothing is left get zeros, the empty audit and the digest of the empty text.
    """
    damaged = damage(conversations)
    live = F.when(F.col("_live"), F.col("turn"))
    turns = damaged.groupBy("conv_id").agg(F.min(live).alias("low"), F.max(live).alias("high"), F.count_distinct(live).alias("kinds"))
    gaps = turns.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("kinds"), F.lit(0)).alias("gaps"))
    lines = ordered(damaged.filter("_live"))
    parsed = parse_conversations(lines, block, fan).drop("n_rows").withColumnRenamed("conv_id", "_conv")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in (*COUNTS[1:], "cost")}
    heads = gaps.join(parsed, gaps["conv_id"].eqNullSafe(parsed["_conv"]), "left").drop("_conv").withColumns({**zeros, "audit": F.coalesce("audit", F.lit(""))})
    return rewrite(lines, heads)


@query("op13_repair_conversations", "conversations")
def op13_repair_conversations(conversations: DataFrame) -> DataFrame:
    return repair_damaged(conversations)
