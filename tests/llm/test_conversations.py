"""Conversation repair against a search over all edits, on damaged, tied, null, long and empty conversations."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from crashgrid.llm import conversations as C

SOUND = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """Least (cost, audit, lines) over all edits, by a uniform-cost search on (cost, audit)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and SOUND.match(roles):
            return cost, audit, list(lines)
        state = (i, roles[-1:], "s" in roles)
        if state in done or not re.match(r"s?(ua)*u?\Z", roles):
            continue
        done.add(state)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role[0], (*lines, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, roles + other[0], (*lines, f"{other}:{text}")))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(rows):
    """The query's row of every conv_id."""
    space = lambda x: " " if x is None else x
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text, mine = space(role), space(text), groups[conv]
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        if fate:
            mine += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0], r[1], hashlib.sha256(r[2].encode()).digest()))
        marked, turns = faults([r[1:] for r in mine]), {r[0] for r in mine} - {None}
        names = [r[1][:1] for r in mine]
        cost, audit, lines = cheapest(marked)
        count = [sum(f == x for _, _, f in marked) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, sum(a + b not in ("su", "ua", "au") for a, b in zip(names, names[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(seed, conversations, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "open end", "", None, " \t", "Ends.\n ", "é。", "a. ", *(f"Text {i}." for i in range(30))]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]
    return [(c, None if r.random() < 0.02 else t + (r.random() < 0.1), r.choice(roles), r.choice(texts))
            for c in range(conversations) for t in range(r.randrange(1, longest + 1))]


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(spark, rows, kind="long", **sizes):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], f"conv_id {kind}, turn int, role string, text string, audit string").repartition(3)
    got = C.repair_damaged(frame, **sizes)
    assert got.columns == ["conv_id", *COLUMNS]
    found = got.collect()
    assert len(found) == len({r[0] for r in rows})
    assert {r.conv_id: tuple(r)[1:] for r in found} == brute(rows)


def test_repairs_are_the_cheapest(spark):
    rows = rows_of(1, 400, 9)
    rows += rows[:40] + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (9999, None, "user", "x" * 200_000)]
    compare(spark, rows)


def test_conversations_over_many_blocks(spark):
    compare(spark, [(f"c{c}", t, role, text) for c, t, role, text in rows_of(2, 30, 6) + [(77, *r[1:]) for r in rows_of(3, 1, 2) * 20 + rows_of(4, 20, 9)]], "string", block=3, fan=2)


def test_empty_table(spark):
    assert C.op13_repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_parse_is_the_same_for_any_cut(seed):
    r = random.Random(seed)
    symbols = "".join(r.choice("suao") + r.choice("kkktdb") for _ in range(40))
    whole = C.answer(C.parse(symbols))
    for at in (2, 14, 38, 78):
        assert C.answer(C.join(C.parse(symbols[:at]), C.parse(symbols[at:]))) == whole
    rows = [({"o": "tool"}.get(x, C.ROLES.get(x)), "t", {"k": None, "t": "truncated", "d": "duplicate", "b": "blank"}[y]) for x, y in zip(symbols[::2], symbols[1::2])]
    assert cheapest(rows)[:2] == whole


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "What?"), (2, 0, "user", "Hi."), (2, 1, "assistant", "cut o")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = sorted(tuple(r) for r in C.repaired_rows(frame).collect())
    assert got == [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "What?")]
