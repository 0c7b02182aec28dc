import hashlib
import heapq
import random
import zlib

import pytest
from odd import CLASHING, LONG, sorted_rows
from pyspark.sql import functions as F

from pricetrail.llm import conversations as C
from pricetrail.llm.common import WorkFolder, table
from pricetrail.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def shown(x):
    return " " if x is None else x


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = shown(role), shown(text)
        what = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if what == 1:
            text = ""
        elif what == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif what == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def step(state, initial):
    if initial == "":
        return state
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get(
        (state, initial)
    )


def cheapest(rows, exhaustive=False):
    """Least (cost, audit) over all edits of (initial, cut, gone), by a search in that order.

    What is reached first at a place is taken; exhaustive, every audit is followed.
    """
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, k, state = entry = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, audit
        place = entry if exhaustive else (k, state)
        if place in seen:
            continue
        seen.add(place)
        ways = [(3, "I", k, step(state, r)) for r in "ua"]
        if k < len(rows):
            initial, cut, gone = rows[k]
            ways.append((4, "D", k + 1, state))
            if not gone:
                ways.append((3 * cut, "K", k + 1, step(state, initial)))
                ways += [(3 + 3 * cut, "R", k + 1, step(state, r)) for r in "ua"]
        for more, edit, at, then in ways:
            if then is not None:
                heapq.heappush(heap, (cost + more, audit + edit, at, then))


def report(rows):
    """One conversation's rows, in order, as the contract has it."""
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count, seen, symbols = {"b": 0, "d": 0, "t": 0}, set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACES)
        fault = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        symbols.append((role[:1], fault == "t", fault in ("b", "d")))
    firsts = [role[:1] for _, _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    cost, audit = cheapest(symbols)
    out, state, left = [], "", iter(rows)
    for edit in audit:
        role = "assistant" if state == "u" else "user"
        text = ""
        if edit != "I":
            _, _, own, text = next(left)
            role = own if edit == "K" else role
        if edit != "D":
            out.append(f"{role}:{text}")
            state = step(state, role[:1])
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, count["b"], count["d"], count["t"], illegal, cost, audit, digest


def brute(original, rows):
    def order(row):
        return (row[1] is not None, row[1] or 0, row[2],
                hashlib.sha256(row[3].encode()).digest())

    names = {r[0] for r in original}
    found = {n: report(sorted((r for r in rows if r[0] == n), key=order)) for n in names}
    return sorted(((n, *f) for n, f in found.items()), key=repr)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
         "repaired_sha256")


def got(df):
    assert tuple(df.columns) == NAMES
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_rows(seed, conversations, most):
    choice = random.Random(seed)
    texts = ["Yes.", "No", "What?", "", " \t", None, "Fine! ", "so..", "é字", LONG[:500]]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]
    out = []
    for conv in range(conversations):
        for turn in range(choice.randrange(1, most)):
            turn = None if choice.random() < 0.03 else turn + 2 * (choice.random() < 0.1)
            role = choice.choice(roles) if choice.random() < 0.4 else ("user", "assistant")[(turn or 0) % 2]
            text = choice.choice(texts) if choice.random() < 0.6 else f"Line {choice.random()}."
            out.append((conv if conv else None, turn, role, text))
    return out


def test_odd_conversations(spark):
    original = some_rows(1, 60, 9) + [(-5, 7, "user", "x."), (-5, 7, "user", "x.")]
    df = spark.createDataFrame(original, SCHEMA)
    want = brute(original, damaged(original))
    assert got(C.repair(C.damage(df), df)) == want
    wide = df.withColumns({n: F.lit("clash") for n in (*CLASHING, "conv", "at", "what", "rows")})
    assert got(C.repair(C.damage(wide), wide.repartition(4))) == want
    none = df.limit(0)
    assert got(C.repair(C.damage(none), none)) == []


def test_cut_conversations(spark):
    """A long conversation in many segments, and as one."""
    rows = [(1, t, "user" if t % 3 else "assistant", f"{t % 7}.") for t in range(300)]
    rows += [(2, None, "assistant", "same") for _ in range(50)] + [(3, 0, "system", "s.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = [r[:-1] for r in got(C.repair(df))]
    assert [r[:-1] for r in got(C.repair(df, size=7))] == want
    short = [r for r in rows if r[0] != 1 or r[1] < 9]
    df = spark.createDataFrame(short, SCHEMA)
    assert got(C.repair(df, size=4)) == brute(short, short)


def test_repaired_rows(spark):
    rows = some_rows(4, 20, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    found = C.edits(df, df, WorkFolder(spark, "test"))
    audits = {None if r.no_id else r.conv: r.audit for r in found.collect()}
    edits = {}
    for r in C.repaired_rows(df, found).orderBy("conv_id", "place").collect():
        edits.setdefault(r.conv_id, []).append((r.edit, r.role[:1]))
    for name, audit in audits.items():
        own = edits.get(name, [])
        assert "".join(e for e, _ in own) == audit.replace("D", "")
        state = ""
        for _, initial in own:
            state = step(state, initial)
        assert state in ("", "a")


def test_supplied(spark):
    sf = "/root/testdata/sf0.001"
    original = [tuple(r[c] for c in ("conv_id", "turn", "role", "text"))
                for r in table(spark, sf, "conversations").collect()]
    assert got(QUERIES["op12_conversations"](spark, sf)) == brute(original, damaged(original))


@pytest.mark.parametrize("seed", range(60))
def test_any_grammar_gives_the_cheapest_edits(seed):
    choice = random.Random(seed)
    initials = ["s", "u", "a", "u", "a", "", "other"]
    rows = [(choice.choice(initials), choice.random() < 0.3, choice.random() < 0.2)
            for _ in range(choice.randrange(0, 8))]
    symbols = left = "".join(C.GONE if g else C.SYMBOL[i, int(c)] for i, c, g in rows)
    rules = []
    for k in range(choice.randrange(0, 4)):
        if len(left) > 1:
            pair = choice.choice(sorted(C.pairs(left)))
            rules.append((pair, chr(0x100 + k)))
            left = left.replace(pair, rules[-1][1])
    whole = C._Whole((False, 1))
    whole.ways = C.joined(whole.ways, C.through(symbols, rules, C.matrices(rules)))
    assert whole.row()[-2:] == cheapest(rows, True) == cheapest(rows)


def test_grammar_is_shared(spark):
    """Frequent pairs become rules, also of rules, and every segment is rebuilt by them."""
    text = "".join(C.SYMBOL[c, 0] for c in "ua" * 16)
    distinct = spark.createDataFrame([(text, 10), (C.SYMBOL["s", 0] + text[:6], 3)], "symbols string, n long")
    rules = C.learn(distinct)
    assert len(C.compressed(text, rules)) <= 2 and len(rules) >= 4
    assert sorted_rows(distinct) and C.pairs("aaaa")["aa"] == 2
