"""Repair of conversation structure by a dynamic program over a grammar.

A well-formed conversation is empty, or has an optional system row and then pairs of user and assistant. A row
is blank, a duplicate, truncated, or without fault; with its role's initial that gives one of a few symbols.
Edits keep, rerole, delete or insert rows at fixed costs; of the cheapest edits the audit, their initials in
order, is the least in ASCII order.

What a stretch of rows does is a matrix: for each pair of states before and after it, the least cost and the
audit of that way, a rope of the audits of its parts. Stretches are joined by the min-plus product. Re-Pair
replaces the most frequent pairs of symbols of all conversations by rules; a rule's matrix is computed once,
from those of its two parts, and shared by all conversations.

A conversation of any length is cut into segments of bounded size; their matrices are computed apart and joined
in order. Only the repaired text, which is digested in order, passes through one task a conversation, row by
row. The grammar is learned from all distinct segments; its size is bounded, which costs sharing only.

Null role or text counts as one space. A null conversation id is a conversation of its own, null turns come
first. Rows of one turn are taken by role, then by the SHA-256 of their text; equal rows are duplicates of the
first one. A role without characters adds nothing to the initials. Other columns are not read; empty tables
give an empty result.
"""

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import Batches, WorkFolder

# Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Symbols of a segment; rules of the grammar, and how often pairs are counted to find them.
SEGMENT = 4096
MOST_RULES = 512
ROUNDS = 10

SPACES = " \t\n\x0b\x0c\r"

# ---- rows and their faults -----------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Drop, empty, strip of stops, repeat or rerole rows, as a checksum of their place says."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    what = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select(
        "conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"),
        what.alias("what"),
    ).filter("what != 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", ""))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(0), (F.col("what") == 3).cast("int"))).alias("copy"),
    ).drop("copy")


#: Conversation and turn without nulls, in the order that null turns come first.
_CONVERSATION = ("no_id", "conv")
_PLACE = (*_CONVERSATION, "has_turn", "at_turn", "role", "digest")


def _placed(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
    )


def faults(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Equal rows of a turn as one row: how many, whether first of their kind, blank or truncated.

    Conversations of `every` that have no rows are there with none.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    turns = (
        _placed(rows)
        .withColumn("end", F.right(end, F.lit(1)))
        .groupBy(*_PLACE)
        .agg(F.count("*").alias("rows"), F.first("end").alias("end"))
    )
    firsts = (
        turns.groupBy(*_CONVERSATION, "role", "digest")
        .agg(F.min(F.struct("has_turn", "at_turn")).alias("place"))
        .select(*_CONVERSATION, "role", "digest", "place.*", F.lit(True).alias("first"))
    )
    known = turns.join(firsts, list(_PLACE), "left").select(
        *_PLACE, "rows", F.coalesce("first", F.lit(False)).alias("first"),
        (F.col("end") == "").alias("blank"), (~F.col("end").isin(".", "!", "?")).alias("cut"),
    )
    ids = every.select(
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
    ).distinct()
    return known.unionByName(
        ids.select(
            *_CONVERSATION, F.lit(False).alias("has_turn"), F.lit(0).cast("long").alias("at_turn"),
            F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("rows"),
            *(F.lit(False).alias(name) for name in ("first", "blank", "cut")),
        )
    )


# ---- symbols -------------------------------------------------------------------------------------

_INITIALS = ("s", "u", "a", "", "other")
#: A row that must go; then each initial without and with the fault of a truncated row.
GONE = "\x01"
SYMBOL = {
    (initial, cut): chr(2 + 2 * k + cut) for k, initial in enumerate(_INITIALS) for cut in (0, 1)
}

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SEGMENT_FIELDS = [
    ("no_id", pa.bool_()), ("conv", pa.int64()), ("at", pa.int64()), ("symbols", pa.string()),
    *((name, pa.int64()) for name in _COUNTS), ("head", pa.string()), ("tail", pa.string()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
]
_SEGMENTS = (
    "no_id boolean, conv long, at long, symbols string, blank long, duplicate long, "
    "truncated long, illegal long, head string, tail string, low long, high long, turns long"
)
_LEGAL = ("su", "ua", "au")


class _Segment:
    """Rows of one conversation in order: symbols, counts, and what the neighbours need to know."""

    def __init__(self, key: tuple, at: int):
        self.key, self.at, self.symbols, self.count = key, at, [], dict.fromkeys(_COUNTS, 0)
        self.head = self.tail = self.low = self.high = None
        self.turns = 0

    def add(self, row: dict, first: bool, n: int) -> None:
        """`n` equal rows, of which the first may be the first of its kind."""
        initial = row["role"][:1]
        repeated = n - first
        if row["blank"]:
            self.count["blank"] += n
            self.symbols.append(GONE * n)
        else:
            self.count["duplicate"] += repeated
            self.count["truncated"] += first and row["cut"]
            own = SYMBOL[initial if initial in _INITIALS else "other", int(row["cut"])]
            self.symbols.append(own * first + GONE * repeated)
        if self.head is None:
            self.head = initial
        elif self.tail + initial not in _LEGAL:
            self.count["illegal"] += 1
        # A role never follows itself.
        self.count["illegal"] += n - 1
        self.tail = initial
        if row["has_turn"]:
            self.turns += row["at_turn"] != self.high
            self.low = row["at_turn"] if self.low is None else self.low
            self.high = row["at_turn"]

    def row(self) -> tuple:
        symbols = "".join(self.symbols)
        return (*self.key, self.at, symbols, *self.count.values(), self.head, self.tail,
                self.low, self.high, self.turns)


def segments(known: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Conversations in order, cut at ranges of the sort and after `size` rows."""
    schema = pa.schema(_SEGMENT_FIELDS)

    def cut(batches: Batches) -> Iterator[tuple]:
        base, number, open_, left = TaskContext.get().partitionId() << 32, 0, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["no_id"], row["conv"])
                if open_ is None or open_.key != key:
                    if open_ is not None:
                        yield open_.row()
                    open_, left = _Segment(key, base + number), size
                    number += 1
                rest, first = row["rows"], row["first"]
                while rest:
                    if not left:
                        yield open_.row()
                        open_, left = _Segment(key, base + number), size
                        number += 1
                    n = min(rest, left)
                    open_.add(row, first, n)
                    rest, left, first = rest - n, left - n, False
        if open_ is not None:
            yield open_.row()

    ordered = known.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
    return ordered.drop("digest").mapInArrow(_in_batches(cut, schema), _SEGMENTS)


def _in_batches(rows: Callable, schema: pa.Schema, size: int = 512, most: int = 1 << 22) -> Callable:
    """A mapInArrow function from one that yields tuples; batches end at `size` rows or `most` characters."""

    def run(batches: Batches) -> Batches:
        held, wide = [], 0
        for row in rows(batches):
            held.append(row)
            wide += sum(len(x) for x in row if isinstance(x, str))
            if len(held) == size or wide > most:
                yield _batch(held, schema)
                held, wide = [], 0
        if held:
            yield _batch(held, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


# ---- matrices ------------------------------------------------------------------------------------

#: Before any row, after system, after user, after assistant; a conversation may end in the first and last.
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
ENDS = (START, ASSISTANT)

#: Audit of a way: a text, or two audits one after the other.
Rope = str | tuple
Way = tuple[int, Rope]
Matrix = dict[tuple[int, int], Way]


def text_of(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            stack += (part[1], part[0])
    return "".join(out)


def better(new: Way, old: Way | None) -> bool:
    """Cheaper, or as cheap with the lesser audit.

    Audits of equal cost over the same rows are never prefixes of each other, as each letter more
    costs more; so the lesser part makes the lesser whole.
    """
    if old is None or new[0] != old[0]:
        return old is None or new[0] < old[0]
    return new[1] is not old[1] and text_of(new[1]) < text_of(old[1])


def joined(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: all ways through the rows of `a`, then those of `b`."""
    out: Matrix = {}
    for (i, k), (cost, audit) in a.items():
        for j in STATES:
            way = b.get((k, j))
            if way is not None:
                rope = (audit, way[1]) if audit and way[1] else audit or way[1]
                new = (cost + way[0], rope)
                if better(new, out.get((i, j))):
                    out[i, j] = new
    return out


def _after(state: int, initial: str) -> int | None:
    if initial == "":
        return state
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _inserted() -> Matrix:
    out: Matrix = {}
    for i in STATES:
        state = i
        for n in range(3):
            new = (n * INSERT, "I" * n)
            if better(new, out.get((i, state))):
                out[i, state] = new
            state = ASSISTANT if state == USER else USER
    return out


INSERTED = _inserted()


def _edited(initial: str, cut: int, gone: bool) -> Matrix:
    out: Matrix = {}
    for i in STATES:
        ways = [(i, DELETE, "D")]
        if not gone:
            ways.append((_after(i, initial), TRUNCATED * cut, "K"))
            ways.append((ASSISTANT if i == USER else USER, REROLE + TRUNCATED * cut, "R"))
        for j, cost, audit in ways:
            if j is not None and better((cost, audit), out.get((i, j))):
                out[i, j] = (cost, audit)
    return out


#: What one row does, inserts before it included.
TERMINALS: dict[str, Matrix] = {GONE: joined(INSERTED, _edited("", 0, True))} | {
    symbol: joined(INSERTED, _edited(initial, cut, False))
    for (initial, cut), symbol in SYMBOL.items()
}
#: What no row does.
NOTHING: Matrix = {(i, i): (0, "") for i in STATES}

# ---- grammar -------------------------------------------------------------------------------------

Rules = list[tuple[str, str]]  # pair of symbols, symbol


def compressed(symbols: str, rules: Rules) -> str:
    for pair, symbol in rules:
        symbols = symbols.replace(pair, symbol)
    return symbols


def pairs(symbols: str) -> Counter:
    """How often each pair could be replaced; of a run of one symbol, every second pair."""
    found = Counter(map("".join, zip(symbols, symbols[1:])))
    for pair in found:
        if pair[0] == pair[1]:
            found[pair] = symbols.count(pair)
    return found


def learn(distinct: DataFrame, rounds: int = ROUNDS, most: int = MOST_RULES) -> Rules:
    """Re-Pair over weighted distinct segments: (`symbols`, `n`).

    A round replaces the most frequent pairs that share no symbol, so none changes the others' counts.
    """
    schema = pa.schema([("pair", pa.string()), ("n", pa.int64())])
    rules: Rules = []
    for _ in range(rounds):

        def count(batches: Batches, rules: Rules = tuple(rules)) -> Batches:
            total: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(*(batch.column(k).to_pylist() for k in ("symbols", "n"))):
                    for pair, times in pairs(compressed(symbols, rules)).items():
                        total[pair] += n * times
            yield _batch(list(total.items()) or [("", 0)], schema)

        counted = distinct.mapInArrow(count, "pair string, n long").groupBy("pair")
        counted = counted.agg(F.sum("n").alias("n")).filter("n > 1 AND pair != ''")
        used, found = set(), []
        for row in counted.orderBy(F.col("n").desc(), "pair").limit(64).collect():
            if not used & set(row["pair"]):
                used |= set(row["pair"])
                found.append(row["pair"])
        found = found[: most - len(rules)]
        rules += [(pair, chr(0x100 + len(rules) + k)) for k, pair in enumerate(found)]
        if not found:
            break
    return rules


def matrices(rules: Rules) -> dict[str, Matrix]:
    """Of every symbol, rules from their parts."""
    out = dict(TERMINALS)
    for pair, symbol in rules:
        out[symbol] = joined(out[pair[0]], out[pair[1]])
    return out


def through(symbols: str, rules: Rules, known: dict[str, Matrix]) -> Matrix:
    """What a segment does. Neighbours are joined in a tree, so that ropes stay shallow."""
    level = [known[symbol] for symbol in compressed(symbols, rules)] or [NOTHING]
    while len(level) > 1:
        level = [joined(*level[k : k + 2]) if k + 1 < len(level) else level[k]
                 for k in range(0, len(level), 2)]
    return level[0]


# ---- audits --------------------------------------------------------------------------------------

_WAYS = [f"{name}_{i}{j}" for i, j in product(STATES, STATES) for name in ("cost", "audit")]
_KEPT = [name for name, _ in _SEGMENT_FIELDS if name != "symbols"]
_AUDITS = (
    "no_id boolean, conv long, gaps long, blank long, duplicate long, truncated long, "
    "illegal long, cost long, audit string"
)


def segment_matrices(cut: DataFrame, rules: Rules) -> DataFrame:
    """Segments with their matrix in place of their symbols."""
    fields = [f for f in _SEGMENT_FIELDS if f[0] != "symbols"]
    fields += [(name, pa.int64() if name[0] == "c" else pa.string()) for name in _WAYS]

    def evaluate(batches: Batches) -> Iterator[tuple]:
        known, seen = matrices(rules), {}
        for batch in batches:
            for row in batch.to_pylist():
                symbols = row["symbols"]
                if symbols not in seen:
                    if len(seen) > 1 << 12:
                        seen.clear()
                    matrix = through(symbols, rules, known)
                    ways = (matrix.get((i, j), (None, None)) for i, j in product(STATES, STATES))
                    flat = ((c, r if r is None else text_of(r)) for c, r in ways)
                    seen[symbols] = tuple(x for way in flat for x in way)
                yield (*(row[name] for name in _KEPT), *seen[symbols])

    ways = ", ".join(f"{n} {'long' if n[0] == 'c' else 'string'}" for n in _WAYS)
    schema = ", ".join(p for p in _SEGMENTS.split(", ") if p != "symbols string")
    return cut.mapInArrow(_in_batches(evaluate, pa.schema(fields)), f"{schema}, {ways}")


class _Whole:
    """A conversation while its segments come by in order."""

    def __init__(self, key: tuple):
        self.key, self.count = key, dict.fromkeys(_COUNTS, 0)
        self.tail = self.low = self.high = None
        self.turns = 0
        self.ways: Matrix = {(START, START): (0, "")}

    def add(self, row: dict) -> None:
        for name in _COUNTS:
            self.count[name] += row[name]
        if row["head"] is not None:
            if self.tail is not None and self.tail + row["head"] not in _LEGAL:
                self.count["illegal"] += 1
            self.tail = row["tail"]
        if row["low"] is not None:
            self.turns += row["turns"] - (self.high == row["low"])
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        matrix = {
            (i, j): (row[f"cost_{i}{j}"], row[f"audit_{i}{j}"])
            for i, j in product(STATES, STATES)
            if row[f"cost_{i}{j}"] is not None
        }
        self.ways = joined(self.ways, matrix)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        best = None
        for (_, j), way in joined(self.ways, INSERTED).items():
            if j in ENDS and better(way, best):
                best = way
        return (*self.key, gaps, *self.count.values(), best[0], text_of(best[1]))


def audits(cut: DataFrame) -> DataFrame:
    """Counts, cost and audit of whole conversations from their segments' matrices."""
    types = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}
    fields = [part.split(" ") for part in _AUDITS.split(", ")]

    def run(batches: Batches) -> Iterator[tuple]:
        whole = None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["no_id"], row["conv"])
                if whole is None or whole.key != key:
                    if whole is not None:
                        yield whole.row()
                    whole = _Whole(key)
                whole.add(row)
        if whole is not None:
            yield whole.row()

    schema = pa.schema([(name, types[kind]) for name, kind in fields])
    ordered = cut.repartition(*_CONVERSATION).sortWithinPartitions(*_CONVERSATION, "at")
    return ordered.mapInArrow(_in_batches(run, schema), _AUDITS)


# ---- repair --------------------------------------------------------------------------------------


def edits(rows: DataFrame, every: DataFrame, work: WorkFolder, size: int = SEGMENT) -> DataFrame:
    """Counts of faults, cost and audit of every conversation."""
    cut = work.write(segments(faults(rows, every), size), "segments")
    distinct = work.write(cut.groupBy("symbols").agg(F.count("*").alias("n")), "distinct")
    rules = learn(distinct)
    ways = work.write(segment_matrices(cut, rules), "ways")
    return work.write(audits(ways), "audits")


def _repaired(rows: Iterator[dict]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """Each conversation's audit row, and its (edit, role, text) rows as they come; read them in order."""
    waiting = next(rows, None)

    def walk(audit: str) -> Iterator[tuple[str, str, str]]:
        nonlocal waiting
        state = START
        for edit in audit:
            role = "assistant" if state == USER else "user"
            if edit == "I":
                yield edit, role, ""
            else:
                row, waiting = waiting, next(rows, None)
                if edit == "D":
                    continue
                if edit == "K":
                    role = row["role"]
                yield edit, role, row["text"]
            state = _after(state, role[:1])

    while waiting is not None:
        head, waiting = waiting, next(rows, None)
        yield head, walk(head["audit"])


def _ordered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in order, in one task."""
    placed = _placed(rows).withColumn("kind", F.lit(1))
    return (
        found.withColumn("kind", F.lit(0))
        .unionByName(placed, allowMissingColumns=True)
        .repartition(*_CONVERSATION)
        .sortWithinPartitions(*_CONVERSATION, "kind", "has_turn", "at_turn", "role", "digest")
        .drop("kind", "has_turn", "at_turn", "digest")
    )


def _each(batches: Batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: `conv_id, place, edit, role, text`, deleted rows left out."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()),
                        ("role", pa.string()), ("text", pa.string())])

    def run(batches: Batches) -> Iterator[tuple]:
        for head, out in _repaired(_each(batches)):
            key = None if head["no_id"] else head["conv"]
            for place, (edit, role, text) in enumerate(out):
                yield key, place, edit, role, text

    return _ordered(rows, found).mapInArrow(
        _in_batches(run, schema), "conv_id long, place long, edit string, role string, text string"
    )


_REPORT = ("gaps", *_COUNTS, "cost")


def repair(rows: DataFrame, every: DataFrame | None = None, size: int = SEGMENT) -> DataFrame:
    """Per conversation its faults, the cost and audit of its repair, and a digest of the repaired rows.

    `every` names conversations to report that may have no rows.
    """
    work = WorkFolder(rows.sparkSession, "conversations")
    found = edits(rows, rows if every is None else every, work, size)
    schema = pa.schema([("conv_id", pa.int64()), *((name, pa.int64()) for name in _REPORT),
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Batches) -> Iterator[tuple]:
        for head, out in _repaired(_each(batches)):
            digest = hashlib.sha256()
            for n, (_, role, text) in enumerate(out):
                digest.update((("\n" if n else "") + f"{role}:{text}").encode())
            yield (None if head["no_id"] else head["conv"], *(head[name] for name in _REPORT),
                   head["audit"], digest.hexdigest())

    numbers = ", ".join(f"{name} long" for name in _REPORT)
    digests = _ordered(rows, found).mapInArrow(
        _in_batches(run, schema), f"conv_id long, {numbers}, audit string, repaired_sha256 string"
    )
    return work.write(digests, "report")
