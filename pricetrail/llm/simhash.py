"""SimHash near-duplicates by the generalised pigeonhole principle.

Each text gets a 64-bit fingerprint of its word shingles. Texts whose fingerprints differ in few bits
are linked, and connected texts form a component. Links are found between distinct fingerprints:

1. Correlated bits are grouped into partitions, so that the partitions differ as independently as
   possible (statistics of every distinct fingerprint, gathered as sums of 64 x 64 numbers).
2. Dynamic programming gives each partition its own threshold e_i, minus one (partition unused) or
   more, with sum d - m + 1 for distance d and m partitions, at the least estimated cost of probes and
   candidates. If two fingerprints differ in at most d bits, some partition differs in at most e_i.
3. Each fingerprint probes the values within e_i of its own; the bits of both are compared in full.

Within a bucket the linked fingerprints are reported as a spanning forest, not as all pairs; a bucket
with many members is cut into blocks, and each pair of blocks is one unit of work. Nothing is capped
and connectivity stays exact.

Null text counts as empty; texts without a word have fingerprint zero and are linked like any other.
Equal texts share a fingerprint; repeated rows stay repeated. A row with null id takes part with its
fingerprint, and a component of null ids only has a null id. An empty table gives an empty result;
other columns are not read.
"""

from collections.abc import Iterator
from itertools import accumulate
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import Batches, WorkFolder
from pricetrail.llm.components import connected_components

BITS = 64
SEED = 42
#: Members of a bucket that are compared as one block.
BLOCK = 512
#: Relative cost of moving one probe row, and of comparing one candidate pair.
PROBE_COST, PAIR_COST = 2e-6, 4e-9


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle of `width` words of the ASCII-lower-cased text, repeats included."""
    words = text.encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])] or [
        digest(joined, SEED)
    ]
    return np.array(hashes, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit is set where over half of the hashes have it."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8").view(np.uint8)
        counts += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    bits = 2 * counts > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(
    df: DataFrame, width: int, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """`key` and `fp` (the 64 bits as a signed long) of every row."""
    schema = pa.schema([(key, pa.int64()), ("fp", pa.int64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            values = [
                fingerprint(shingle_hashes(value.as_py() or "", width))
                for value in batch.column("_text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(np.array(values, np.uint64).view(np.int64))],
                schema=schema,
            )

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` long, fp long")


# ---- partitions and thresholds -----------------------------------------------------------------


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them each two bits are set together."""

    def run(batches: Batches) -> Batches:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(fps), 1 << 14):
                part = fps[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float64)
                both += bits.T @ bits
                n += len(bits)
        cells = np.concatenate([[n], both.ravel()]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "n"]
        )

    cells = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell")
    sums = np.zeros(1 + BITS * BITS, np.int64)
    for cell, n in cells.agg(F.sum("n").alias("n")).collect():  # 4,097 rows whatever the input
        sums[cell] = n
    return int(sums[0]), sums[1:].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near-equal size, each gathering the bits most correlated with it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    strength = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - k)
        seed = max(free, key=lambda b: (spread[b], -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def within(n: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs of fingerprints that differ in at most 0, 1, ... `most` of `bits`."""
    differ = np.zeros(len(bits) + 1)
    differ[0] = 1
    for b in bits:
        p = both[b, b] / max(n, 1)
        q = 2 * p * (1 - p)
        differ[1:] = differ[1:] * (1 - q) + differ[:-1] * q
        differ[0] *= 1 - q
    return np.cumsum(differ)[: most + 1]


def allocate(
    n: int, both: np.ndarray, groups: list[list[int]], distance: int
) -> tuple[float, list[int]]:
    """Cheapest thresholds of the groups with sum distance - groups + 1, each at least -1."""
    total = distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        share = within(n, both, bits, distance)
        costs = {-1: 0.0} | {
            e: n * sum(comb(len(bits), j) for j in range(e + 1)) * PROBE_COST
            + n * n / 2 * share[e] * PAIR_COST
            for e in range(min(distance, len(bits)) + 1)
        }
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for e, more in costs.items():
                at = spent + e
                if at not in following or cost + more < following[at][0]:
                    following[at] = (cost + more, [*chosen, e])
        best = following
    return best[total]


def plan_probes(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The partitions in use with their thresholds, over the number of partitions that costs least."""
    plans = []
    for parts in range(2, min(2 * distance, 16) + 2):
        groups = group_bits(n, both, parts)
        cost, chosen = allocate(n, both, groups, distance)
        plans.append((cost, parts, [(g, e) for g, e in zip(groups, chosen) if e >= 0]))
    return min(plans, key=lambda plan: plan[:2])[2]


# ---- probes and links --------------------------------------------------------------------------


def _gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    values = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        values |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return values


def _masks(width: int, most: int) -> np.ndarray:
    """All values of `width` bits with at most `most` bits set; zero first."""
    masks = last = [(0, -1)]
    for _ in range(most):
        last = [(m | 1 << b, b) for m, top in last for b in range(top + 1, width)]
        masks = masks + last
    return np.array([m for m, _ in masks], np.uint64)


def probe_rows(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(bucket, fp, home): the fingerprint's own value of each partition (home), and those nearby."""
    schema = pa.schema([("part", pa.int32()), ("value", pa.int64()), ("fp", pa.int64()),
                        ("home", pa.bool_())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            fps = signed.view(np.uint64)
            for k, (bits, most) in enumerate(plan):
                values = _gather(fps, bits)
                for mask in _masks(len(bits), most):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fps), k, np.int32)),
                         pa.array((values ^ mask).view(np.int64)), pa.array(signed),
                         pa.array(np.full(len(fps), mask == 0))],
                        schema=schema,
                    )

    return distinct.select("fp").mapInArrow(run, "part int, value long, fp long, home boolean")


def forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the index of its tree's root, where left and right rows link."""
    parent = np.arange(len(fps))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        near = np.bitwise_count(fps[rows][:, None] ^ fps[right][None, :]) <= distance
        for k, row in enumerate(rows):
            a = root(row)
            # Most links of a dense bucket are inside a tree already; only the others are joined.
            linked = right[near[k]]
            for other in np.unique(parent[linked]):
                b = root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    a = min(a, b)
    return np.array([root(x) for x in range(len(fps))], np.int64)


def bucket_links(probes: DataFrame, distance: int, work: WorkFolder, block: int) -> DataFrame:
    """(a, b): links between fingerprints that connect what the buckets connect."""
    keys = ["part", "value"]
    sizes = probes.groupBy(keys).agg(F.count("*").alias("size"))
    large = work.write(sizes.where(F.col("size") > block), "large")
    # Blocks of a large bucket: a member is in block x of g and meets it with every block.
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    rows = (
        probes.join(large.hint("merge"), keys, "left")
        .withColumn("g", F.coalesce(blocks, F.lit(1)))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select(
            *keys,
            F.least("mine", "other").alias("lo"),
            F.greatest("mine", "other").alias("hi"),
            (F.col("mine") <= F.col("other")).alias("low"),
            "fp",
            "home",
        )
    )
    unit = [*keys, "lo", "hi"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of whole units, ordered."""
        columns = [table.column(c).to_numpy() for c in unit]
        fps = table.column("fp").to_numpy().view(np.uint64)
        home, low = table.column("home").to_numpy(), table.column("low").to_numpy()
        change = np.zeros(len(fps), bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(fps)]
        a, b = [], []
        for start, end in zip(starts, starts[1:]):
            if end - start < 2:
                continue
            own = fps[start:end]
            first = np.flatnonzero(low[start:end])
            same = columns[2][start] == columns[3][start]
            second = first if same else np.flatnonzero(~low[start:end])
            at_home = home[start:end]
            # Visitors of a bucket are compared with those at home, not with each other.
            trees = forest(own, first[at_home[first]], second, distance)
            joined = trees != np.arange(len(own))
            a.append(own[joined])
            b.append(own[trees[joined]])
            if not at_home.all() and not same:
                trees = forest(own, second[at_home[second]], first, distance)
                joined = trees != np.arange(len(own))
                a.append(own[joined])
                b.append(own[trees[joined]])
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a).view(np.int64)),
                 pa.array(np.concatenate(b).view(np.int64))], schema=schema,
            )

    def run(batches: Batches) -> Batches:
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part])
            last = {c: part.column(c)[-1].as_py() for c in unit}
            same = np.ones(len(part), bool)
            for c in unit:
                same &= part.column(c).to_numpy() == last[c]
            cut = int(np.argmax(same))  # the last unit may go on in the next batch
            yield from links(part.slice(0, cut))
            rest = part.slice(cut)
        if rest is not None and len(rest):
            yield from links(rest)

    return (
        rows.repartition(*unit)
        .sortWithinPartitions(*unit)
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def near_duplicates(
    df: DataFrame,
    width: int,
    distance: int,
    text: str = "text",
    key: str = "doc_id",
    block: int = BLOCK,
) -> DataFrame:
    """`key`, `fingerprint` (16 hex digits) and `component_id` (smallest key reachable)."""
    work = WorkFolder(df.sparkSession, "simhash")
    marked = work.write(fingerprints(df, width, text, key), "fingerprints")
    distinct = work.write(
        marked.groupBy("fp").agg(F.min(key).alias("first_id"), F.count("*").alias("rows")),
        "distinct",
    )
    n, both = bit_statistics(distinct)
    plan = plan_probes(n, both, distance)
    probes = work.write(probe_rows(distinct, plan), "probes")
    links = work.write(bucket_links(probes, distance, work, block), "links")
    # Every fingerprint that has a link, with one fingerprint to stand for its component.
    members = connected_components(links, work)
    named = work.write(
        distinct.join(members.select(F.col("node").alias("fp"), "component"), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp"))
        .select("fp", "first_id", "component"),
        "named",
    )
    smallest = work.write(
        named.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest"
    )
    classes = work.write(
        named.join(smallest.hint("merge"), "component").select("fp", "component_id"), "classes"
    )
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(classes.hint("merge"), "fp").select(
        key, digits.alias("fingerprint"), "component_id"
    )
