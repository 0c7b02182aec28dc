"""Removal of repeated byte strings, exact, by ranks of growing strings at sampled positions.

A byte goes when a string of LENGTH bytes that covers it starts anywhere else too, in the same document or
another. Plain prefix doubling ranks every position of the corpus in every round; this is its sparse form:

* Every string of LENGTH bytes picks one anchor in itself, the place of its smallest K-byte hash, the
  first of equals. Equal strings pick the same place, so that only strings around anchors of equal rank
  can repeat. About one position in 70 is an anchor; it speaks for the strings that picked it.
* A node is an anchor with a range of offsets, the strings that start so far before it. Its core is what
  these strings share, its hull all that they cover. A round ranks nodes by the pair (core, hull), both
  fingerprints of text: equal hulls repeat all strings of the range, a core of its own none. Only where
  one core has different hulls, nodes are split, and the next round ranks longer cores at further offsets:
  K bytes, then nearly LENGTH, then the strings themselves. Ranks stop growing past that threshold.

For a hull that repeats, one node goes on to the next round in the place of all its copies, so that no
group's size is carried along. Groups are counted with partial aggregation; rows learn of their group
by joins of two plainly exchanged tables, in which large groups can be split. Equal texts are ranked once
and count as often as they occur.

Null text counts as empty; texts shorter than LENGTH bytes stay whole. Repeated rows are copies: both go.
Rows with null ids are kept as such. An empty table gives an empty result; other columns are not read.
"""

import hashlib
from dataclasses import dataclass
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import Batches, WorkFolder

LENGTH = 200
#: Bytes that are hashed in one go.
CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)
#: A node in one number: position, first offset of the range, offsets the anchor speaks for.
_POSITION, _OFFSET, _LEAST = 24, 16, 8


@dataclass(frozen=True)
class Sampling:
    """Anchors of strings of `length` bytes; offsets are split by `step` twice, down to one."""

    length: int = LENGTH

    def __post_init__(self):
        if not 4 <= self.length <= 340:  # offsets are packed in eight bits
            raise ValueError("strings of 4 to 340 bytes")

    @property
    def step(self) -> int:
        return max(isqrt(3 * self.length // 4), 1)

    @property
    def offsets(self) -> int:
        return self.step * self.step

    @property
    def gram(self) -> int:
        return self.length - self.offsets + 1

    def width(self, level: int) -> int:
        """Offsets in a node's range."""
        return (self.offsets, self.step, 1)[level]

    @cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(11)
        letters = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

        def powers(base: int) -> np.ndarray:
            each = np.full(CHUNK + 1, base, np.uint64)
            each[0] = 1
            return each.cumprod(dtype=np.uint64)

        return letters, powers(_BASE), powers(pow(_BASE, -1, 1 << 64))

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        """Mixed polynomial hash of the `gram` bytes from each place on, modulo 2**64."""
        letters, power, inverse = self._tables
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * power[: len(data)], out=sums[1:], dtype=np.uint64)
        k = self.gram
        hashes = (sums[k:] - sums[:-k]) * inverse[: len(data) - k + 1]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        return hashes ^ (hashes >> np.uint64(32))

    def _chunk(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(string's document, anchor, hash, first and last string of the run) in `data`."""
        counts = np.maximum(sizes - self.length + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), counts)
        if not len(owner):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) + (
                np.zeros(0, np.int64),
            ) * 2
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = starts[owner] + within
        hashes = self._hashes(np.frombuffer(data, np.uint8))
        # Smallest high bits, then the first place: both depend on the string alone.
        keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        w = self.offsets
        blocks = np.pad(keys, (0, -len(keys) % w), constant_values=~np.uint64(0)).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[place], ahead[place + w - 1]) & _LOW).astype(np.int64)
        new = np.ones(len(owner), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(owner)) - 1
        return owner[first], anchor[first], hashes[anchor[first]], place[first], place[last]

    def anchors(self, texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
        """Per text: anchors' positions, hashes, and the first and last string each speaks for."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64)) + (np.zeros(0, np.int64),) * 2
        out = [none] * len(texts)
        at = 0
        while at < len(texts):
            if len(texts[at]) > CHUNK:
                out[at] = self._long(texts[at])
                at += 1
                continue
            end, size = at, 0
            while end < len(texts) and size + len(texts[end]) <= CHUNK:
                size += len(texts[end])
                end += 1
            sizes = np.array([len(t) for t in texts[at:end]])
            starts = np.cumsum(sizes) - sizes
            owner, *columns = self._chunk(b"".join(texts[at:end]), starts, sizes)
            cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                position, hashes, first, last = (c[a:b] for c in columns)
                out[at + k] = (position - starts[k], hashes, first - starts[k], last - starts[k])
            at = end
        return out

    def _long(self, text: bytes) -> tuple[np.ndarray, ...]:
        """In overlapping chunks; an anchor that two of them see is one anchor."""
        parts, start = [], 0
        while start + self.length <= len(text):
            data = text[start : start + CHUNK]
            _, position, hashes, first, last = self._chunk(
                data, np.zeros(1, np.int64), np.array([len(data)])
            )
            parts.append((position + start, hashes, first + start, last + start))
            start += len(data) - self.length + 1
        position, hashes, first, last = map(np.concatenate, zip(*parts))
        new = np.append(True, position[1:] != position[:-1])
        runs = np.flatnonzero(new)
        return position[new], hashes[new], first[new], last[np.append(runs[1:], len(new)) - 1]


def node_columns(node: Column) -> tuple[Column, Column]:
    """Position and first offset of a packed node."""
    offset = F.shiftright(node, _OFFSET).bitwiseAND(F.lit(255))
    return F.shiftright(node, _POSITION), offset


def _pair(data: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(data)
    low, high = value & (1 << 64) - 1, value >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


def _children(sampling: Sampling, nodes: list[int], level: int) -> list[int]:
    """The nodes of `level` within those of the level before that their anchors speak for."""
    width, out = sampling.width(level), []
    for node in nodes:
        position, offset = node >> _POSITION, node >> _OFFSET & 255
        least, most = node >> _LEAST & 255, node & 255
        end = offset + sampling.width(level - 1)
        for lo in range(offset, end, width):
            if lo <= most and lo + width > least:
                out.append(position << _POSITION | lo << _OFFSET | least << _LEAST | most)
    return out


def scan(df: DataFrame, sampling: Sampling, text: str, key: str) -> DataFrame:
    """One row per row: a number of its own, its size, its digest, and its anchors' hashes."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [value.as_py() for value in batch.column("_data")]
            found = sampling.anchors(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("row"),
                 pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                 pa.array([f[0] for f in found], pa.list_(pa.int32())),
                 pa.array([f[1].view(np.int64) for f in found], pa.list_(pa.int64()))],
                names=[key, "row", "n_bytes", "digest", "places", "hashes"],
            )

    rows = df.select(
        F.col(key).cast("long").alias(key), F.monotonically_increasing_id().alias("row"),
        _data(text).alias("_data"),
    )
    return rows.mapInArrow(
        run,
        f"`{key}` long, row long, n_bytes long, digest string, places array<int>, "
        "hashes array<long>",
    )


def _data(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def first_nodes(texts: DataFrame, sampling: Sampling) -> DataFrame:
    """Texts (row, copies, data, places) with their nodes of level 0."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data = [value.as_py() for value in batch.column("data")]
            nodes = []
            for (position, _, first, last), places in zip(
                sampling.anchors(data), batch.column("places")
            ):
                keep = np.isin(position, places.values.to_numpy())
                position, first, last = position[keep], first[keep], last[keep]
                nodes.append(
                    position << _POSITION | (position - last) << _LEAST | (position - first)
                )
            place = batch.schema.get_field_index("places")
            yield batch.set_column(place, "nodes", pa.array(nodes, pa.list_(pa.int64())))

    return texts.mapInArrow(run, "row long, copies long, data binary, nodes array<long>")


def ranked(texts: DataFrame, sampling: Sampling, level: int) -> DataFrame:
    """(row, node, core, hull_a, hull_b, whole, n): the rank pair of every node of the texts.

    A hull that its document cuts short has a rank of its own and is not `whole`. `weights` are one
    for nodes still open, two for those that stand for repeated ones.
    """
    width, length = sampling.width(level), sampling.length
    last_level = width == 1
    kinds = ("row", "node", "core", "hull_a", "hull_b")
    schema = pa.schema([(c, pa.int64()) for c in kinds] + [("whole", pa.bool_()),
                                                           ("n", pa.int32())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            size = 0
            lists = (batch.column(c).to_pylist() for c in ("row", "copies", "nodes", "weights"))
            for value, row, copies, nodes, weights in zip(batch.column("data"), *lists):
                data = value.as_py()
                weight = {}
                for node, w in zip(nodes, weights or [1] * len(nodes)):
                    for child in _children(sampling, [node], level) if level else [node]:
                        weight[child] = w
                for node, w in weight.items():
                    position, lo = node >> _POSITION, node >> _OFFSET & 255
                    start, end = position - lo - width + 1, position - lo + length
                    whole = start >= 0 and end <= len(data)
                    if last_level and not whole:
                        continue
                    core = (
                        0 if last_level
                        else _pair(data[position - lo : end - width + 1])[0]
                    )
                    hull = _pair(data[start:end]) if whole else (row, node)
                    for column, cell in zip(
                        columns, (row, node, core, *hull, whole, 2 if copies > 1 else w)
                    ):
                        column.append(cell)
                size += 1
                if len(columns[0]) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                    )
                    columns = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

    return texts.mapInArrow(
        run,
        "row long, node long, core long, hull_a long, hull_b long, whole boolean, n int",
    )


def repeated_marks(
    texts: DataFrame, sampling: Sampling, level: int, work: WorkFolder
) -> tuple[DataFrame, DataFrame | None]:
    """(row, first, last) strings that repeat, and (row, nodes, weights) to split in the next round."""
    names = work.write(ranked(texts, sampling, level), f"ranks-{level}")
    hull = ["hull_a", "hull_b"]
    groups = names.groupBy("core", *hull, "whole").agg(
        F.sum("n").alias("n"), F.min(F.struct("row", "node")).alias("one")
    )
    groups = work.write(groups, f"groups-{level}")
    repeated = groups.where((F.col("n") >= 2) & F.col("whole")).select("core", *hull)
    done = names.where("whole").join(repeated.hint("merge"), ["core", *hull], "left_semi")
    position, offset = node_columns(F.col("node"))
    marks = done.select(
        "row",
        (position - offset - (sampling.width(level) - 1)).alias("first"),
        (position - offset).alias("last"),
    )
    marks = work.write(
        marks.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("marks")),
        f"marks-{level}",
    )
    further = None
    if sampling.width(level) > 1:
        # Cores with different hulls: split one node of each.
        several = groups.groupBy("core").agg(F.count("*").alias("hulls")).where("hulls > 1")
        several = work.write(several.select("core"), f"cores-{level}")
        split = groups.join(several.hint("merge"), "core", "left_semi").select(
            F.col("one.row").alias("row"), F.col("one.node").alias("node"),
            F.least("n", F.lit(2)).cast("int").alias("weight"),
        )
        pairs = F.collect_list(F.struct("node", "weight"))
        further = work.write(
            split.groupBy("row").agg(pairs.alias("pairs")).select(
                "row", F.col("pairs.node").alias("nodes"), F.col("pairs.weight").alias("weights")
            ),
            f"further-{level}",
        )
    work.drop(f"ranks-{level}", f"groups-{level}")
    return marks, further


def cut_spans(size: int, marks: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under strings that start in the marked ranges."""
    spans: list[tuple[int, int]] = []
    for first, last in sorted(marks):
        start, end = first, min(last + length, size)
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((start, end))
    return spans


def repeated_spans(
    df: DataFrame, work: WorkFolder, text: str = "text", key: str = "doc_id", length: int = LENGTH
) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (key, n_bytes, digest), and (digest, data, spans) of texts with repeats."""
    sampling = Sampling(length)
    scanned = work.write(scan(df, sampling, text, key), "scanned")
    # Ranks of the anchors' K bytes: those of their own are out at once.
    shared = scanned.select(F.explode("hashes").alias("hash")).groupBy("hash")
    shared = work.write(
        shared.agg(F.count("*").alias("n")).where("n > 1").select("hash"), "hashes"
    )
    places = F.explode(F.arrays_zip("places", "hashes"))
    anchors = scanned.select("row", places.alias("a")).select(
        "row", F.col("a.places").alias("place"), F.col("a.hashes").alias("hash")
    )
    kept = work.write(
        anchors.join(shared.hint("merge"), "hash", "left_semi")
        .groupBy("row")
        .agg(F.collect_list("place").alias("places")),
        "kept",
    )
    # One row stands for all with its text.
    ones = scanned.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    ones = work.write(ones, "ones")
    wanted = work.write(
        kept.join(ones.hint("merge"), "row").select("digest", "row", "copies", "places"), "wanted"
    )
    data = df.select(_data(text).alias("data"))
    data = data.groupBy(F.sha2("data", 256).alias("digest")).agg(F.first("data").alias("data"))
    found = data.join(wanted.hint("merge"), "digest").select("row", "copies", "data", "places")
    texts = work.write(first_nodes(found, sampling), "texts")
    none = F.lit(None).cast("array<int>")
    marks, further = repeated_marks(texts.withColumn("weights", none), sampling, 0, work)
    every = [marks]
    content = texts.select("row", "copies", "data")
    for level in (1, 2):
        split = content.join(further.hint("merge"), "row")
        marks, further = repeated_marks(
            split.select("row", "copies", "data", "nodes", "weights"), sampling, level, work
        )
        every.append(marks)
    marked = every[0].union(every[1]).union(every[2]).groupBy("row")
    marked = work.write(
        marked.agg(F.flatten(F.collect_list("marks")).alias("marks")), "marked"
    )
    repeats = content.join(marked.hint("merge"), "row", "left").where(
        "marks IS NOT NULL OR copies > 1"
    )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            spans = []
            lists = zip(batch.column("data"), batch.column("copies"), batch.column("marks"))
            for value, copies, marks in lists:
                size = len(value.as_buffer())
                if copies.as_py() > 1:
                    spans.append([(0, size)] if size >= length else [])
                else:
                    pairs = [(m["first"], m["last"]) for m in marks.as_py() or []]
                    spans.append(cut_spans(size, pairs, length))
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            structs = [[{"start": a, "end": b} for a, b in each] for each in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("data"), pa.array(structs, pa.list_(kind))],
                names=["row", "data", "spans"],
            )

    spans = repeats.select("row", "copies", "data", "marks").mapInArrow(
        run, "row long, data binary, spans array<struct<start:long,end:long>>"
    )
    slim = scanned.select(key, "row", "n_bytes", "digest")
    return slim, spans


def without_repeats(
    df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    work = WorkFolder(df.sparkSession, "repeats")
    rows, spans = repeated_spans(df, work, text, key, length)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            removed, runs, kept = [], [], []
            for value, found in zip(batch.column("data"), batch.column("spans")):
                data, at, digest = value.as_py(), 0, hashlib.sha256()
                pairs = [(s["start"], s["end"]) for s in found.as_py()]
                for start, end in pairs:
                    digest.update(data[at:start])
                    at = end
                digest.update(data[at:])
                removed.append(sum(b - a for a, b in pairs))
                runs.append(len(pairs))
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(kept)],
                names=["row", "n_removed", "n_spans", "kept"],
            )

    cut = spans.mapInArrow(run, "row long, n_removed long, n_spans long, kept string")
    # By digest, so that every copy of a text meets what its one row found.
    ones = work.spark.read.parquet(f"{work.path}/ones").select("digest", "row")
    cut = work.write(cut.join(ones.hint("merge"), "row").drop("row"), "cut")
    return rows.join(cut.hint("merge"), "digest", "left").select(
        key,
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "digest").alias("kept_sha256"),
    )
