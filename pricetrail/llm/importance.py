"""Target-distribution importance resampling on hashed n-gram counts.

Words are runs of digits, letters a-z (A-Z lower-cased) and everything outside ASCII; features are all runs of
one and of two consecutive words. Both corpora are counted over a fixed number of buckets; the gain of a bucket
is its log ratio of target to source with one added to each. A document's weight is the mean gain of its
features, its score the weight plus Gumbel noise drawn from its id, and the highest scores are drawn.

Inside a batch, n-grams are interned in an open-addressed numpy table: keys are xxhash64, equal keys are
verified byte by byte, a slot holds bucket and count, and occurrences hold slot ids, by which gains are
gathered. So a bucket is computed once for each distinct n-gram of a batch. A batch is cut into parts of
bounded size, also inside a document; nothing but the bucket counts (one row a bucket) leaves the tasks.

Null text has no features and weight 0; so has a text without words. Rows are independent: repeated rows are
drawn each for itself, equal scores by the smaller id, then in the order of the written table. A null id is
written as "null" for its noise and comes after all ids of equal score. Without any feature in one of the
corpora its counts are all zero. Other columns are not read.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.llm.common import Batches, WorkFolder, by_rows

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

#: Bytes of text whose n-grams are interned together; a longer text is taken in several parts.
PART_BYTES = 1 << 17

#: Lower case of A-Z, all other bytes as they are; and which bytes words are made of.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_SPACE = 32

# ---- words ---------------------------------------------------------------------------------------


@dataclass
class Part:
    """Words joined by one space in `data`, and to which row of the batch each belongs.

    `repeated` marks words that the part before has counted, and that stand here only for the pair with
    the word after them.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    repeated: np.ndarray


def parts(texts: list[bytes], size: int = PART_BYTES) -> Iterator[Part]:
    """All words of the texts, in parts of about `size` bytes; no pair of a text is lost between parts."""
    pending, held = [], 0
    for row, text in enumerate(texts):
        at, again = 0, False
        while len(text) - at > size:
            cut, last = _cut(text, at + size)
            while cut is not None and last <= at:  # still the word that this part begins with
                cut, last = _cut(text, cut + 1)
            if cut is None:
                break
            pending.append((row, text[at:cut], again))
            yield _part(pending)
            pending, held = [], 0
            at, again = last, True
        pending.append((row, text[at:], again))
        held += len(text) - at
        if held >= size:
            yield _part(pending)
            pending, held = [], 0
    if pending:
        yield _part(pending)


def _cut(text: bytes, at: int, reach: int = 1 << 12) -> tuple[int | None, int]:
    """A place at or after `at` where a word ends, and where that word starts; None without one."""
    here = at
    while here < len(text):
        block = _WORD[_LOWER[np.frombuffer(text, np.uint8, min(reach, len(text) - here), here)]]
        ends = np.flatnonzero(block[:-1] & ~block[1:])
        if ends.size:
            start = cut = here + int(ends[0]) + 1
            while start and _WORD[_LOWER[text[start - 1]]]:
                start -= 1
            return cut, start
        if len(block) == 1:
            break
        here += len(block) - 1
    return None, len(text)


def _part(pieces: list[tuple[int, bytes, bool]]) -> Part:
    data = _LOWER[np.frombuffer(b" ".join(text for _, text, _ in pieces) + b" ", np.uint8)]
    word = _WORD[data]
    # One byte that is no word after each word stays, as the space between it and the next.
    kept = word.copy()
    kept[1:] |= word[:-1]
    sizes = np.array([len(text) + 1 for _, text, _ in pieces], np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes)[kept]
    inside = word[kept]
    data = np.where(inside, data[kept], np.uint8(_SPACE))
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = piece[start] if len(start) else np.zeros(0, np.int64)
    first = np.ones(len(piece), bool)
    first[1:] = piece[1:] != piece[:-1]
    again = np.array([x for _, _, x in pieces], bool)
    row = np.array([row for row, _, _ in pieces], np.int64)
    return Part(data, start, end, row[piece], first & again[piece])


# ---- table ---------------------------------------------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one little-endian number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    views = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]
    return np.ascontiguousarray(views).view("<u8").ravel()


def hashes(data: np.ndarray, lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 of many strings of `data`: all below 32 bytes at once, longer ones by the library."""
    out = size.astype(np.uint64) + _P5
    left, at = size.copy(), start.copy()
    out[size >= 32] = 0
    left[size >= 32] = 0
    for _ in range(3):
        k = np.flatnonzero(left >= 8)
        lane = _turn(lanes[at[k]] * _P2, 31) * _P1
        out[k] = _turn(out[k] ^ lane, 27) * _P1 + _P4
        at[k] += 8
        left[k] -= 8
    k = np.flatnonzero(left >= 4)
    out[k] = _turn(out[k] ^ ((lanes[at[k]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[k] += 4
    left[k] -= 4
    for _ in range(3):
        k = np.flatnonzero(left >= 1)
        out[k] = _turn(out[k] ^ (data[at[k]].astype(np.uint64) * _P5), 11) * _P1
        at[k] += 1
        left[k] -= 1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    out ^= out >> np.uint64(32)
    for k in np.flatnonzero(size >= 32):
        out[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + size[k]].tobytes())
    return out


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return x


_CRC = _crc_table()


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 64) -> np.ndarray:
    """crc32 of many strings of `data`: a byte of all at a time, strings above `most` by the library."""
    order = np.argsort(size, kind="stable")
    at, left = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(left[-1]) if len(left) else 0, most)):
        rest = slice(int(np.searchsorted(left, k, "right")), None)  # those longer than k
        part = crc[rest]
        crc[rest] = _CRC[(part ^ data[at[rest] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    for k in np.flatnonzero(size > most):
        out[k] = zlib.crc32(data[start[k] : start[k] + size[k]].tobytes())
    return out


class Interned:
    """Distinct n-grams of a part: slots with bucket and count, and the slot of every occurrence."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int):
        self.data, self.start, self.size = data, start, size
        self.lanes = _lanes(data)
        self.keys = hashes(data, self.lanes, start, size)
        n = len(start)
        mask = (1 << max(2 * n - 1, 1).bit_length()) - 1
        owner = np.full(mask + 1, -1, np.int64)
        slot = (self.keys & np.uint64(mask)).astype(np.int64)
        open_ = np.arange(n)
        while open_.size:
            place = slot[open_]
            free = owner[place] < 0
            owner[place[free]] = open_[free]
            taken = self._equal(open_, owner[place])
            open_ = open_[~taken]
            slot[open_] = (slot[open_] + 1) & mask
        used = np.flatnonzero(owner >= 0)
        #: Occurrences' slots, numbered without gaps; then bucket and count of each slot.
        number = np.zeros(mask + 1, np.int64)
        number[used] = np.arange(len(used))
        self.slot = number[slot]
        self.count = np.bincount(self.slot, minlength=len(used))
        first = owner[used]
        self.bucket = checksums(data, start[first], size[first]).astype(np.int64) % buckets

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether occurrences are the same bytes: keys and sizes first, then eight bytes at a time."""
        same = (self.keys[a] == self.keys[b]) & (self.size[a] == self.size[b]) & (a != b)
        k = np.flatnonzero(same)
        x, y, left = self.start[a[k]], self.start[b[k]], self.size[a[k]]
        while k.size:
            rest = np.minimum(left, 8).astype(np.uint64)
            differ = (self.lanes[x] ^ self.lanes[y]) << (np.uint64(64) - rest * np.uint64(8))
            same[k[differ != 0]] = False
            more = (differ == 0) & (left > 8)
            k, x, y, left = k[more], x[more] + 8, y[more] + 8, left[more] - 8
        return same | (a == b)


def interned(part: Part, buckets: int) -> tuple[Interned, np.ndarray]:
    """All n-grams of a part, and the row of every occurrence."""
    single = ~part.repeated
    pair = part.row[1:] == part.row[:-1]
    start = np.concatenate((part.start[single], part.start[:-1][pair]))
    end = np.concatenate((part.end[single], part.end[1:][pair]))
    rows = np.concatenate((part.row[single], part.row[:-1][pair]))
    return Interned(part.data, start, end - start, buckets), rows


# ---- counts, gains, scores -----------------------------------------------------------------------


def _bytes(column: pa.Array) -> list[bytes]:
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def bucket_counts(
    df: DataFrame, buckets: int = BUCKETS, text: str = "text", size: int = PART_BYTES
) -> np.ndarray:
    """How many features of the whole corpus fall into each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Batches) -> Batches:
        total = np.zeros(buckets, np.int64)
        for batch in by_rows(batches):
            for part in parts(_bytes(batch.column("_text")), size):
                table, _ = interned(part, buckets)
                np.add.at(total, table.bucket, table.count)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], schema=schema
        )

    counted = (
        df.select(F.col(text).cast("string").alias("_text"))
        .mapInArrow(run, "bucket int, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
    )
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # one row a bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(...)) of each bucket's share in the target against that in the source."""
    n, source, target = len(source), source.astype(float), target.astype(float)
    above = (target + 1) * (source.sum() + n)
    below = (source + 1) * (target.sum() + n)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(
    df: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", size: int = PART_BYTES
) -> DataFrame:
    """`key`, `n_words`, `n_features` and `weight` of every row."""
    names = [key, "n_words", "n_features", "weight"]
    schema = pa.schema([(name, pa.int64()) for name in names])

    def run(batches: Batches) -> Batches:
        for batch in by_rows(batches):
            rows = len(batch)
            words, features, total = np.zeros((3, rows), np.int64)
            for part in parts(_bytes(batch.column("_text")), size):
                table, row = interned(part, len(gain))
                words += np.bincount(part.row[~part.repeated], minlength=rows)
                features += np.bincount(row, minlength=rows)
                np.add.at(total, row, gain[table.bucket][table.slot])
            mean = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(x, pa.int64()) for x in (words, features, mean))],
                schema=schema,
            )

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"`{name}` long" for name in names))


def drawn(scored: DataFrame, key: str, least: int, percent: int, work: WorkFolder) -> DataFrame:
    """`rank` of the highest scores, null for rows that are not drawn.

    Ranks come from a sort by range: numbers within a range, plus the rows of the ranges before it. The
    sort key ends in the row's number, so that equal rows fall into different ranges.
    """
    scored = work.write(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("_row").asc()]
    enough = scored.where(F.col("n_words") >= least)
    ranged = work.write(
        enough.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    sizes = ranged.groupBy("_range").count().orderBy("_range").collect()  # one row a partition
    take, before, offsets = sum(r["count"] for r in sizes) * percent // 100, 0, []
    for row in sizes:
        offsets.append((row["_range"], before))
        before += row["count"]
    starts = work.spark.createDataFrame(offsets, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    ranks = (
        ranged.join(F.broadcast(starts), "_range")
        .withColumn("rank", place.cast("long"))
        .where(F.col("rank") <= take)
        .select("_row", "rank")
    )
    return scored.join(ranks, "_row", "left").drop("_row")


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    buckets: int = BUCKETS,
    least: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    size: int = PART_BYTES,
) -> DataFrame:
    """Per document `n_words`, `n_features`, `weight`, `score`, and `rank` of the documents drawn.

    Of the documents with at least `least` words, `percent` in a hundred are drawn, rounded down.
    """
    work = WorkFolder(docs.sparkSession, "importance")
    source_counts = bucket_counts(docs, buckets, text, size)
    gain = gains(source_counts, bucket_counts(target, buckets, text, size))
    scored = weights(docs, gain, text, key, size).withColumn(
        "score", F.col("weight") + noise(F.col(key), seed)
    )
    return drawn(scored, key, least, percent, work)
