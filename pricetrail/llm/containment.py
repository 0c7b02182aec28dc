"""Benchmark decontamination: short test items inside long documents, by MinHash containment search.

An item is contained in a document when at least 0.8 of its five-word shingles occur there. Items are
partitioned by size (powers of two of their shingles); documents are read through windows of twice the
partition's largest size, half overlapping, so that some window holds an item's whole passage and the
item's share of that window, its Jaccard similarity, has a lower bound whatever the document's length.
Each of the minima of 64 permutations is a band of its own; one equal band makes a candidate, which a
passage at the bound misses with a chance below 1e-5.

The share of an item of a few shingles in such a window would be too small for that. Items of up to DIRECT
shingles need no windows: as many of their shingles as a document can lack, and one more, are their bands,
and a document that contains the item has one of them.

Only the windows' bands and the documents' shingles that can occur in an item leave a task: a Bloom
filter of fixed size tells, filled from the items. It passes more when it is full, never less. Candidates
are then verified by exact containment of the item's shingles in those of the whole document.

Words are runs of letters and digits in lower case. Items shorter than five words are one shingle of all
their words; items without words match nothing. Null text counts as empty. Equal items are all reported;
equal documents and repeated rows of a document give one pair per id; rows with null ids take no part.
Empty tables give empty results. Other columns are not read.
"""

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import Batches, WorkFolder

WIDTH = 5
CONTAINMENT = 0.8
PERMUTATIONS = 64
#: The smallest partition holds items of up to this many shingles.
SMALLEST = 16
#: Items of up to this many shingles are found by the shingles themselves; their partition's number.
DIRECT, DIRECT_PART = 8, -1
#: Bits of each Bloom filter, one for bands and one for shingles: 2 MB together, at any size.
FILTER_BITS = 1 << 23
#: Words of documents that are laid out together, and characters that are hashed together.
LAYOUT = 1 << 18
PIECE = 1 << 20

_BREAK = re.compile(r"\W")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _word_characters() -> np.ndarray:
    """Which code points the pattern \\w takes."""
    return np.array([c == 95 or chr(c).isalnum() for c in range(0x110000)])


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a 64-bit base and of its inverse."""

    def each(base: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return factors.cumprod(dtype=np.uint64)

    return each(int(_MIX)), each(pow(int(_MIX), -1, 1 << 64))


def _piece_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word: a polynomial of its code points, mixed with its length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = _word_characters()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(PIECE if len(codes) <= PIECE else 1 << len(codes).bit_length())
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:], dtype=np.uint64)
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, mix(hashes + (ends - starts).astype(np.uint64) * _MIX)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in lower case, and where each text's words start."""
    lowered = [text.lower() for text in texts]
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    at = 0
    while at < len(lowered):
        end, size = at, 0
        while end < len(lowered) and size + len(lowered[end]) < PIECE:
            size += len(lowered[end]) + 1
            end += 1
        if end > at:
            starts, found = _piece_hashes("\n".join(lowered[at:end]))
            sizes = np.cumsum([len(t) + 1 for t in lowered[at:end]])
            counts[at + 1 : end + 1] = np.diff(np.searchsorted(starts, sizes), prepend=0)
            hashes.append(found)
            at = end
            continue
        # A long text in pieces, cut where no word goes on.
        text, start = lowered[at], 0
        while start < len(text):
            cut = _BREAK.search(text, start + PIECE)
            stop = cut.start() if cut else len(text)
            hashes.append(_piece_hashes(text[start:stop])[1])
            counts[at + 1] += len(hashes[-1])
            start = stop
        at += 1
    joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return joined, np.cumsum(counts)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n]
    for k in range(1, width):
        total = mix(total * _MIX) + words[k : k + n]
    return mix(total)


def _multipliers() -> np.ndarray:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def partition_of(sizes: np.ndarray) -> np.ndarray:
    """0 for up to SMALLEST shingles, and one more for each doubling."""
    return np.ceil(np.log2(np.maximum(sizes, SMALLEST) / SMALLEST)).astype(np.int64)


def band_key(partition: int, permutation: int, minima: np.ndarray) -> np.ndarray:
    salt = ((partition << 8 | permutation) + 1) * int(_MIX) & (1 << 64) - 1
    return mix(minima ^ np.uint64(salt))


def needed(distinct: np.ndarray, containment: float) -> np.ndarray:
    """Shingles of which a document that contains the item has at least one."""
    n = len(distinct)
    least = next((k for k in range(1, n + 1) if k / n >= containment), n)
    return distinct[: n - least + 1]


def item_rows(
    items: DataFrame, text: str, key: str, width: int, containment: float
) -> DataFrame:
    """Per item: its shingle width, distinct shingles and bands."""

    def run(batches: Batches) -> Batches:
        factors = _multipliers()
        for batch in batches:
            widths, sets, bands, parts = [], [], [], []
            for value in batch.column("_text"):
                words, _ = word_hashes([value.as_py() or ""])
                own = min(width, len(words))
                distinct = np.unique(shingles(words, own)) if own else np.zeros(0, np.uint64)
                if len(distinct) <= DIRECT:
                    part = DIRECT_PART
                    keys = [band_key(part, 0, needed(distinct, containment))] if own else []
                else:
                    part = int(partition_of(np.array([len(distinct)]))[0])
                    keys = [
                        band_key(part, k, (distinct * f).min(keepdims=True))
                        for k, f in enumerate(factors)
                    ]
                widths.append(own)
                parts.append(part)
                sets.append(distinct.view(np.int64).tolist())
                bands.append(np.concatenate(keys).view(np.int64).tolist() if keys else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(widths, pa.int32()), pa.array(parts, pa.int32()),
                 pa.array(sets, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                names=[key, "width", "part", "shingles", "bands"],
            )

    rows = items.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text")
    )
    return rows.mapInArrow(
        run, f"`{key}` long, width int, part int, shingles array<long>, bands array<long>"
    ).where("width > 0")


def bloom_filter(values: DataFrame) -> np.ndarray:
    """Bits of the values' low bits; at most FILTER_BITS / 32768 small bitmaps reach the driver."""
    # Bit positions are counted from one on, bucket by bucket.
    slot = F.col("value").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    bitmaps = (
        values.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, part in bitmaps.collect():
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(part), np.uint8)
    return bits


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = (values & np.uint64(FILTER_BITS - 1)).astype(np.uint32)
    return (bits[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8)) & 1 == 1


class Windows:
    """Windows over the hashes of many documents, laid out once for all permutations and partitions.

    Cells of SMALLEST hashes are paired up per document from one partition to the next; a window is two
    neighbouring cells, or the only one.
    """

    def __init__(self, documents: list[np.ndarray], parts: list[int]):
        # The last cell is filled up with its document's last hash, which changes no minimum.
        filled = [np.pad(h, (0, -len(h) % SMALLEST), mode="edge") for h in documents]
        self.hashes = np.concatenate(filled).reshape(-1, SMALLEST)
        self.levels = []
        cells = np.array([len(h) // SMALLEST for h in filled])
        for part in range(max(parts) + 1):
            start = np.cumsum(cells) - cells
            windows = np.maximum(cells - 1, 1)
            owner, first = self._spread(windows)
            last = (start + cells - 1)[owner]
            first = start[owner] + first
            view = (owner, first, np.minimum(first + 1, last)) if part in parts else None
            halves = (cells + 1) // 2
            owner, pair = self._spread(halves)
            pair = start[owner] + 2 * pair
            self.levels.append((part, view, pair, np.minimum(pair + 1, (start + cells - 1)[owner])))
            cells = halves

    @staticmethod
    def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner and number within the owner of `counts` things each."""
        owner = np.repeat(np.arange(len(counts)), counts)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)

    def minima(self, factor: np.uint64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(partition, owner of each window, its minimum) under one permutation."""
        cells = (self.hashes * factor).min(axis=1)
        for part, view, left, right in self.levels:
            if view is not None:
                owner, first, second = view
                yield part, owner, np.minimum(cells[first], cells[second])
            cells = np.minimum(cells[left], cells[right])


def band_hits(
    documents: list[np.ndarray], parts: list[int], bits: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, band) of all windows' bands that an item may have."""
    windows = Windows(documents, parts)
    owners, bands = [], []
    for k, factor in enumerate(_multipliers()):
        for part, owner, minima in windows.minima(factor):
            keys = band_key(part, k, minima)
            hit = passes(bits, keys)
            owners.append(owner[hit])
            bands.append(keys[hit])
    return np.concatenate(owners), np.concatenate(bands)


def document_hits(
    df: DataFrame, text: str, key: str, width_parts: dict[int, list[int]],
    band_bits: np.ndarray, shingle_bits: np.ndarray,
) -> DataFrame:
    """Per document with any: bands that an item may have, and all shingles that an item may have."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            for at in range(0, len(batch), 1024):
                texts = [t or "" for t in batch.column("_text").slice(at, 1024).to_pylist()]
                words, bounds = word_hashes(texts)
                start = 0
                while start < len(texts):
                    # Texts enough for one layout; a very long one is laid out alone.
                    end = int(np.searchsorted(bounds, bounds[start] + LAYOUT, "right")) - 1
                    end = min(max(end, start + 1), len(texts))
                    part = words[bounds[start] : bounds[end]]
                    yield _hits(
                        keys[at + start : at + end], part, bounds[start : end + 1] - bounds[start]
                    )
                    start = end

    def _hits(keys: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        bands: dict[int, list[np.ndarray]] = {}
        shared: dict[int, list[np.ndarray]] = {}
        for width, parts in width_parts.items():
            every = shingles(words, width)
            known = passes(shingle_bits, every)
            hashes, own, places = [], [], []
            before = np.append(0, np.cumsum(known))
            direct = band_key(DIRECT_PART, 0, every[known])
            sure = passes(band_bits, direct)
            for k, (a, b) in enumerate(zip(bounds, bounds[1:] - width + 1)):
                # Without a shingle of any item a document has none of its bands either.
                if b > a and before[b] > before[a]:
                    places.append(k)
                    hashes.append(every[a:b])
                    own.append(every[a:b][known[a:b]])
                    part = slice(before[a], before[b])
                    if DIRECT_PART in parts and sure[part].any():
                        bands.setdefault(k, []).append(direct[part][sure[part]])
            if not places:
                continue
            for k, found in zip(places, own):
                shared.setdefault(k, []).append(found)
            windowed = [part for part in parts if part != DIRECT_PART]
            if not windowed:
                continue
            owner, found = band_hits(hashes, windowed, band_bits)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(places) + 1))
            for k, a, b in zip(places, cuts, cuts[1:]):
                if b > a:
                    bands.setdefault(k, []).append(found[order[a:b]])
        rows = sorted(bands)
        lists = [
            [np.unique(np.concatenate(each[k])).view(np.int64).tolist() for k in rows]
            for each in (bands, shared)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[np.array(rows, np.int64)].astype(np.int64)),
             *(pa.array(each, pa.list_(pa.int64())) for each in lists)],
            names=[key, "bands", "shingles"],
        )

    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text")
    )
    return rows.mapInArrow(run, f"`{key}` long, bands array<long>, shingles array<long>")


def contained_items(
    df: DataFrame,
    items: DataFrame,
    containment: float = CONTAINMENT,
    width: int = WIDTH,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """(key, item_key, n_shared, n_shingles, containment): items found in documents."""
    work = WorkFolder(df.sparkSession, "containment")
    known = work.write(item_rows(items, item_text, item_key, width, containment), "items")
    # Widths one to five, and the sizes of items by doublings: a handful of rows at any scale.
    kinds: dict[int, list[int]] = {}
    for row in known.select("width", "part").distinct().orderBy("width", "part").collect():
        kinds.setdefault(row.width, []).append(row.part)
    bands = known.select(item_key, F.explode("bands").alias("band"))
    shingle = known.select(item_key, F.explode("shingles").alias("shingle"))
    hits = work.write(
        document_hits(
            df, text, key, kinds,
            bloom_filter(bands.select(F.col("band").alias("value"))),
            bloom_filter(shingle.select(F.col("shingle").alias("value"))),
        ),
        "hits",
    )
    # A band that many documents share is split by the join; one that many items share meets each
    # document once, as those items may all be contained.
    doc_bands = hits.select(key, F.explode("bands").alias("band"))
    candidates = work.write(
        doc_bands.join(bands.hint("merge"), "band").select(key, item_key).distinct(), "candidates"
    )
    sizes = known.select(
        item_key, F.size("shingles").alias("n_shingles"), F.col("shingles").alias("wanted")
    )
    wanted = work.write(
        candidates.join(sizes.hint("merge"), item_key).select(
            key, item_key, "n_shingles", "wanted"
        ),
        "wanted",
    )
    present = hits.select(key, F.col("shingles").alias("present"))
    shared = F.size(F.array_intersect("wanted", "present")).cast("long")
    found = (
        wanted.join(present.hint("merge"), key)
        # Repeated rows of a document: the one that shares most speaks for it.
        .groupBy(key, item_key)
        .agg(
            F.max(shared).alias("n_shared"),
            F.max(F.col("n_shingles").cast("long")).alias("n_shingles"),
        )
    )
    share = F.col("n_shared") / F.col("n_shingles")
    return found.withColumn("containment", share).where(F.col("containment") >= containment)


def decontaminate(df: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item."""
    found = contained_items(df, items).select("doc_id").distinct()
    return df.join(found, "doc_id", "left_anti").select(df.columns)
