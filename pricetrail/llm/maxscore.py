"""Exact search for the highest inner products by MaxScore over shards of an inverted index.

A vector's components, scaled and rounded down to whole numbers, are its terms' impacts. Every shard holds some
thousand vectors as one posting list a term, with the lowest and highest impact of the list; a list that most
vectors are in stores the impacts of all, in order. For a query, a term can add at most weight x highest or
weight x lowest impact. Terms are taken by that bound, largest first: once all terms left cannot reach the
k-th best score so far together, they are non-essential. Postings of essential terms are traversed; vectors
found there are probed in the lists of the others while they can still reach that score. The best score so far
of a query grows from shard to shard of a task; then the shards' best are merged.

Queries and shards meet in a grid of tasks: index parts times groups of queries, so a task holds a bounded
number of queries and sees its shards one after the other.

A vector that is null or holds a null or non-finite component takes no part, nor does a row of null id. Vectors
may differ in length: what is missing counts as zero. Rows of a query's own id are left out; apart from that
each row counts, so repeated rows take ranks of their own and a repeated query row has its result repeated.
Equal scores go by the smaller id. Zero and negative scores count like others. A score beyond 64 bits is an
error. Empty tables give an empty result; other columns are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.llm.common import Batches, WorkFolder

#: Vectors of a shard, and of an index part as long as there are few parts.
SHARD = 2048
PART = 2 * SHARD
MOST_PARTS = 64
#: Queries of a block and of a task.
BLOCK = 512
GROUP = 1 << 17
#: Terms probed between two looks at who is still competitive.
PROBED = 8

_LISTS = "array<struct<term int, low long, high long, docs binary, impacts binary>>"
_INDEX = f"part int, n int, ids binary, lists {_LISTS}"
_QUERIES = "number int, n int, ids binary, weights binary"


# ---- vectors -------------------------------------------------------------------------------------


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """`id` and `v`, the components times `scale`, rounded down, of all rows that take part."""

    def bad(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    fit = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, bad)
    return vectors.filter(fit).select(
        F.col(key).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )


def _blocks(batches: Batches, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and a matrix of components, shorter vectors filled with zeros, of `size` rows at a time."""
    held, rows = [], 0
    for batch in batches:
        while len(batch):
            piece = batch.slice(0, size - rows)
            batch = batch.slice(len(piece))
            held.append(piece)
            rows += len(piece)
            if rows == size:
                yield _matrix(pa.Table.from_batches(held))
                held, rows = [], 0
    if rows:
        yield _matrix(pa.Table.from_batches(held))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    lists = table.column("v").combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = np.asarray(lists.flatten())
    return ids, out


def _narrow(values: np.ndarray) -> bytes:
    """In as few bytes a number as hold them all; the reader knows how many there are."""
    for kind in (np.int8, np.int16, np.int32):
        if (values == values.astype(kind)).all():
            return values.astype(kind).tobytes()
    return values.tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // n}")


def posting_lists(matrix: np.ndarray) -> list[dict]:
    """A list for each term that occurs, with its bounds; without `docs` it has all vectors in order."""
    out = []
    for term in range(matrix.shape[1]):
        column = matrix[:, term]
        docs = np.flatnonzero(column).astype("<i4")
        if not len(docs):
            continue
        some = 4 * len(docs) < len(column)
        impacts = column[docs] if some else column
        out.append(
            {"term": term, "low": int(impacts.min()), "high": int(impacts.max()),
             "docs": docs.tobytes() if some else None, "impacts": _narrow(impacts)}
        )
    return out


def build_index(vectors: DataFrame, parts: int, shard: int = SHARD) -> DataFrame:
    """Shards of at most `shard` vectors, dealt evenly to `parts` parts."""

    def run(batches: Batches) -> Batches:
        part = TaskContext.get().partitionId()
        for ids, matrix in _blocks(batches, shard):
            row = {"part": part, "n": len(ids), "ids": ids.astype("<i8").tobytes(),
                   "lists": posting_lists(matrix)}
            yield pa.RecordBatch.from_pylist([row], schema)

    lists = pa.list_(
        pa.struct([("term", pa.int32()), ("low", pa.int64()), ("high", pa.int64()),
                   ("docs", pa.binary()), ("impacts", pa.binary())])
    )
    schema = pa.schema(
        [("part", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("lists", lists)]
    )
    return vectors.repartition(parts).mapInArrow(run, _INDEX)


def query_blocks(queries: DataFrame, parts: int) -> DataFrame:
    """Blocks of queries, numbered by the part they were dealt to."""
    schema = pa.schema(
        [("number", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary())]
    )

    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId()
        for ids, matrix in _blocks(batches, BLOCK):
            row = {"number": number, "n": len(ids), "ids": ids.astype("<i8").tobytes(),
                   "weights": matrix.astype("<i8").tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema)

    return queries.repartition(parts).mapInArrow(run, _QUERIES)


# ---- search --------------------------------------------------------------------------------------


@dataclass
class Shard:
    """Posting lists: full ones as rows of a matrix, the others as documents and impacts."""

    ids: np.ndarray
    terms: np.ndarray
    low: np.ndarray
    high: np.ndarray
    full: np.ndarray
    row: np.ndarray
    lists: dict[int, tuple[np.ndarray, np.ndarray]]


def read_shard(n: int, ids: bytes, lists: list[dict]) -> Shard:
    terms, low, high = (
        np.array([x[name] for x in lists], np.int64) for name in ("term", "low", "high")
    )
    full = [x for x in lists if x["docs"] is None]
    matrix = np.array([_wide(x["impacts"], n) for x in full], np.int64).reshape(len(full), n)
    row = np.cumsum([x["docs"] is None for x in lists]) - 1
    row[[k for k, x in enumerate(lists) if x["docs"] is not None]] = -1
    some = {}
    for k, x in enumerate(lists):
        if x["docs"] is not None:
            docs = np.frombuffer(x["docs"], "<i4")
            some[k] = docs, _wide(x["impacts"], len(docs)).astype(np.int64)
    return Shard(np.frombuffer(ids, "<i8"), terms, low, high, matrix, row.astype(int), some)


class Search:
    """The k best so far of a group of queries, while shards come by."""

    def __init__(self, k: int):
        self.k = k
        self.ids = np.zeros(0, np.int64)
        self.weights = np.zeros((0, 0), np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray]] = []

    def add_queries(self, ids: np.ndarray, weights: np.ndarray) -> None:
        width = max(self.weights.shape[1], weights.shape[1])
        both = [np.pad(w, ((0, 0), (0, width - w.shape[1]))) for w in (self.weights, weights)]
        self.weights = np.concatenate(both)
        self.ids = np.concatenate((self.ids, ids))
        none = np.zeros(0, np.int64)
        self.best += [(none, none)] * len(ids)

    def visit(self, shard: Shard) -> None:
        """Bounds of all queries at once, then one query after the other."""
        width = self.weights.shape[1]
        known = shard.terms < width
        weights = np.zeros((len(self.weights), len(shard.terms)), np.int64)
        weights[:, known] = self.weights[:, shard.terms[known]]
        reach = np.maximum(np.abs(shard.low), np.abs(shard.high)).astype(float)
        largest = (np.abs(weights).astype(float) @ reach).max(initial=0)
        if largest >= 2.0**62:
            raise ValueError("inner products do not fit 64 bits")
        # Sums of whole numbers below 2^24 and 2^53 are exact in floating point.
        kind = np.float32 if largest < 2**24 else np.float64 if largest < 2.0**53 else np.int64
        full = shard.full.astype(kind)
        bounds = np.maximum(np.maximum(weights * shard.low, weights * shard.high), 0)
        order = np.argsort(-bounds, axis=1, kind="stable")
        # What the terms from each place on can add together.
        rest = np.zeros((len(weights), len(shard.terms) + 1), np.int64)
        ranked = np.take_along_axis(bounds, order, axis=1)
        rest[:, :-1] = np.cumsum(ranked[:, ::-1], axis=1)[:, ::-1]
        for q in range(len(weights)):
            found, score = self._candidates(q, weights[q], order[q], rest[q], shard, full)
            if len(found):
                self._merge(q, shard.ids[found], score)

    def _candidates(self, q, weights, order, rest, shard, full):
        """Vectors of a shard that reach the k-th best score so far, and their scores."""
        n = len(shard.ids)
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = self.best[q][0][-1] if len(self.best[q][0]) == self.k else None
        # Terms before `first` are essential: those from it on cannot reach the floor together.
        first = len(order) if floor is None else int(np.searchsorted(-rest, -floor, "right"))
        if first == 0 and floor is not None:
            return nothing  # all terms of this shard together cannot reach the floor
        total = np.zeros(n, np.int64)
        # Without a floor, or with one that no term is needed to reach, every vector counts.
        everyone = floor is None or first > len(order)
        touched = np.full(n, everyone)
        essential = order[:first]
        in_full = essential[shard.row[essential] >= 0]
        if len(in_full):
            sums = weights[in_full].astype(full.dtype) @ full[shard.row[in_full]]
            total += sums.astype(np.int64)
            touched[:] = True
        for t in essential[shard.row[essential] < 0]:
            docs, impacts = shard.lists[t]
            total[docs] += impacts * weights[t]
            touched[docs] = True
        if everyone:
            return np.arange(n), total
        found = np.flatnonzero(touched & (total >= floor - rest[first]))
        score = total[found]
        for at in range(first, len(order), PROBED):
            if not len(found):
                return nothing
            some = order[at : at + PROBED]
            dense = some[shard.row[some] >= 0]
            if len(dense):
                impacts = full[shard.row[dense][:, None], found]
                score = score + (weights[dense].astype(full.dtype) @ impacts).astype(np.int64)
            for t in some[shard.row[some] < 0]:
                score = score + weights[t] * _probe(*shard.lists[t], found)
            alive = score >= floor - rest[min(at + PROBED, len(order))]
            found, score = found[alive], score[alive]
        return found, score

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.ids[q]
        scores = np.concatenate((self.best[q][0], scores[other]))
        ids = np.concatenate((self.best[q][1], ids[other]))
        if len(scores) > 4 * self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            high = scores >= least
            scores, ids = scores[high], ids[high]
        top = np.lexsort((ids, -scores))[: self.k]
        self.best[q] = scores[top], ids[top]


def _probe(docs: np.ndarray, impacts: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Impacts of some vectors in a list, zero for those not in it."""
    place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
    return np.where(docs[place] == found, impacts[place], 0)


_BEST = pa.schema(
    [("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
)


def _best_rows(search: Search, numbers: list[int]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(numbers), BLOCK):
        some = range(at, min(at + BLOCK, len(numbers)))
        sizes = [len(search.best[q][0]) for q in some]
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([numbers[q] for q in some], sizes), pa.int64()),
                pa.array(np.repeat(search.ids[some.start : some.stop], sizes), pa.int64()),
                pa.array(np.concatenate(none + [search.best[q][1] for q in some]), pa.int64()),
                pa.array(np.concatenate(none + [search.best[q][0] for q in some]), pa.int64()),
            ],
            schema=_BEST,
        )


def search_cells(cells: DataFrame, k: int) -> DataFrame:
    """The k best of every query in every cell of the grid; a cell's queries come before its shards."""

    def run(batches: Batches) -> Batches:
        cell, search, numbers = None, Search(k), []
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["cell"] != cell:
                    yield from _best_rows(search, numbers)
                    cell, search, numbers = row["cell"], Search(k), []
                if row["weights"] is not None:
                    n = row["n"]
                    search.add_queries(
                        np.frombuffer(row["ids"], "<i8"),
                        np.frombuffer(row["weights"], "<i8").reshape(n, len(row["weights"]) // (8 * n)),
                    )
                    numbers += range(row["row"] * BLOCK, row["row"] * BLOCK + n)
                elif numbers:
                    search.visit(read_shard(row["n"], row["ids"], row["lists"]))
        yield from _best_rows(search, numbers)

    return cells.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: int = 64,
    key: str = "vec_id",
    vector: str = "embedding",
    shard: int = SHARD,
    part: int = PART,
    group: int = GROUP,
) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k vectors with the highest inner product of every query."""
    work = WorkFolder(vectors.sparkSession, "maxscore")
    rows = work.write(whole_numbers(vectors, key, vector, scale), "vectors")
    asked = work.write(whole_numbers(queries, key, vector, scale), "queries")
    parts = min(max(ceil(rows.count() / part), 1), MOST_PARTS)
    groups = max(ceil(asked.count() / group), 1)
    index = work.write(build_index(rows, parts, shard), "index")
    numbered = F.monotonically_increasing_id().alias("row")
    blocks = work.write(query_blocks(asked, 4 * groups).select("*", numbered), "blocks")

    # One row a cell for every shard and every block of queries that meet there.
    each_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    cells = (
        blocks.select("row", "n", "ids", "weights", (F.col("number") % groups).alias("g"),
                      each_part.alias("part"))
        .unionByName(index.select("n", "ids", "lists", "part", each_group.alias("g")),
                     allowMissingColumns=True)
        .withColumn("cell", F.col("part") * groups + F.col("g"))
        .repartitionByRange(parts * groups, "cell")
        .sortWithinPartitions("cell", F.col("row").asc_nulls_last())
    )
    best = work.write(search_cells(cells.drop("part", "g"), k), "best")
    rank = F.row_number().over(
        Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"))
    )
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
