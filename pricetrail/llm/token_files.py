"""Token ids in binary files: frequency-ranked ids, byte-aligned codes, separate control bytes.

Documents are ordered by id, encoded with the tokenizers library, and each is closed by an end id. Ids
are then numbered by falling frequency over all documents, so that the commonest 256 take one byte.
A block holds the ids of some consecutive documents: control bytes (two bits an id: the number of its
data bytes less one, four ids a byte) and, apart from them, the data bytes. Reading looks control
bytes up in a 256-row table and gathers the data bytes with numpy. The files:

* `dictionary`: id, rank and n, one row per id that occurs; bounded by the vocabulary
* `blocks`: part, seq (their order is that of the documents), doc_ids, lengths, control, data

Null text counts as empty and holds the end id only. Repeated rows and ids are written as often as they
occur, next to each other, null ids first. An empty table gives empty files. Other columns are not read.
"""

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricetrail.llm.common import Batches, WorkFolder

#: Ids in a block, unless one document has more.
BLOCK_IDS = 1 << 18
#: Words whose ids a worker remembers.
CACHED_WORDS = 1 << 20

#: Words of these characters only need no more than lower case and a cut into runs; the apostrophe,
#: which opens contractions, is not among them.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-`{-~]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class WordCoder(dict):
    """Ids (as bytes) of words, each encoded by the library once and then remembered.

    The vocabulary's rules drop white space and never join across it, so a text's ids are those of
    its words in order. Words are cut at ASCII white space only; any other stays inside a word. Words
    of plain letters, digits and marks go straight to the library's merges, all others through its
    whole chain.
    """

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.merge = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.characters = dict(enumerate(byte_characters()))

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text):
            ids = []
            for run in _RUNS.findall(text.lower()):
                if not run.isascii():
                    run = run.encode().decode("latin-1").translate(self.characters)
                ids += [token.id for token in self.merge(run)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        coded = np.array(ids, self.dtype).tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = coded
        return coded

    def encode(self, text: str) -> bytes:
        """The ids of a text, as bytes of `dtype`."""
        data = text.encode()
        if b"\xcc" not in data and b"\xcd" not in data:
            # Without combining marks, capitals and small letters compose alike.
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


@cache
def coder(file: str) -> WordCoder:
    return WordCoder(file)


def _tokens(
    df: DataFrame, file: str, end_id: int, text: str, key: str, block_ids: int
) -> DataFrame:
    """Blocks of raw ids, in ascending order of the key through parts and sequence numbers."""
    schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
         ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())]
    )

    def run(batches: Batches) -> Batches:
        code = coder(file)
        end = np.array([end_id], code.dtype).tobytes()
        end_width = code.dtype.itemsize
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        keys, lengths, data = [], [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in
                 zip(([part], [seq], [keys], [lengths], [b"".join(data)]), schema)],
                schema=schema,
            )

        for batch in batches:
            for one, text in zip(batch.column(key).to_pylist(), batch.column("_text")):
                coded = code.encode(text.as_py() or "")
                keys.append(one)
                lengths.append(len(coded) // end_width + 1)
                data += [coded, end]
                held += lengths[-1]
                if held >= block_ids:
                    yield block()
                    seq, held, keys, lengths, data = seq + 1, 0, [], [], []
        if keys:
            yield block()

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return (
        rows.repartitionByRange(key)
        .sortWithinPartitions(key, "_text")
        .mapInArrow(
            run,
            "part int, seq int, doc_ids array<long>, lengths array<int>, ids binary",
        )
    )


def id_counts(tokens: DataFrame, width: int) -> DataFrame:
    """(id, n) over all blocks of raw ids of `width` bytes."""

    def run(batches: Batches) -> Batches:
        n = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column("ids"):
                more = np.bincount(np.frombuffer(value.as_buffer(), f"<u{width}"))
                longer, other = (n, more) if len(n) >= len(more) else (more, n)
                longer[: len(other)] += other
                n = longer
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids.astype(np.int64)), pa.array(n[ids])], names=["id", "n"]
        )

    counts = tokens.select("ids").mapInArrow(run, "id long, n long")
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned numbers below 2**32."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = length - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    used = np.arange(4, dtype=np.uint8) < length[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


#: Byte counts of the four ids of each control byte.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_token_files(
    df: DataFrame,
    file: str,
    end_id: int,
    work: WorkFolder,
    text: str = "text",
    key: str = "doc_id",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write `dictionary` and `blocks` under the work folder."""
    width = coder(file).dtype.itemsize
    tokens = work.write(_tokens(df, file, end_id, text, key, block_ids), "tokens")
    counted = work.write(id_counts(tokens, width), "counts")
    # One row per id of the vocabulary that occurs, whatever the size of the input.
    by_rank = counted.orderBy(F.desc("n"), "id").collect()
    numbered = [(row.id, rank, row.n) for rank, row in enumerate(by_rank)]
    spark = df.sparkSession
    work.write(spark.createDataFrame(numbered, "id long, rank long, n long"), "dictionary")
    ranks = np.zeros(max((row.id for row in by_rank), default=0) + 1, np.uint32)
    for id_, rank, _ in numbered:
        ranks[id_] = rank

    def run(batches: Batches) -> Batches:
        for batch in batches:
            packed = [
                pack(ranks[np.frombuffer(value.as_buffer(), f"<u{width}")])
                for value in batch.column("ids")
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part", "seq", "doc_ids", "lengths")),
                 pa.array([c for c, _ in packed], pa.binary()),
                 pa.array([d for _, d in packed], pa.binary())],
                names=["part", "seq", "doc_ids", "lengths", "control", "data"],
            )

    coded = tokens.mapInArrow(
        run,
        "part int, seq int, doc_ids array<long>, lengths array<int>, control binary, data binary",
    )
    # The codes are dense already: a fast codec for the lists beside them is enough.
    work.write(coded, "blocks", "lz4")
    work.drop("tokens", "counts")


def reader(work: WorkFolder) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    """From a batch of `blocks` to the ids of each of them, by the files' dictionary."""
    dictionary = work.spark.read.parquet(f"{work.path}/dictionary")
    ids = np.zeros(max(dictionary.count(), 1), np.uint32)
    for row in dictionary.collect():
        ids[row["rank"]] = row.id

    def decode(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        columns = (batch.column(c) for c in ("lengths", "control", "data"))
        for lengths, control, data in zip(*columns):
            n = int(np.sum(lengths.values.to_numpy()))
            yield ids[unpack(control.as_buffer(), data.as_buffer(), n)]

    return decode


def summarize(work: WorkFolder, key: str = "doc_id") -> DataFrame:
    """Per document, from the files alone: its first position, its number of ids and their CRC-32."""
    blocks = work.spark.read.parquet(f"{work.path}/blocks")
    decode = reader(work)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), (key, pa.int64()),
                        ("within", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids_of = decode(batch)
            for part, seq, keys, lengths, ids in zip(
                *(batch.column(c) for c in ("part", "seq", "doc_ids", "lengths")), ids_of
            ):
                n = lengths.values.to_numpy().astype(np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends - n, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(n), pa.int32()),
                     pa.array([seq.as_py()] * len(n), pa.int32()), keys.values,
                     pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    schema=schema,
                )

    docs = blocks.mapInArrow(
        run,
        f"part int, seq int, `{key}` long, within long, n_tokens long, ids_crc32 long",
    )
    docs = work.write(docs, "documents")
    # Ids before each block: within its part by a window, before its part by a window over parts.
    sizes = docs.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1
    )
    of_parts = (
        sizes.groupBy("part").agg(F.sum("n").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("p"))
    )
    starts = (
        sizes.select("part", "seq", F.coalesce(F.sum("n").over(in_part), F.lit(0)).alias("s"))
        .join(of_parts, "part")
        .select("part", "seq", (F.col("p") + F.col("s")).alias("start"))
    )
    starts = work.write(starts, "starts")
    return docs.join(starts.hint("merge"), ["part", "seq"]).select(
        key, (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(
    df: DataFrame, file: str, end_id: int, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Write the files of all texts and read them back."""
    work = WorkFolder(df.sparkSession, "token-files")
    write_token_files(df, file, end_id, work, text, key)
    return summarize(work, key)


