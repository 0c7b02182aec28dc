"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Every text is pre-split by the vocabulary's pattern and merged by rank, without special tokens.
Long texts are first cut where no match of the pattern can reach across, so that one call of the
library handles a bounded text; the ids are those of the whole text.

Null text counts as empty; an empty text has no ids. Rows are independent: repeated rows, ties and
null ids are kept as they are, other columns are not read.
"""

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import Batches, by_rows

#: Texts are encoded in pieces of about this many characters.
PIECE_CHARS = 1 << 16

#: Between these, a match of the pattern always ends: a letter run holds no other character after
#: its first, a digit run neither, and white space only opens a match. ASCII only, where all
#: libraries agree on the classes.
_BOUNDARY = regex.compile(
    r"(?<=[A-Za-z])(?=[ \t\n\r0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[ \t\n\rA-Za-z!-/:-@\[-`{-~])"
)


@cache
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in order, cut at safe boundaries only; without one, a piece may be longer."""
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str, coder: tiktoken.Encoding, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return coder.encode_ordinary(text)
    return [token for piece in pieces(text, size) for token in coder.encode_ordinary(piece)]


def encode(
    df: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """`key` and `ids` (array of int) of every row."""
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Batches) -> Batches:
        coder = encoding(rank_file, pattern)
        for batch in by_rows(batches):
            ids = [encode_text(t or "", coder) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(ids, schema.field("ids").type)], schema=schema
            )

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` long, ids array<int>")


def decode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """`key` and `bytes` (binary) of every row's `ids`; null ids decode to no bytes.

    Raw bytes: tokens may end inside a character, so nothing is decoded to text here.
    """
    schema = pa.schema([(key, pa.int64()), ("bytes", pa.binary())])

    def run(batches: Batches) -> Batches:
        coder = encoding(rank_file, pattern)
        for batch in by_rows(batches):
            data = [coder.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(data, pa.binary())], schema=schema
            )

    rows = df.select(F.col(key).cast("long").alias(key), "ids")
    return rows.mapInArrow(run, f"`{key}` long, bytes binary")


def round_trip(
    df: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Digests of each row's ids and of the bytes they decode to, in one pass over the texts."""
    schema = pa.schema(
        [
            (key, pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_sha256", pa.string()),
            ("decoded_sha256", pa.string()),
        ]
    )

    def run(batches: Batches) -> Batches:
        coder = encoding(rank_file, pattern)
        for batch in by_rows(batches):
            n_tokens, ids_sha, decoded_sha = [], [], []
            for value in batch.column("_text"):
                ids = encode_text(value.as_py() or "", coder)
                n_tokens.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n_tokens, pa.int64()), pa.array(ids_sha),
                 pa.array(decoded_sha)],
                schema=schema,
            )

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(
        run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
