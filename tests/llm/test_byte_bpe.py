import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import LONG, ROWS, check_shapes, documents

from pricetrail.llm import byte_bpe
from pricetrail.llm.queries import PATTERN, RANK_FILE

CODER = byte_bpe.encoding(RANK_FILE, PATTERN)


def expected(rows):
    for key, text in rows:
        ids = CODER.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        yield key, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip(spark):
    got = check_shapes(documents(spark), lambda df: byte_bpe.round_trip(df, RANK_FILE, PATTERN))
    want = [(decoded, key, digest, n) for key, n, digest, decoded in expected(ROWS)]
    assert got == sorted(want, key=repr)


def test_ids_and_bytes(spark):
    coded = byte_bpe.encode(documents(spark), RANK_FILE, PATTERN)
    data = byte_bpe.decode(coded, RANK_FILE, PATTERN)
    got = sorted(((r.doc_id, bytes(r.bytes)) for r in data.collect()), key=repr)
    assert got == sorted(((k, (t or "").encode()) for k, t in ROWS), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'st ll12 \n\t.,!é \x1ć字", max_size=80), st.integers(1, 9))
def test_pieces_do_not_change_ids(text, size):
    assert "".join(byte_bpe.pieces(text, size)) == text
    assert byte_bpe.encode_text(text, CODER, size) == CODER.encode_ordinary(text)


@pytest.mark.parametrize("text", [LONG, " " * 3000 + "x", "a" * 30000, "1.5" * 9000])
def test_long_texts(text):
    assert byte_bpe.encode_text(text, CODER, 1000) == CODER.encode_ordinary(text)
