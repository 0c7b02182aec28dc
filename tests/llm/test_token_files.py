import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ROWS, check_shapes, documents
from tokenizers import Tokenizer

from pricetrail.llm import token_files
from pricetrail.llm.common import WorkFolder
from pricetrail.llm.queries import WORD_END, WORD_FILE

LIBRARY = Tokenizer.from_file(WORD_FILE)
LIBRARY.encode_special_tokens = True
CODER = token_files.WordCoder(WORD_FILE)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aBcJ'sStTllé ÉßİΣς̌́̀µª 12 \n\t\r.,!&| \x1c\x00字", max_size=60))
def test_words_give_the_librarys_ids(text):
    assert np.frombuffer(CODER.encode(text), CODER.dtype).tolist() == ids_of(text)


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_codes_round_trip(numbers):
    ranks = np.array(numbers, np.uint32)
    control, data = token_files.pack(ranks)
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.unpack(control, data, len(ranks)).tolist() == numbers


def test_files(spark):
    got = check_shapes(
        documents(spark), lambda df: token_files.token_files(df, WORD_FILE, WORD_END)
    )
    start, want = 0, []
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for key, text in ordered:
        ids = [*ids_of(text), WORD_END]
        want.append((key, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids), start))
        start += len(ids)
    columns = sorted(["doc_id", "start", "n_tokens", "ids_crc32"])
    assert columns == ["doc_id", "ids_crc32", "n_tokens", "start"]
    assert got == sorted(((k, c, n, s) for k, c, n, s in want), key=repr)


def test_ranks_follow_frequency_and_blocks_are_small(spark):
    work = WorkFolder(spark, "test")
    df = documents(spark)
    token_files.write_token_files(df, WORD_FILE, WORD_END, work, block_ids=50)
    ranked = spark.read.parquet(f"{work.path}/dictionary").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(len(ranked)))
    assert all(a.n >= b.n for a, b in zip(ranked, ranked[1:]))
    blocks = spark.read.parquet(f"{work.path}/blocks").collect()
    assert all(sum(b.lengths[:-1]) < 50 for b in blocks)
    assert sum(sum(b.lengths) for b in blocks) == sum(len(ids_of(t)) + 1 for _, t in ROWS)
