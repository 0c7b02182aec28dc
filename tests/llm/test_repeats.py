import hashlib
from collections import Counter

import numpy as np
import pytest
from odd import ROWS, check_shapes, documents

from pricetrail.llm import repeats
from pricetrail.llm.common import table


def expected(rows, length):
    data = [(key, (text or "").encode()) for key, text in rows]
    count = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    for key, b in data:
        cover = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                cover[p : p + length] = True
        spans = int((cover[1:] & ~cover[:-1]).sum() + cover[0]) if len(b) else 0
        kept = bytes(c for c, gone in zip(b, cover) if not gone)
        yield (
            key, hashlib.sha256(kept).hexdigest(), len(b), int(cover.sum()), spans
        )


def random_rows(seed, letters, n):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        text = "".join(rng.choice(list(letters), rng.integers(0, 120)))
        if rows and rng.random() < 0.6:
            other = rows[rng.integers(len(rows))][1]
            a = rng.integers(0, len(other) + 1)
            text = text[: rng.integers(0, 60)] + other[a : a + rng.integers(0, 70)] + text[:20]
        rows.append((k, text))
    return rows + rows[:3] + [(900, None), (901, "")]


@pytest.mark.parametrize("letters,length", [("ab", 20), ("abcdefgh", 20), ("aé", 33), ("a", 30)])
def test_short_strings(spark, letters, length):
    rows = random_rows(len(letters) + length, letters, 60)
    got = repeats.without_repeats(documents(spark, rows), length=length)
    columns = sorted(got.columns)
    assert columns == ["doc_id", "kept_sha256", "n_bytes", "n_removed", "n_spans"]
    mine = sorted((tuple(r) for r in got.select(columns).collect()), key=repr)
    assert mine == sorted(expected(rows, length), key=repr)


def test_odd_documents(spark):
    got = check_shapes(documents(spark), repeats.without_repeats)
    assert got == sorted(expected(ROWS, 200), key=repr)


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = repeats.without_repeats(docs)
    mine = sorted((tuple(r) for r in got.select(sorted(got.columns)).collect()), key=repr)
    assert mine == sorted(expected(rows, 200), key=repr)


def test_chunks_find_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, n, np.uint8)) for n in (0, 19, 20, 700, 5000)] + [b"a" * 400]
    whole = repeats.Sampling(20).anchors(texts)
    monkeypatch.setattr(repeats, "CHUNK", 256)
    for a, b in zip(whole, repeats.Sampling(20).anchors(texts)):
        assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_every_string_has_one_anchor_in_itself():
    sampling = repeats.Sampling(20)
    text = bytes(np.random.default_rng(2).integers(97, 100, 3000, np.uint8))
    position, _, first, last = sampling.anchors([text])[0]
    assert first[0] == 0 and last[-1] == len(text) - 20
    assert (first[1:] == last[:-1] + 1).all()
    assert (position >= last).all() and (position <= first + 20 - sampling.gram).all()
