import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from odd import LONG, ROWS, check_shapes, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from pricetrail.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(rows, targets, buckets=10_000, least=20, percent=25, seed=7):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t))

    s, t = count(text for _, text in rows), count(targets)
    n_s, n_t = sum(s.values()), sum(t.values())

    def gain(f):
        b = zlib.crc32(f.encode()) % buckets
        ratio = ((t[b] + 1) * (n_s + buckets)) / ((s[b] + 1) * (n_t + buckets))
        return math.floor(1000 * math.log(ratio))

    out = []
    for key, text in rows:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        name = "null" if key is None else key
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(f), len(words(text)), None, weight + noise, weight])
    able = [r for r in out if r[2] >= least]
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[3] = k + 1
    # Columns by name: doc_id, n_features, n_words, rank, score, weight.
    return sorted(map(tuple, out), key=repr)


TARGETS = [LONG[:3000], "word é é é", None, ""]


def test_against_brute_force(spark):
    rows = ROWS + [(100 + k, LONG[k * 300 : k * 300 + 40 * k]) for k in range(40)]
    items = spark.createDataFrame(list(enumerate(TARGETS)), "item_id long, text string")
    got = check_shapes(documents(spark, rows), lambda df: importance.resample(df, items, size=500)
                       if df.count() else importance.resample(df, items))
    assert got == brute(rows, TARGETS)


def test_without_target(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = documents(spark)
    got = sorted((tuple(r[c] for c in sorted(r.asDict())) for r in
                  importance.resample(df, none).collect()), key=repr)
    assert got == brute(ROWS, [])


def test_ranks_cross_ranges(spark):
    rows = [(k // 3, f"{LONG[:200]} {k % 3}") for k in range(900)]
    df = documents(spark, rows).repartition(7)
    got = importance.resample(df, df.limit(5)).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 226))
    assert [-r.score for r in got] == sorted(-r.score for r in got)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.text(alphabet="abAZ09zé字 \n.,-", max_size=90), max_size=5),
    st.sampled_from([1, 7, 40, 1 << 17]),
)
def test_interned(texts, size):
    texts = [*texts, "x" * 80 + " " + "y" * 70]
    got, counts = [Counter() for _ in texts], np.zeros(1000, int)
    for part in importance.parts([t.encode() for t in texts], size):
        table, row = importance.interned(part, 1000)
        raw = part.data.tobytes()
        grams = [raw[a : a + n] for a, n in zip(table.start, table.size)]
        assert len(table.count) == len(set(grams))
        for gram, key, slot, r in zip(grams, table.keys, table.slot, row):
            assert int(key) == xxhash.xxh64_intdigest(gram)
            assert table.bucket[slot] == zlib.crc32(gram) % 1000
            got[r][gram.decode()] += 1
        np.add.at(counts, table.bucket, table.count)
    assert got == [Counter(features(t)) for t in texts]
    assert counts.sum() == sum(len(features(t)) for t in texts)


def test_equal_keys_are_verified(monkeypatch):
    """With one key for all, only the bytes tell n-grams apart."""
    monkeypatch.setattr(importance, "hashes", lambda d, lanes, a, n: np.zeros(len(a), np.uint64))
    (part,) = importance.parts([b"one two three one two onf " + b"z" * 40 + b" " + b"z" * 39 + b"y"])
    table, _ = importance.interned(part, 10)
    assert len(table.count) == 12 and sorted(table.count)[-3:] == [2, 2, 2]


@pytest.mark.parametrize("text", [b"a" * 5000, b"a " * 5000, b"ab" * 700 + b" c" * 700, b" " * 999])
def test_parts_of_odd_texts(text):
    want = Counter(features(text.decode()))
    for size in (1, 64, 1000):
        got = Counter()
        for part in importance.parts([text], size):
            table, _ = importance.interned(part, 10)
            raw = part.data.tobytes()
            got.update(raw[a : a + n].decode() for a, n in zip(table.start, table.size))
        assert got == want
