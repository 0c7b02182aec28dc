import re

import numpy as np
from odd import LONG, check_shapes, documents, sentence

from pricetrail.llm import containment
from pricetrail.llm.common import table

ITEMS = [
    (1, sentence(11, 30)), (2, sentence(12, 7)), (3, "just three words"), (4, "one"), (5, None),
    (6, ""), (7, sentence(13, 90)), (8, sentence(13, 90)), (None, sentence(14, 20)),
    (9, " ".join(LONG.split()[777:820])), (10, "the same word " * 12),
]
CUT = sentence(11, 30).split()
DOCS = [
    (1, None), (2, ""), (3, "x " * 50 + sentence(11, 30) + " y" * 4000), (4, LONG), (4, LONG),
    (5, sentence(11, 30).upper().replace(" ", ",  ")), (6, " ".join(CUT[:27]) + " z z z"),
    (7, " ".join(CUT[:20]) + " z z z"), (8, "here are just three words for you"), (9, "one"),
    (10, sentence(13, 90) + " " + sentence(12, 7)), (None, sentence(11, 30)),
    (11, " ".join(CUT[:15]) + " filler" * 300 + " " + " ".join(CUT[11:])), (12, "the same word " * 9),
]


def grams(words, k):
    return {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}


def expected(docs, items):
    found = set()
    for key, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for item, wanted in items:
            own = re.findall(r"\w+", (wanted or "").lower())
            if key is None or item is None or not own:
                continue
            k = min(5, len(own))
            want = grams(own, k)
            n = len(want & grams(words, k))
            if n / len(want) >= 0.8:
                found.add((n / len(want), key, item, n, len(want)))
    return sorted(found, key=repr)


def test_odd_documents(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = check_shapes(
        documents(spark, DOCS), lambda df: containment.contained_items(df, items)
    )
    # A passage in two far parts is found where one of its windows gave a candidate.
    want = expected(DOCS, ITEMS)
    assert set(got) <= set(want) and {r for r in want if r[1] != 11} <= set(got)
    assert check_shapes(items.limit(0), lambda df: containment.contained_items(
        documents(spark, DOCS), df)) == []


def test_many_items_of_one_size_are_all_found(spark):
    docs, items = [], []
    for k in range(400):
        text = sentence(5000 + k, 16 + k % 60)
        items.append((k, text))
        docs.append((k, sentence(9000 + k, k) + " " + text + " " + sentence(7000 + k, 400 - k)))
    got = containment.contained_items(
        documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {(k, k) for k in range(400)} == {(r.doc_id, r.item_id) for r in got.collect()}


def test_short_items_in_long_documents(spark):
    """Items of 1 to 14 words, each in the middle of its document, whole or with one end cut off."""
    docs, items = [], []
    for k in range(420):
        words = [f"item{k}word{j}" for j in range(1 + k % 14)]
        items.append((k, " ".join(words)))
        held = words[: len(words) - k % 2] if len(words) > 8 else words
        docs.append((k, " ".join([sentence(k, 300 + k), *held, sentence(k + 1, 900 - k)])))
    got = containment.contained_items(
        documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    )
    pairs = sorted((r.containment, r.doc_id, r.item_id, r.n_shared, r.n_shingles)
                   for r in got.collect())
    want = sorted(x for d, i in zip(docs, items) for x in expected([d], [i]))
    assert len(want) > 380 and pairs == want


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    items = table(spark, "/root/testdata/sf0.001", "benchmark")
    got = containment.contained_items(docs, items)
    mine = sorted((tuple(r) for r in got.select(sorted(got.columns)).collect()), key=repr)
    want = expected([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert mine == want and len(want) > 0
    clean = containment.decontaminate(docs, items)
    assert clean.columns == docs.columns
    hit = {r[1] for r in want}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(
        r.doc_id for r in docs.collect() if r.doc_id not in hit
    )


def test_windows_give_the_minima():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 1 << 63, n, np.uint64) for n in (1, 16, 17, 100, 333)]
    windows = containment.Windows(texts, [0, 2])
    factor = np.uint64(0x9E3779B97F4A7C15)
    for part, owner, minima in windows.minima(factor):
        size = containment.SMALLEST << part
        for k, text in enumerate(texts):
            spread = text * factor
            starts = range(0, max(len(text) - size, 1), size)
            assert minima[owner == k].tolist() == [spread[a : a + 2 * size].min() for a in starts]


def test_bloom_filter_never_misses(spark):
    rng = np.random.default_rng(5)
    values = np.append(rng.integers(-(1 << 62), 1 << 62, 500), [0, 1, 32768, 32769, -1, 1 << 23])
    df = spark.createDataFrame([(int(v),) for v in values], "value long")
    bits = containment.bloom_filter(df)
    assert containment.passes(bits, values.view(np.uint64)).all()
    assert containment.passes(bits, rng.integers(0, 1 << 63, 10000, np.uint64)).mean() < 0.01


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand; pieces cut no word."""
    texts = ["", "Ab ab AB_1", "x" * 300 + " é É ß İ, — «ab»\nab", "a b " * 200, "\U0001f600 字 ab"]
    whole, bounds = containment.word_hashes(texts)
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = [w for each in words for w in each]
    assert len(set(zip(flat, whole.tolist()))) == len(set(flat)) == len(set(whole.tolist()))
    monkeypatch.setattr(containment, "PIECE", 64)
    pieces, same = containment.word_hashes(texts)
    assert pieces.tolist() == whole.tolist() and same.tolist() == bounds.tolist()
