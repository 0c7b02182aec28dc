import re

import numpy as np
import pytest
import xxhash
from odd import ROWS, check_shapes, documents

from pricetrail.llm import simhash
from pricetrail.llm.common import WorkFolder, table
from pricetrail.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    parts = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]
    parts = parts or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, distance):
    """The class of each fingerprint, by comparing all with all."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def expected(rows, distance=4):
    marked = [(key, plain_fingerprint(text)) for key, text in rows]
    of = classes([f for _, f in marked], distance)
    smallest = {}
    for key, f in marked:
        if key is not None:
            smallest[of[f]] = min(smallest.get(of[f], key), key)
    return sorted(((smallest.get(of[f]), key, f"{f:016x}") for key, f in marked), key=repr)


def test_odd_documents(spark):
    assert check_shapes(documents(spark), lambda df: simhash.near_duplicates(df, 4, 4)) == expected(
        ROWS
    )


def test_table_against_all_pairs(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = simhash.near_duplicates(docs, 4, 4, block=3)
    assert sorted(
        ((r.component_id, r.doc_id, r.fingerprint) for r in got.collect()), key=repr
    ) == expected(rows)


@pytest.mark.parametrize("plan", [None, [10, 54], [21, 21, 22], [13, 13, 13, 13, 12]])
def test_links_of_dense_groups(spark, plan):
    """Chains and clouds of fingerprints, under chosen partitions and the planned ones."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for start in fps[:6]:
        for _ in range(40):
            step = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            fps.append((fps[-1] if rng.random() < 0.5 else start) ^ step)
    fps = sorted({f - (f >> 63 << 64) for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    n, both = simhash.bit_statistics(df)
    assert n == len(fps)
    chosen = simhash.plan_probes(n, both, 4)
    if plan:
        cuts = np.cumsum([0, *plan])
        groups = [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]
        _, thresholds = simhash.allocate(n, both, groups, 4)
        assert sum(thresholds) == 4 - len(groups) + 1
        chosen = [(g, e) for g, e in zip(groups, thresholds) if e >= 0]
    work = WorkFolder(spark, "test")
    links = simhash.bucket_links(simhash.probe_rows(df, chosen), 4, work, block=4)
    members = {r.node: r.component for r in connected_components(links, work).collect()}
    unsigned = {f: f % (1 << 64) for f in fps}
    want = classes(unsigned.values(), 4)
    mine = {f: members.get(f, f) for f in fps}
    pairs = {(mine[f], want[unsigned[f]]) for f in fps}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_plan_covers_the_distance():
    both = np.eye(64) * 50 + 25
    for n in (10, 10**6, 10**9, 10**12):
        plan = simhash.plan_probes(n, both * n / 100, 4)
        # A pair that no partition catches differs in at least e + 1 bits of each: over four in all.
        assert sum(e + 1 for _, e in plan) == 5
        assert len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (2000, 2000)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = connected_components(df, WorkFolder(spark, "test")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 301]
