import random

import pytest
from helpers import day, mapping, prices, products
from pyspark.sql import functions as F

from pricetrail.operators import matching
from pricetrail.operators.matching import allowed_edits
from pricetrail.schemas import DECISIONS, MATCH_MEMBERS

POOL = ("block string, store_rank int, match_key string, product_id long, unit_type string, "
        "place struct<normalized_name: string, id: long>")  # fmt: skip
STORES = ("ah", "jumbo", "dirk")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def random_names(seed, count, longest, letters="abc"):
    """Names a few edits apart from each other, in two blocks and three stores."""
    rng = random.Random(seed)
    seen, rows = set(), []
    roots = ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(count // 8)]
    while len(rows) < count:
        name = list(rng.choice(roots))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(name))
            name[at : at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        key = (rng.choice("xy"), rng.randint(1, 3), "".join(name))
        if key[2] and key not in seen:
            seen.add(key)
            number = len(rows)
            rows.append((*key, number, rng.choice([None, "g", "ml"]), (key[2], number)))
    return rows


def similar(a, b):
    d, longest = distance(a[2], b[2]), max(len(a[2]), len(b[2]))
    units = a[4] is None or b[4] is None or a[4] == b[4]
    return d if a[0] == b[0] and units and d <= 3 and d / longest < 0.2 else None


def sequential(rows):
    """Base names in order, each taking all free similar names of the other stores."""
    base = sorted((r for r in rows if r[1] == 1), key=lambda r: r[5])
    others = sorted((r for r in rows if r[1] > 1), key=lambda r: (r[1], r[5]))
    taken, groups = set(), {}
    for a in base:
        found = [(o[3], similar(a, o)) for o in others if o[3] not in taken]
        found = [(i, d) for i, d in found if d is not None]
        if found:
            taken.update(i for i, _ in found)
            groups[a[3]] = ({i for i, _ in found}, max(0.7, 1 - 0.1 * found[0][1]))
    return groups


@pytest.mark.parametrize(
    "seed,longest,dense", [(1, 24, 10**6), (2, 12, 10**6), (1, 24, 0), (2, 12, 3), (3, 30, 20)]
)
def test_pairs_equal_the_comparison_of_all_names(spark, seed, longest, dense):
    rows = random_names(seed, 240, longest)
    df = spark.createDataFrame(rows, POOL)
    pairs = matching.similar_pairs(df.filter("store_rank = 1"), df.filter("store_rank > 1"), dense)
    got = {(r.base_id, r.other_id, r.distance) for r in pairs.collect()}
    want = {
        (a[3], b[3], similar(a, b))
        for a in rows for b in rows
        if a[1] == 1 and b[1] > 1 and similar(a, b) is not None
    }
    assert want and got == want


@pytest.mark.parametrize("seed", [5, 6])
def test_groups_equal_the_sequential_assignment(spark, seed):
    rows = random_names(seed, 300, 20)
    matches, members = matching.fuzzy_groups(matching.match_fuzzy(spark.createDataFrame(rows, POOL)))
    want = sequential(rows)
    found = {r.id: r for r in matches.collect()}
    assert {i: pytest.approx(c) for i, (_, c) in want.items()} == {
        i: r.confidence for i, r in found.items()
    }
    got = {}
    for r in members.collect():
        got.setdefault(r.match_id, set()).add(r.product_id)
    assert got == {i: others | {i} for i, (others, _) in want.items()}
    all_members = [p for g in got.values() for p in g]
    assert len(all_members) == len(set(all_members))


def test_allowed_edits(spark):
    rows = spark.range(1, 60).select("id", allowed_edits(F.col("id")).alias("n")).collect()
    for r in rows:
        assert r.n == max(d for d in range(4) if d / r.id < 0.2)


def product(number, store, name, category="c", unit_type=None, **other):
    return dict(id=number, supermarket=store, name=name, normalized_name=name, category=category,
                unit_type=unit_type, **other)


def test_exact_matches(spark):
    df = products(spark, [
        product(1, "ah", "melk 1 l", unit_type="ml"), product(2, "ah", "melk", unit_type="g"),
        product(3, "jumbo", "melk", unit_type="g"), product(4, "dirk", "melk"),
        product(5, "jumbo", "kaas 500 g", unit_type="g"), product(6, "dirk", "kaas", unit_type="ml"),
        product(7, "lidl", "melk"), product(8, "jumbo", "brood"), product(9, "jumbo", "brood"),
    ])
    found = matching.match_exact(matching.match_candidates(df)).collect()
    # "melk" (id 2) comes first at ah; kaas differs in unit; brood is in one store only.
    assert {(r.match_id, r.product_id) for r in found} == {(2, 2), (2, 3), (2, 4)}


def test_second_product_of_a_key_can_still_match_fuzzily(spark):
    df = products(spark, [
        product(1, "ah", "volle melk"), product(2, "jumbo", "volle melk"),
        product(3, "ah", "volle melk"), product(4, "dirk", "volle melks"),
    ])
    empty = mapping(spark, [])
    matches, members = matching.build_match_groups(df, empty)
    assert {(r.id, r.match_type, r.confidence) for r in matches.collect()} == {
        (1, "exact", 0.95), (3, "fuzzy", 0.9),
    }
    assert {tuple(r) for r in members.collect()} == {(1, 1), (1, 2), (3, 3), (3, 4)}
    # Members stay where they are in a later run.
    assert matching.build_match_groups(df, empty, members)[0].count() == 0


def test_categories_limit_fuzzy_matches(spark):
    df = products(spark, [
        product(1, "ah", "halfvolle melk", "zuivel"), product(2, "jumbo", "halfvolle melks", "melk"),
        product(3, "dirk", "halfvolle melkx", "anders"), product(4, "jumbo", "halfvolle mel", None),
    ])
    mapped = mapping(spark, [("z", "ah", "zuivel"), ("z", "jumbo", "melk")])
    _, members = matching.build_match_groups(df, mapped)
    assert {tuple(r) for r in members.collect()} == {(1, 1), (1, 2)}
    _, members = matching.build_match_groups(df, mapped, category="anders")
    assert members.count() == 0


@pytest.fixture(scope="module")
def groups(spark):
    matches = spark.createDataFrame(
        [(1, "melk", "exact", 0.95, 1, None), (2, "kaas", "exact", 0.95, 1, None),
         (3, "appel", "fuzzy", 0.8, 0, None), (4, "peer", "fuzzy", 0.9, 0, None)],
        "id long, canonical_name string, match_type string, confidence double, confirmed int, "
        "created_at timestamp_ntz",
    )
    members = spark.createDataFrame(
        [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7), (4, 8), (4, 9)], MATCH_MEMBERS
    )
    catalog = products(spark, [
        product(1, "ah", "melk", unit_type="ml", price_per_unit=0.5),
        product(2, "jumbo", "melk", unit_type="ml", price_per_unit=1.0),
        product(3, "dirk", "melk", unit_type="g", price_per_unit=9.0),
        product(4, "ah", "kaas"), product(5, "jumbo", "kaas"), product(6, "ah", "appel", "fruit"),
        product(7, "dirk", "appels", "fruit"), product(8, "ah", "peer"), product(9, "jumbo", "peren"),
    ])
    history = prices(spark, [
        (1, 1, 9.0, day(1)), (2, 1, 1.5, day(2)), (3, 2, 1.0, day(1)), (4, 3, 1.26, day(1)),
        (5, 4, 1.0, day(1)), (6, 5, 2.01, day(1)), (7, 6, 1.0, day(1)),
    ])
    return matches, members, catalog, history


def test_review_queue(spark, groups):
    queue = matching.unconfirmed_matches(*groups, limit=1).collect()
    assert [(r.match_id, r.product_id) for r in queue] == [(4, 8), (4, 9)]
    fruit = matching.unconfirmed_matches(
        *groups, category="fruit", category_map=mapping(spark, [])
    ).collect()
    assert [(r.match_id, r.product_id, r.latest_price) for r in fruit] == [(3, 6, 1.0), (3, 7, None)]
    decisions = spark.createDataFrame([(3, True), (4, False)], DECISIONS)
    matches, members = matching.apply_review(groups[0], groups[1], decisions)
    assert {r.id: r.confirmed for r in matches.collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.match_id for r in members.collect()} == {1, 2, 3}


def test_published_groups(groups):
    by_name = matching.matched_groups(*groups, limit=1).collect()
    assert [(r.canonical_name, r.product_id) for r in by_name] == [("kaas", 4), ("kaas", 5)]
    assert matching.matched_groups(*groups, confirmed=False).count() == 4
    # The dearest kaas costs more than twice the cheapest.
    assert {r.match_id for r in matching.plausible_groups(*groups).collect()} == {1}
    table = {r.product_id: r for r in matching.comparison_table(*groups).collect()}
    assert (table[2].is_cheapest, table[2].diff_pct) == (True, None)
    # By unit price ah is cheaper, although the table goes by price; units of dirk differ.
    assert (table[1].diff_pct, table[3].diff_pct) == (-50, 26)
    assert {r.cheapest_store for r in table.values()} == {"jumbo"}


def test_names_with_one_long_prefix(spark):
    """Dense pieces are refined on ids and numbers alone: few rows a name, and the same pairs."""
    rng = random.Random(9)
    prefix = "halfvolle biologische melk uit de wei "
    rows = [
        ("x", 1 + k % 3, prefix + "".join(rng.choices("abcd", k=5)) + str(k), k, None, ("", k))
        for k in range(150)
    ]
    df = spark.createDataFrame(rows, POOL)
    base, others = df.filter("store_rank = 1"), df.filter("store_rank > 1")
    pairs = matching.similar_pairs(base, others, 20)
    got = sorted((r.base_id, r.other_id, r.distance) for r in pairs.collect())
    want = sorted(
        (a[3], b[3], similar(a, b))
        for a in rows for b in rows
        if a[1] == 1 and b[1] > 1 and similar(a, b) is not None
    )
    assert want and got == want
    b, o = matching._base_pieces(base), matching._probe_pieces(others)
    for _ in range(matching.MAX_SHARED_PIECES - 1):
        assert o.count() < 200 * others.count()
        assert set(o.columns) == {"product_id", "signature", "text", "edits", "base_length"}
        dense = matching._dense_signatures(b, o, 20)
        b, o = (
            side.join(dense, "signature", "left_semi").withColumnRenamed("signature", "first").distinct()
            for side in (b, o)
        )
        b, o = matching._cut_base(b), matching._cut_probe(o)


def test_names_with_many_pairs_a_row_are_refined(spark):
    """A piece that fewer than DENSE_PAIRS pairs share, but many for each name, is not enough for a pair."""
    rng = random.Random(4)
    rows = [
        ("x", 1 + k % 3, "halfvolle biologische " + "".join(rng.choices("abcdefghijklmn", k=22)), k, None, ("", k))
        for k in range(150)
    ]
    rows += [("x", 2, row[2][:30] + "q" + row[2][31:], 200 + row[3], None, ("", row[3])) for row in rows[:20]]
    df = spark.createDataFrame(rows, POOL)
    base, others = df.filter("store_rank = 1"), df.filter("store_rank > 1")
    pieces = matching._base_pieces(base), matching._probe_pieces(others)
    pairs = matching._pairs(*pieces, matching.DENSE_PAIRS, matching.MAX_SHARED_PIECES).distinct()
    assert pairs.count() < base.count() * others.count() / 20
    got = sorted((r.base_id, r.other_id, r.distance) for r in matching.similar_pairs(base, others).collect())
    want = sorted(
        (a[3], b[3], similar(a, b))
        for a in rows for b in rows
        if a[1] == 1 and b[1] > 1 and similar(a, b) is not None
    )
    assert want and got == want
