"""Identity of observations against a walk through the rows, one by one."""

import random

import pytest
from helpers import day, products
from pyspark.sql import functions as F

from pricetrail.operators import identity, ingest
from pricetrail.plans.components import connected_components
from pricetrail.schemas import OBSERVATIONS


def observations(spark, rows):
    names = OBSERVATIONS.fieldNames()
    full = [dict(scraped_at=day(1), price=1.0) | row for row in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], OBSERVATIONS)


def walk(stored, rows):
    """seq -> (product, new, reason): every row looks through the catalog as the row before left it."""
    shelf, out = [dict(p) for p in sorted(stored, key=lambda p: p["id"])], {}
    for row in sorted(rows, key=lambda r: r["seq"]):
        name, unit, url = (row["name"], row["supermarket"]), row.get("unit"), row.get("url")
        same = [p for p in shelf if (p["name"], p["supermarket"]) == name]
        found = next(
            (p for p in shelf if url and p.get("url") == url),
            next((p for p in same if unit and p.get("unit") == unit),
                 next((p for p in same if p.get("url") is None), None)),
        )
        if found:
            found.update(unit=unit, url=url)
            out[row["seq"]] = found["id"], False, None
        elif same:
            out[row["seq"]] = None, False, "duplicate_name"
        else:
            shelf.append(dict(id=row["seq"], name=name[0], supermarket=name[1], unit=unit, url=url))
            out[row["seq"]] = row["seq"], True, None
    return out


def resolved(spark, stored, rows):
    got = ingest.resolve_products(observations(spark, rows), products(spark, stored)).collect()
    units = {p["id"]: p.get("unit") for p in stored}
    assert all(r.stored_unit == units.get(r.product_id) for r in got)
    assert len(got) == len(rows)
    return {r.seq: (r.product_id, r.is_new, r.reason) for r in got}


def shop(id_, name, unit=None, url=None, store="ah"):
    return dict(id=id_, name=name, supermarket=store, unit=unit, url=url)


def seen(seq, name, unit=None, url=None, store="ah"):
    return dict(seq=seq, name=name, supermarket=store, unit=unit, url=url)


@pytest.mark.parametrize("rows, want", [
    ([seen(11, "N", "1 l", "U2"), seen(12, "N", None, "U2")], {11: 1, 12: 1}),
    ([seen(11, "N", "1 l", "U2"), seen(12, "M", "1 l", "U1")], {11: 1, 12: 12}),
    ([seen(11, "N", "2 l", "U1"), seen(12, "N", "2 l")], {11: 1, 12: 1}),
    ([seen(11, "N", "2 l", "U1"), seen(12, "N", "1 l")], {11: 1, 12: None}),
])
def test_a_row_sees_what_the_row_before_has_left(spark, rows, want):
    stored = [shop(1, "N", "1 l", "U1")]
    assert {s: p for s, (p, _, _) in resolved(spark, stored, rows).items()} == want
    assert {s: p for s, (p, _, _) in walk(stored, rows).items()} == want


@pytest.mark.parametrize("seed", range(6))
def test_random_batches(spark, seed):
    """Many small worlds in one batch, from settled to thoroughly tangled ones."""
    choice = random.Random(seed)
    stored, rows = [], []
    for world in range(80):
        n_names, n_urls = choice.randrange(1, 4), choice.randrange(1, 4)
        urls = [f"{world}/{k}" for k in range(n_urls)] + [None] * choice.randrange(0, 2)
        urls += [""] * (choice.random() < 0.1)
        for n in range(n_names):
            if choice.random() < 0.5:
                stored.append(shop(len(stored) + 1, f"{world}-{n}", choice.choice(["1 l", "2 l", None]),
                                   choice.choice(urls)))
        for _ in range(choice.randrange(0, 9)):
            rows.append(seen(0, f"{world}-{choice.randrange(n_names)}",
                             choice.choice(["1 l", "2 l", None, ""]), choice.choice(urls)))
    choice.shuffle(rows)
    for k, row in enumerate(rows):
        row["seq"] = 1000 + k
    assert resolved(spark, stored, rows) == walk(stored, rows)


def test_chains_of_names_and_urls(spark):
    """Each url is shared by two names: one component through all of them."""
    rows = [seen(100 + k, f"N{k // 2}", f"{k % 3} l", f"U{(k + 1) // 2}") for k in range(60)]
    rows += [seen(200 + k, f"N{k}", "1 l") for k in range(30)]
    stored = [shop(1, "elsewhere", "1 l", "U7"), shop(2, "N5", "2 l")]
    assert resolved(spark, stored, rows) == walk(stored, rows)


def test_rows_without_a_name(spark):
    rows = [seen(1, None, "1 l", "U1"), seen(2, "N", "1 l", "U1")]
    assert resolved(spark, [], rows) == {1: (None, False, "name_missing"), 2: (2, True, None)}
    assert resolved(spark, [], []) == {}


def test_order_is_kept_for_names_that_need_it_only(spark):
    """Names of one own url, or of none at all, are settled without a walk."""
    rows = [seen(k, f"N{k % 10}", "1 l", f"U{k % 10}" if k % 10 < 5 else None) for k in range(100, 160)]
    rows += [seen(900, "T", "1 l", "T1"), seen(901, "T", "2 l", "T2")]
    seen_rows = observations(spark, rows).groupBy("name", "supermarket", "url").agg(F.min("seq").alias("_first"))
    stored = products(spark, [shop(1, "N0", "1 l", "U0"), shop(2, "N7", "1 l")])
    names = identity._names(seen_rows, stored, identity._linked_names(seen_rows, stored)).collect()
    assert {r.name for r in names if not r._settled} == {"T"}


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 101), (7, 7), (200, 150)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100, 150: 150, 200: 150}
    assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_large_components_are_gone_through_in_slices(spark, seed):
    pick = random.Random(seed)
    urls = [None, "", "U1", "U2", "U3"]
    stored = [shop(n, f"N{n}", pick.choice([None, "1 l"]), pick.choice(urls)) for n in range(1, 4)]
    rows = [
        seen(100 + k, f"N{pick.randint(1, 6)}", pick.choice([None, "1 l", "2 l"]), pick.choice(urls))
        for k in range(60)
    ]
    got = identity.resolve(observations(spark, rows), products(spark, stored), slice_rows=7).collect()
    units = {p["id"]: p["unit"] for p in stored}
    assert all(r.stored_unit == units.get(r.product_id) for r in got)
    assert len(got) == 60 and {r.seq: (r.product_id, r.is_new, r.reason) for r in got} == walk(stored, rows)


def test_no_slice_holds_more_rows_than_it_may(spark, monkeypatch):
    sizes, plain = [], identity._walk

    def counted(rows, *others):
        sizes.append(rows.count())
        return plain(rows, *others)

    monkeypatch.setattr(identity, "_walk", counted)
    rows = [seen(k, f"N{k % 5}", "1 l", f"U{k % 3}") for k in range(1, 81)]
    got = identity.resolve(observations(spark, rows), products(spark, []), slice_rows=20)
    assert got.count() == 80 and sum(sizes) == 80 and max(sizes) <= 25


def test_large_components_side_by_side(spark):
    """Two components above a slice, one below."""
    pick = random.Random(9)
    stores = ["ah"] * 4 + ["jumbo"] * 4 + ["dirk"]
    stored = [shop(n, f"N{n % 3}", "1 l", f"{s}{n % 2}", s) for n, s in enumerate(("ah", "jumbo", "ah", "dirk"), 1)]
    rows = []
    for k in range(90):
        store = pick.choice(stores)
        url = pick.choice([None, "", f"{store}0", f"{store}1", f"{store}2"])
        rows.append(seen(100 + k, f"N{pick.randint(0, 4)}", pick.choice([None, "1 l", "2 l"]), url, store))
    got = identity.resolve(observations(spark, rows), products(spark, stored), slice_rows=12).collect()
    assert len(got) == 90 and {r.seq: (r.product_id, r.is_new, r.reason) for r in got} == walk(stored, rows)


def test_a_walk_takes_in_only_what_decides(spark, monkeypatch):
    """The other columns of a row pass no walk: they come back by its number, also where `seq` repeats or is null."""
    taken, plain = [], identity._walk

    def noted(rows, *others):
        taken.append(set(rows.columns))
        return plain(rows, *others)

    monkeypatch.setattr(identity, "_walk", noted)
    rows = [seen(k // 2 if k else None, "N", "1 l", f"U{k % 3}") | dict(brand=f"B{k}") for k in range(20)]
    got = identity.resolve(observations(spark, rows), products(spark, [shop(1, "N", "1 l", "U9")])).collect()
    assert taken == [{"_row", "seq", "_group", "_name", "unit", "url"}]
    assert sorted((r.brand, r.product_id, r.is_new) for r in got) == sorted((f"B{k}", 1, False) for k in range(20))


def test_urls_that_were_left_are_forgotten():
    shelf = identity.Shelf()
    first = shelf.add(identity.Product(identity.STORED, 1, "1 l", "U0", "1 l", 7))
    second = shelf.add(identity.Product(identity.STORED, 2, "1 l", "U0", "1 l", 8))
    assert shelf.place(8, "2 l", "U0") is first
    assert all(shelf.place(8, "1 l", f"U{k}") is second for k in range(1, 50))
    assert shelf.place(7, "2 l", "V") is first and shelf.place(9, "1 l", "U0") is False
    assert set(shelf.by_url) == {"U49", "V"} and not shelf.shared
