"""Which product an observation belongs to.

Row by row, in order of `seq`, a row belongs to the product that now has its url; else to the one of its name,
store and unit; else to the one of its name and store if that has no url now; else it creates a product,
unless its name and store are taken. A row that belongs to a product overwrites its unit and url, which
the rows after it see.

Most names never need that order: all rows of a name and store have one url that no other name has, or all
have none, and the stored product does not differ. These are settled by aggregates and one join. The others
form components, rows and stored products that names or urls connect, and only those are gone through in
order, each in one task as a stream of rows, keeping unit and url of the products of the component. Large
ones are gone through in slices of time, so that no task sorts more rows than a slice has.

What goes through a task in order are numbers of rows and names, units and urls; the other columns of the rows
are joined by the number of the row at last.
"""

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions import missing
from pricetrail.plans.components import connected_components
from pricetrail.plans.joins import join_counted, join_large
from pricetrail.plans.lineage import cut_lineage

NAME = ["name", "supermarket"]
# What a walk finds for a row, and a product as a walk takes it in; `_order` is its id.
PLACED = {"_row": "long", "product_id": "long", "stored_unit": "string", "is_new": "boolean", "reason": "string"}
MET = {"_group": "long", "_rank": "int", "_order": "long", "_pos": "int", "_name": "long", "unit": "string",
       "url": "string", "_kept": "string"}
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

# What goes by in a walk, in this order: stored products, products created by earlier rows, rows.
STORED, CREATED, ROW = range(3)
# Of stored products whose name no row has.
NO_NAME = -1
# Rows of large groups that are sorted at once; a task takes about 150 bytes for each.
SLICE_ROWS = 4_000_000
PRODUCTS_AT_ONCE = 10_000


def resolve(
    observations: DataFrame, products: DataFrame, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Observations with `product_id`, `stored_unit`, `is_new` and `reason`; see ingest.resolve_products."""
    # Read for each step below; `_row` is a number that stays, whatever `seq` is.
    rows = cut_lineage(observations.withColumn("_row", F.monotonically_increasing_id()))
    products = cut_lineage(products.select("id", *NAME, "unit", "url"))
    # One row for all rows of a name and url: what the steps before the walk need to know of the batch.
    seen = cut_lineage(
        rows.groupBy(*NAME, "url").agg(F.min("seq").alias("_first"), F.count("*").alias("_rows"))
    )
    has_name = F.col("name").isNotNull() & F.col("supermarket").isNotNull()
    all_named = seen.filter(~has_name).isEmpty()
    seen = seen.filter(has_name)
    linked = _linked_names(seen, products)
    names = _names(seen, products, linked).withColumn("_name", F.monotonically_increasing_id())
    names = cut_lineage(names)
    stored, first = F.col("_stored"), F.col("_first")
    columns = [*observations.columns, "product_id", "stored_unit", "is_new", "reason"]
    placed = join_counted(rows, names.filter("_settled"), NAME).select(
        *observations.columns,
        F.coalesce(stored["id"], first).alias("product_id"),
        stored["unit"].alias("stored_unit"),
        (stored["id"].isNull() & (F.col("seq") == first)).alias("is_new"),
        F.lit(None).cast("string").alias("reason"),
    )
    tangled = names.filter("NOT _settled").select(*NAME, "_group", "_name")
    if not tangled.isEmpty():
        walked = join_counted(rows.select("_row", "seq", *NAME, "unit", "url"), tangled, NAME)
        found = _in_order(
            walked.drop(*NAME), _products_met(products, tangled, linked),
            join_large(seen.select(*NAME, "_rows"), tangled, NAME), slice_rows,
        )
        placed = placed.unionByName(join_large(rows, found, "_row").select(columns))
    if all_named:
        return placed
    nameless = rows.filter(~has_name).select(
        *observations.columns, F.lit(None).cast("long").alias("product_id"),
        F.lit(None).cast("string").alias("stored_unit"), F.lit(False).alias("is_new"),
        F.lit("name_missing").alias("reason"),
    )
    return placed.unionByName(nameless)


def _key() -> Column:
    return F.xxhash64(*NAME).alias("_key")


def _linked_names(seen: DataFrame, products: DataFrame) -> DataFrame | None:
    """`_key, _group` of names that share a url with another name, None if there are none.

    Keys and urls are hashes: names that collide would only be gone through together.
    """
    known = seen.select(*NAME, "url").union(products.select(*NAME, "url"))
    pairs = known.filter(~missing(F.col("url"))).select(_key(), F.xxhash64("url").alias("url"))
    shared = cut_lineage(
        pairs.groupBy("url")
        .agg(F.min("_key").alias("least"), F.max("_key").alias("most"))
        .filter("least != most")
    )
    links = join_counted(pairs, shared, ["url"]).select(F.col("_key").alias("a"), F.col("least").alias("b"))
    links = cut_lineage(links.filter("a != b").distinct())
    if links.isEmpty():
        return None
    return cut_lineage(
        connected_components(links).select(
            F.col("node").alias("_key"), F.col("component").alias("_group")
        )
    )


def _names(seen: DataFrame, products: DataFrame, linked: DataFrame | None) -> DataFrame:
    """Per name and store: its stored product, first row, group, and whether the order can matter."""
    by_name = seen.groupBy(*NAME).agg(
        F.min("_first").alias("_first"),
        F.count("*").alias("_urls"),  # no url counts as one of them
        F.max("url").alias("_url"),
    )
    # (name, supermarket) is unique in the catalog.
    stored = products.groupBy(*NAME).agg(F.min(F.struct("id", "unit", "url")).alias("_stored"))
    names = join_large(by_name, stored, NAME, "left").withColumn("_key", _key())
    if linked is None:
        names = names.withColumn("_group", F.lit(None).cast("long"))
    else:
        names = join_large(names, linked, "_key", "left")
    url, stored_url = F.col("_url"), F.col("_stored.url")
    fits = F.when(url.isNull(), stored_url.isNull()).otherwise(
        (url != "") & (stored_url.isNull() | (stored_url == url))
    )
    return names.select(
        *NAME, "_stored", "_first",
        (F.col("_group").isNull() & (F.col("_urls") == 1) & fits).alias("_settled"),
        F.coalesce("_group", "_key").alias("_group"),
    )


def _products_met(products: DataFrame, tangled: DataFrame, linked: DataFrame | None) -> DataFrame:
    """Stored products that rows gone through in order can meet, with their group, as a walk takes them in."""
    if linked is None:
        met = join_large(products, tangled, NAME)
    else:
        by_url = linked.select("_key", F.col("_group").alias("_linked"))
        met = (
            products.withColumn("_key", _key())
            .join(tangled, NAME, "left")
            .join(by_url, "_key", "left")
            .withColumn("_group", F.coalesce("_linked", "_group"))
            .filter("_group IS NOT NULL")
        )
    return met.select(
        "_group", F.lit(STORED).alias("_rank"), F.col("id").alias("_order"), F.lit(0).alias("_pos"),
        F.coalesce("_name", F.lit(NO_NAME)).alias("_name"), "unit", "url", F.col("unit").alias("_kept"),
    )


class Product:
    """A product on the shelf: unit and url now, its unit stored before the batch."""

    __slots__ = ("rank", "id", "unit", "url", "kept", "name")

    def __init__(
        self, rank: int, id_: int | None, unit: str | None, url: str | None, kept: str | None, name: int
    ):
        self.rank, self.id, self.unit, self.url, self.kept, self.name = rank, id_, unit, url, kept, name

    def order(self) -> tuple:
        """Places that are not known, of products without an id, go first."""
        return self.rank, self.id is not None, self.id or 0


class Shelf:
    """The products of a component while its rows come by."""

    def __init__(self):
        self.by_name: dict[int, Product] = {}
        # The first product that has a url, and all of them where there were several at the start.
        self.by_url: dict[str, Product] = {}
        self.shared: dict[str, dict[tuple, Product]] = {}

    def add(self, product: Product) -> Product:
        if product.name != NO_NAME:
            self.by_name[product.name] = product
        url = product.url
        if url:
            holder = self.by_url.setdefault(url, product)
            if holder is not product:
                held = self.shared.setdefault(url, {holder.order(): holder})
                held[product.order()] = product
                self.by_url[url] = held[min(held)]
        return product

    def _move(self, product: Product, url: str | None) -> None:
        """To a url that no product has."""
        old = product.url
        held = self.shared.get(old) if self.shared else None
        if held:
            held.pop(product.order(), None)
            if held:
                self.by_url[old] = held[min(held)]
            else:
                del self.by_url[old], self.shared[old]
        elif old:
            del self.by_url[old]
        product.url = url
        if url:
            self.by_url[url] = product

    def place(self, name: int, unit: str | None, url: str | None) -> Product | None | bool:
        """The product of a row, None for a duplicate name, False for a name that has no product."""
        product = self.by_url.get(url) if url else None
        if product is None:
            product = self.by_name.get(name)
            if product is None:
                return False
            if not (unit and product.unit == unit or product.url is None):
                return None
            if product.url != url:
                self._move(product, url)
        product.unit = unit
        return product

    def left(self, group: int | None) -> list[dict]:
        """The products that rows can still meet, as a walk takes them in; the one of a name comes last."""
        named = {id(p): p for p in self.by_name.values()}
        held = [*self.by_url.values(), *(p for by in self.shared.values() for p in by.values())]
        others = {id(p): p for p in held if id(p) not in named}
        every = sorted([*others.values(), *named.values()], key=Product.order)
        return [
            dict(_group=group, _rank=p.rank, _order=p.id, _pos=pos, _name=p.name, unit=p.unit, url=p.url,
                 _kept=p.kept)
            for pos, p in enumerate(every)
        ]


def _in_order(
    rows: DataFrame, products: DataFrame, counts: DataFrame, slice_rows: int
) -> DataFrame:
    """Rows of each group in order of `seq`, its stored products before them. `counts`: `_rows` by `_group`."""
    sizes = counts.groupBy("_group").agg(F.sum("_rows").alias("n"))
    # One row per `slice_rows` rows of the batch at most.
    large = [row["_group"] for row in sizes.filter(F.col("n") > slice_rows).collect()]
    if not large:
        return _walk(rows, products, False)
    in_large = F.col("_group").isin(large)
    small = _walk(rows.filter(~in_large), products.filter(~in_large), False)
    sliced = _in_slices(rows.filter(in_large), products.filter(in_large), slice_rows)
    return reduce(DataFrame.unionByName, [small, *sliced])


def _in_slices(rows: DataFrame, products: DataFrame, slice_rows: int) -> list[DataFrame]:
    """Rows of large groups, some time at a time: a slice has `slice_rows` rows or about that, whatever
    the size of the groups, and begins with the products as the slice before left them."""
    rows = cut_lineage(rows)
    slices = ceil(rows.count() / slice_rows)
    ends = rows.approxQuantile("seq", [i / slices for i in range(1, slices)], 0.1 / slices)
    ends = sorted({int(end) for end in ends})
    spread = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * slices)
    # In order of seq, so that a slice reads its own files only.
    rows = cut_lineage(rows.repartitionByRange(spread, "seq"))
    seq, out = F.col("seq"), []
    for start, end in zip([None, *ends], [*ends, None]):
        within = F.lit(True) if end is None else F.coalesce(seq < end, F.lit(start is None))
        if start is not None:
            within = within & (seq >= start)
        elif end is not None:
            within = within | seq.isNull()
        walked = cut_lineage(_walk(rows.filter(within), products, True))
        out.append(walked.filter(F.col("_rank") == ROW).select(*PLACED))
        products = walked.filter(F.col("_rank") != ROW).select(*MET)
    return out


def _walk(rows: DataFrame, products: DataFrame, leave: bool) -> DataFrame:
    """What rows belong to, by `_row`; if `leave`, also the products as the rows left them, of lower `_rank`."""
    stream = (
        rows.withColumnRenamed("seq", "_order")
        .withColumn("_rank", F.lit(ROW))
        .unionByName(products, allowMissingColumns=True)
        .repartition("_group")
        .sortWithinPartitions("_group", "_rank", "_order", "_pos")
    )
    fields = PLACED | MET if leave else PLACED
    schema = pa.schema([(name, ARROW[kind]) for name, kind in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shelf = None, Shelf()
        for batch in batches:
            # Lists by way of numpy: a value at a time, Arrow takes many times as long.
            groups, ranks, names, units, urls = (
                batch.column(c).to_numpy(zero_copy_only=False).tolist()
                for c in ("_group", "_rank", "_name", "unit", "url")
            )
            order, kept = batch.column("_order"), batch.column("_kept")
            found, new, left, place = [], [], [], shelf.place
            for at, (now, rank, name, unit, url) in enumerate(zip(groups, ranks, names, units, urls)):
                if now != group:
                    left += shelf.left(group) if leave else []
                    group, shelf = now, Shelf()
                    place = shelf.place
                if rank == ROW:
                    product = place(name, unit, url)
                    if product is False:
                        new.append(len(found))
                        product = shelf.add(Product(CREATED, order[at].as_py(), unit, url, None, name))
                    found.append(product)
                else:
                    shelf.add(Product(rank, order[at].as_py(), unit, url, kept[at].as_py(), name))
            if found:
                yield given(batch.filter(pc.equal(batch.column("_rank"), ROW)).column("_row"), found, new)
            yield from told(left)
        if leave:
            yield from told(shelf.left(group))

    def given(numbers: pa.Array, found: list[Product | None], new: list[int]) -> pa.RecordBatch:
        created = np.zeros(len(found), bool)
        created[new] = True
        rejected = pa.array([p is None for p in found])
        out = {
            "_row": numbers,
            "product_id": pa.array([None if p is None else p.id for p in found], pa.int64()),
            "stored_unit": pa.array([None if p is None else p.kept for p in found], pa.string()),
            "is_new": pa.array(created),
            "reason": pc.if_else(rejected, "duplicate_name", pa.scalar(None, pa.string())),
            "_rank": pa.repeat(pa.scalar(ROW, pa.int32()), len(found)),
        }
        columns = [out[f.name] if f.name in out else pa.nulls(len(found), f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def told(left: list[dict]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(left), PRODUCTS_AT_ONCE):
            yield pa.RecordBatch.from_pylist(left[at : at + PRODUCTS_AT_ONCE], schema)

    return stream.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in fields.items()))
