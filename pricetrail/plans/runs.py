"""Whole runs: ingest a batch of observations, match the catalog, publish the datasets."""

import datetime as dt

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pricetrail.operators import catalog, changes, ingest, matching, normalize, publish
from pricetrail.operators.publish import write_csv, write_json
from pricetrail.plans.lineage import cut_lineage
from pricetrail.sources.store import PriceStore


def ingest_run(
    store: PriceStore,
    observations: DataFrame,
    batch: int,
    source: str = "scheduled",
    may_be_empty: bool = False,
) -> list[Row]:
    """Add a batch to the store; returns the summary per store (NULL = total).

    A batch is known by its source and number: one that is finished is not repeated. The store
    numbers the runs, so that sources do not disturb each other. A batch that observed no product
    fails before it becomes visible, unless it `may_be_empty`; then its rejects are stored.
    """
    if store.is_finished(source, batch):
        return []
    run = store.next_run()
    products = store.products()
    # Everything below branches off this result; it is computed once.
    resolved = cut_lineage(ingest.resolve_products(observations, products))
    days = resolved.agg(
        F.min(F.to_date("scraped_at")).alias("first"), F.max(F.to_date("scraped_at")).alias("last")
    ).head()
    stored = store.prices(days["first"], days["last"])
    new_prices = cut_lineage(
        ingest.clean_false_sales(ingest.first_price_per_day(resolved, stored))
    )
    summary = ingest.ingest_summary(resolved, new_prices)
    rows = summary.collect()  # one row per store
    total = 0 if may_be_empty else ingest.require_observations(rows)
    total = total or sum(row["scraped"] for row in rows if row["supermarket"] is None)

    before = store.latest()
    latest = cut_lineage(catalog.refresh_latest(before, new_prices))
    known = before.select(
        F.lit(-1).cast("long").alias("id"), "product_id", "price", "scraped_at"
    ).join(new_prices.select("product_id").distinct(), "product_id", "left_semi")
    series = known.unionByName(new_prices.select("id", "product_id", "price", "scraped_at"))
    jumps = ingest.flag_price_jumps(series).filter(F.col("id") >= 0)
    reason = F.coalesce("reason", ingest.price_reject_reason(F.col("price")))
    rejects = resolved.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    updated = normalize.normalize_names(
        normalize.normalize_units_at(ingest.upsert_products(resolved, products), latest)
    )

    store.write("products", run, updated)
    store.write("latest", run, latest)
    store.write_by_day("prices", run, new_prices, "scraped_at")
    store.write_by_day("unit_changes", run, ingest.detect_unit_changes(resolved), "detected_at")
    store.write("price_jumps", run, jumps)
    store.write("rejects", run, rejects)
    store.finish(run, total, source, batch)
    return rows


def match_run(
    products: DataFrame,
    category_map: DataFrame,
    matches: DataFrame,
    members: DataFrame,
    created_at: dt.datetime,
    category: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Stored groups together with the groups newly found among products in no group yet."""
    found, found_members = matching.build_match_groups(products, category_map, members, category)
    found = found.withColumn("created_at", F.lit(created_at).cast("timestamp_ntz"))
    return matches.unionByName(found), members.unionByName(found_members)


def publish_run(
    products: DataFrame,
    prices: DataFrame,
    unit_changes: DataFrame,
    category_map: DataFrame,
    matches: DataFrame,
    members: DataFrame,
    target: str,
    as_of: dt.date,
    generated_at: dt.datetime,
    days: int = 30,
    min_change: float = 5.0,
    max_changes: int = 200,
    latest: DataFrame | None = None,
) -> None:
    """Write every published dataset below `target`.

    `latest` is the stored table of newest prices; without it, it is made once from the history.
    """
    latest = cut_lineage(catalog.latest_price(prices)) if latest is None else latest
    products = cut_lineage(normalize.normalize(products, latest))
    counts = cut_lineage(catalog.canonical_categories(products, category_map))
    by_category = cut_lineage(publish.category_datasets(products, latest, category_map))
    comparison = cut_lineage(matching.comparison_table(matches, members, products, latest))
    # One pass over the look-back for movers and both inflation reports.
    changed = cut_lineage(changes.changed_prices(prices, days, as_of))

    movers = changes.price_changes(
        products, prices, days, as_of, min_change=min_change, changed=changed
    )
    index = changes.price_index(products, prices)
    datasets = {
        "stats/stores": catalog.store_counts(products),
        "stats/prices": catalog.price_totals(prices),
        "stats/categories": catalog.category_total(products),
        "categories": counts,
        "inflation/category": changes.inflation_by_category(
            products, prices, category_map, days, as_of, changed
        ),
        "inflation/store": changes.inflation_by_store(products, prices, days, as_of, changed),
        "movers": movers.limit(max_changes),
        "sales": changes.fake_sales(products, prices),
        "unit_changes": changes.shrinkflation(products, unit_changes),
        "history": publish.history_extract(prices),
        "matches": matching.plausible_groups(matches, members, products, latest),
        "comparison": comparison,
        "price_index": changes.price_index_wide(index).orderBy("date"),
        "pages": catalog.category_page(by_category.drop("category_slug")),
        "urls": publish.site_urls(counts, comparison),
        "meta": publish.build_meta(products, prices, generated_at),
    }
    for name, rows in datasets.items():
        write_json(rows, f"{target}/{name}")
    write_json(
        by_category, f"{target}/category", "category_slug",
        ("category_slug", "normalized_name", "id"),
    )
    write_json(
        publish.search_index(products, latest), f"{target}/products", "supermarket",
        ("supermarket", "n", "i"), max_rows=100_000,
    )


def export_run(products: DataFrame, prices: DataFrame, target: str, day: dt.date) -> None:
    """Write the full history as JSON (a dated and a latest copy) and as CSV."""
    # Both copies are written from one pass over the prices.
    history = cut_lineage(publish.export_history(products, prices))
    order = ("supermarket", "category", "name", "id", "part")
    for name in (f"prices_{day.isoformat()}", "prices_latest"):
        write_json(history, f"{target}/{name}", order=order)
    rows = publish.export_rows(products, prices)
    write_csv(
        rows.orderBy("supermarket", "category", "name", "product_id", "date"),
        f"{target}/prices_{day.isoformat()}_csv",
    )
