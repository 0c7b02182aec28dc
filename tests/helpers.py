"""Small frames of the stored tables."""

import datetime as dt

from pricetrail.schemas import CATEGORY_MAP, PRICES, PRODUCTS


def day(number, hour=6):
    return dt.datetime(2026, 3, number, hour)


def products(spark, rows):
    """rows: dicts of product columns; id, name and supermarket are required."""
    names = PRODUCTS.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PRODUCTS)


def prices(spark, rows):
    """rows: (id, product_id, price, time[, original_price, is_sale])."""
    full = [(i, p, x, *(rest or (x, 0)), at) for i, p, x, at, *rest in rows]
    return spark.createDataFrame(full, PRICES)


def mapping(spark, rows):
    return spark.createDataFrame(rows, CATEGORY_MAP)
