"""Derived tables at sizes where a small file stands for many rows."""

from checks import supplied as sup

SF_DIR = "/root/testdata/sf0.001"


def test_products_of_one_file_are_parsed_by_many_tasks(spark):
    parts = sup.table(spark, SF_DIR, "part")
    products = sup.products(spark, SF_DIR)
    assert parts.rdd.getNumPartitions() == 1 and products.rdd.getNumPartitions() >= 8
    assert products.count() == 3 * parts.count() == products.select("id").distinct().count()
