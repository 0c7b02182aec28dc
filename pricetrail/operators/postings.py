"""Trigram postings of product names: term lookup that does not read all names.

A posting is one trigram of a product's name or normalized name, with what a term is verified on. A lookup
reads the list of the term's rarest trigram only and verifies the term in its names, so the result is that of
the scan. `_` and `%` are wildcards and cut a term into pieces; a term without a piece of three characters has
no trigram and is looked up in the catalog itself.
"""

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions import contains_term
from pricetrail.functions.text import ascii_lower
from pricetrail.operators import catalog

SIZE = 3
#: What a posting carries of its product.
CARRIED = ("id", "supermarket", "name", "normalized_name")


def grams(text: Column) -> Column:
    """Different runs of three characters, A-Z folded; none for NULL and shorter texts."""
    folded = ascii_lower(text)
    starts = F.sequence(F.lit(1), F.length(folded) - SIZE + 1)
    runs = F.transform(starts, lambda at: F.substring(folded, at, F.lit(SIZE)))
    none = F.array().cast("array<string>")
    return F.when(F.length(folded) >= SIZE, F.array_distinct(runs)).otherwise(none)


def term_grams(term: str) -> list[str]:
    folded = term.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    pieces = re.split("[%_]", folded)
    return sorted({p[k : k + SIZE] for p in pieces for k in range(len(p) - SIZE + 1)})


def name_postings(products: DataFrame) -> DataFrame:
    """One row per trigram and product, without a shuffle."""
    both = F.array_union(grams(F.col("name")), grams(F.col("normalized_name")))
    return products.select(F.explode(both).alias("gram"), *CARRIED)


def by_gram(postings: DataFrame) -> DataFrame:
    """Postings in the order they are stored in: a filter on `gram` skips all other files and row groups.

    Ranges are of trigram and id, so that a trigram of very many names is spread over several files.
    """
    return postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def refresh_postings(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after products were added or have changed; `changed` holds their new rows."""
    kept = postings.join(changed.select("id"), "id", "left_anti").select(postings.columns)
    return kept.unionByName(name_postings(changed))


def gram_sizes(postings: DataFrame) -> DataFrame:
    """Postings per trigram, stored beside them."""
    return postings.groupBy("gram").agg(F.count("*").alias("n"))


def lookup(postings: DataFrame, sizes: DataFrame, term: str) -> DataFrame | None:
    """What the list of the term's rarest trigram carries; None without a trigram.

    At most one row of `sizes` per trigram of the term is read to choose.
    """
    wanted = term_grams(term)
    if not wanted:
        return None
    known = {r.gram: r.n for r in sizes.where(F.col("gram").isin(wanted)).collect()}
    rarest = min(wanted, key=lambda gram: (known.get(gram, 0), gram))
    return postings.where(F.col("gram") == rarest).select(*CARRIED)


def search(
    products: DataFrame,
    prices: DataFrame,
    postings: DataFrame,
    sizes: DataFrame,
    term: str,
    limit: int = 50,
    supermarket: str | None = None,
) -> DataFrame:
    """`catalog.search` by postings: at most `limit` ids reach the catalog's scan as a filter."""
    found = lookup(postings, sizes, term)
    if found is not None:
        hits = found.where(contains_term(F.col("name"), term))
        if supermarket is not None:
            hits = hits.where(F.col("supermarket") == supermarket)
        first = hits.orderBy("supermarket", "name", "id").limit(limit).collect()
        products = products.where(F.col("id").isin([r.id for r in first]))
    return catalog.search(products, prices, term, limit, supermarket)


def compare(
    products: DataFrame, prices: DataFrame, postings: DataFrame, sizes: DataFrame, term: str
) -> DataFrame:
    """`catalog.compare` by postings: hits are not limited, so their ids are joined, not collected."""
    found = lookup(postings, sizes, term)
    if found is not None:
        fits = contains_term(F.col("name"), term) | F.coalesce(
            contains_term(F.col("normalized_name"), term), F.lit(False)
        )
        products = products.join(found.where(fits).select("id"), "id", "left_semi")
    return catalog.compare(products, prices, term)
