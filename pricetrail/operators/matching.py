"""Find the same product across stores: equal names first, then names a few edits apart."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.functions import (
    missing,
    normalize_name,
    round_up_half,
    slugify,
    strip_trailing_unit,
    units_compatible,
)
from pricetrail.operators.catalog import in_category, latest_price, with_canonical_category
from pricetrail.plans.joins import join_large
from pricetrail.plans.lineage import cut_lineage
from pricetrail.schemas import STORE_NAMES, STORES

# Confidence of an exact match, of a fuzzy one by distance, and its floor.
EXACT_CONFIDENCE = 0.95
CONFIDENCE_PER_EDIT = 0.1
MIN_CONFIDENCE = 0.7
MAX_EDITS = 3
MAX_EDIT_SHARE = 0.2
UNKNOWN_CATEGORY = "_unknown"

# Piece groups with more name pairs than this, or more pairs a row than a further piece makes rows of it, are
# joined on a further piece as well, until pairs share this many pieces.
DENSE_PAIRS = 1_000_000
PAIRS_PER_ROW = 8
MAX_SHARED_PIECES = 4


# ---- candidates and exact matches -----------------------------------------------------------


def match_candidates(
    products: DataFrame,
    members: DataFrame | None = None,
    category: str | None = None,
    category_map: DataFrame | None = None,
    stores: Sequence[str] = STORES,
) -> DataFrame:
    """Products of the given stores that are in no group yet, with their matching key."""
    if members is not None:
        taken = members.select(F.col("product_id").alias("id"))
        products = products.join(taken, "id", "left_anti")
    if category is not None:
        products = in_category(products, category_map, category)
    return with_match_key(products.filter(F.col("supermarket").isin(*stores)), stores)


def with_match_key(products: DataFrame, stores: Sequence[str] = STORES) -> DataFrame:
    """Add `match_key` (name without brand prefix and pack size) and `store_rank`."""
    name = F.when(missing(F.col("normalized_name")), normalize_name(F.col("name"))).otherwise(
        F.col("normalized_name")
    )
    rank = F.array_position(F.array(*map(F.lit, stores)), F.col("supermarket"))
    return products.select(
        "id",
        "supermarket",
        "category",
        "unit_type",
        "normalized_name",
        strip_trailing_unit(name).alias("match_key"),
        rank.cast("int").alias("store_rank"),
    )


def first_per_key(candidates: DataFrame) -> DataFrame:
    """One product per store and key: the first by normalized name, then id."""
    first = F.min(F.struct("normalized_name", "id", "unit_type", "category"))
    return (
        candidates.groupBy("store_rank", "supermarket", "match_key")
        .agg(first.alias("first"))
        .select(
            "store_rank", "supermarket", "match_key",
            F.col("first.id").alias("product_id"),
            F.col("first.unit_type").alias("unit_type"),
            F.col("first.category").alias("category"),
            F.struct("first.normalized_name", "first.id").alias("place"),
        )
    )


def match_exact(candidates: DataFrame) -> DataFrame:
    """Members of groups with equal keys in two or more stores.

    The member of the first store sets the unit type the others must be compatible with. Windows
    are safe here: after first_per_key a key has at most one row per store.
    """
    by_store = Window.partitionBy("match_key").orderBy("store_rank")
    in_key = Window.partitionBy("match_key")
    return (
        first_per_key(candidates)
        .withColumn("_unit", F.first("unit_type").over(by_store))
        .withColumn("match_id", F.first("product_id").over(by_store))
        .filter(units_compatible(F.col("_unit"), F.col("unit_type")))
        .withColumn("_members", F.count("*").over(in_key))
        .filter(F.col("_members") >= 2)
        .select("match_id", "product_id", "match_key", "store_rank")
    )


# ---- fuzzy matches --------------------------------------------------------------------------


def fuzzy_pool(
    candidates: DataFrame, exact_members: DataFrame, category_map: DataFrame
) -> DataFrame:
    """What is left after exact matching: one product per store and key, with its block.

    `place` is the position of the key in its store, by the key's first product before any
    matching; the block is the canonical category, else the store's category.
    """
    taken = exact_members.select(F.col("product_id").alias("id"))
    places = first_per_key(candidates).select("store_rank", "match_key", "place")
    left = first_per_key(candidates.join(taken, "id", "left_anti")).drop("place")
    blocked = with_canonical_category(left, category_map, "block").withColumn(
        "block",
        F.when(missing(F.col("category")), UNKNOWN_CATEGORY).otherwise(F.col("block")),
    )
    return blocked.join(places, ["store_rank", "match_key"]).select(
        "block", "store_rank", "match_key", "product_id", "unit_type", "place"
    )


def allowed_edits(longest: Column) -> Column:
    """Most edits for which edits / length of the longer name stays below the allowed share."""
    return F.least(F.lit(MAX_EDITS), F.floor((longest - 1) / (1 / MAX_EDIT_SHARE))).cast("int")


def _piece_bounds(length: Column, edits: Column) -> Column:
    """Array of piece, start, size: a text of that length cut evenly into edits + 1 pieces."""
    pieces = edits + 1
    size = F.floor(length / pieces)
    short = pieces - length % pieces  # this many pieces have the smaller size

    def bounds(number: Column) -> Column:
        start = number * size + F.greatest(F.lit(0), number - short)
        return F.struct(
            number.alias("piece"),
            start.cast("int").alias("start"),
            (size + (number >= short).cast("int")).cast("int").alias("size"),
        )

    return F.transform(F.sequence(F.lit(0), edits), bounds)


def _rest(text: Column, start: Column, size: Column, is_last: Column) -> Column:
    """What follows a piece; at the end, what precedes it."""
    return F.when(is_last, F.substring(text, F.lit(1), start)).otherwise(
        F.substring(text, start + size + 1, F.length(text))
    )


def _cut(start: Column) -> list[Column]:
    """Take a piece out of `text`, and keep what a second piece is looked for in.

    With the piece unchanged and taken as the leftmost such piece, at most `edits - piece` edits
    fall after it; after the last piece there are none, so there the text before it is kept, with
    at most `edits` edits. How long the base name's rest is follows from the piece's bounds alone.
    """
    text, edits, piece, size = F.col("text"), F.col("edits"), F.col("p.piece"), F.col("p.size")
    last = piece == edits
    base_rest = F.when(last, F.col("p.start")).otherwise(
        F.col("base_length") - F.col("p.start") - size
    )
    return [
        F.col("product_id"),
        F.xxhash64("first", "base_length", "edits", piece, F.substring(text, start + 1, size))
        .alias("signature"),
        _rest(text, start, size, last).alias("text"),
        F.when(last, edits).otherwise(edits - piece).alias("edits"),
        base_rest.cast("int").alias("base_length"),
    ]


def _cut_base(rows: DataFrame) -> DataFrame:
    """Cut `text`, of `base_length`, into edits + 1 pieces of even size, one row per piece."""
    bounds = _piece_bounds(F.col("base_length"), F.col("edits"))
    return rows.withColumn("p", F.explode(bounds)).select(*_cut(F.col("p.start")))


def _cut_probe(rows: DataFrame) -> DataFrame:
    """Cut out every text that may equal a piece of a base text of `base_length`.

    If at most `edits` edits lead from base to probe, one piece is unchanged; for the leftmost
    such piece at most `piece` edits come before it and at most `edits - piece` after it, which
    bounds how far it can have moved from either end.
    """
    length, piece = F.length("text"), F.col("p.piece")
    start, longer = F.col("p.start"), length - F.col("base_length")
    after = F.col("edits") - piece
    low = F.greatest(F.lit(0), start - piece, start + longer - after)
    high = F.least(length - F.col("p.size"), start + piece, start + longer + after)
    bounds = _piece_bounds(F.col("base_length"), F.col("edits"))
    pieces = rows.filter(F.abs(longer) <= F.col("edits")).withColumn("p", F.explode(bounds))
    starts = pieces.withColumn(
        "_start", F.explode(F.when(low <= high, F.sequence(low, high)))
    )
    return starts.select(*_cut(F.col("_start")))


def _base_pieces(base: DataFrame) -> DataFrame:
    """Pieces of base names, for each number of edits their partners' lengths allow."""
    length = F.length("text")
    options = F.array_distinct(
        F.array(allowed_edits(length), allowed_edits(length + MAX_EDITS))
    )
    return _cut_base(
        _carriers(base).withColumn("base_length", length).withColumn("edits", F.explode(options))
    )


def _probe_pieces(others: DataFrame) -> DataFrame:
    """Texts of other names that may equal a piece, for each possible base length."""
    length = F.length("text")
    lengths = F.sequence(F.greatest(F.lit(1), length - MAX_EDITS), length + MAX_EDITS)
    longest = F.greatest(length, F.col("base_length"))
    return _cut_probe(
        _carriers(others)
        .withColumn("base_length", F.explode(lengths))
        .withColumn("edits", allowed_edits(longest))
    )


def _carriers(names: DataFrame) -> DataFrame:
    """What is cut: the name's text and its block as a number. A collision of signatures only adds
    a pair that the check of the names drops."""
    return names.filter(F.length("match_key") > 0).select(
        "product_id", F.xxhash64("block").alias("first"), F.col("match_key").alias("text")
    )


def _dense_signatures(base: DataFrame, probes: DataFrame, limit: int) -> DataFrame:
    sides = base.select("signature", F.lit(1).alias("b"), F.lit(0).alias("o")).unionByName(
        probes.select("signature", F.lit(0).alias("b"), F.lit(1).alias("o"))
    )
    pairs = F.col("b") * F.col("o")
    return (
        sides.groupBy("signature")
        .agg(F.sum("b").alias("b"), F.sum("o").alias("o"))
        .filter((pairs > limit) | (pairs > PAIRS_PER_ROW * (F.col("b") + F.col("o"))))
        .select("signature")
    )


def similar_pairs(base: DataFrame, others: DataFrame, dense_pairs: int = DENSE_PAIRS) -> DataFrame:
    """Pairs of names of one block within the allowed edit distance, each once.

    Both frames have `block`, `match_key`, `product_id`, `unit_type`, `place`, `store_rank`.
    A name is cut into one piece more than edits are allowed, so two similar names share a piece:
    an equi-join on pieces finds every pair, without comparing all names of a block. Where many
    names share a piece, they must share one more piece, by the same argument applied to the
    rest of the name, and so on. Only ids and numbers of pieces are joined; names come back for the
    check, once for each pair.
    """
    pairs = _pairs(_base_pieces(base), _probe_pieces(others), dense_pairs, MAX_SHARED_PIECES)
    return _verified(pairs.distinct(), base, others)


def _pairs(base: DataFrame, probes: DataFrame, dense_pairs: int, rounds: int) -> DataFrame:
    """Join on signatures; dense ones are refined first, for up to `rounds` rounds."""
    if rounds == 1:
        return _joined(base, probes)
    dense = cut_lineage(_dense_signatures(base, probes, dense_pairs))
    if dense.isEmpty():
        return _joined(base, probes)
    sparse = [side.join(dense, "signature", "left_anti") for side in (base, probes)]
    common = [
        # Equal rests of a name at other places need no second look. Their pieces are read to find the dense
        # ones, and on either side of those.
        cut_lineage(
            side.join(dense, "signature", "left_semi").withColumnRenamed("signature", "first").distinct()
        )
        for side in (base, probes)
    ]
    refined = _cut_base(common[0]), _cut_probe(common[1])
    return _joined(*sparse).unionByName(_pairs(*refined, dense_pairs, rounds - 1))


def _joined(base: DataFrame, probes: DataFrame) -> DataFrame:
    b = base.select("signature", F.col("product_id").alias("base_id"))
    o = probes.select("signature", F.col("product_id").alias("other_id"))
    # Pieces are many more than the stored names that Spark would judge a broadcast by.
    return join_large(b, o, "signature").select("base_id", "other_id")


def _verified(pairs: DataFrame, base: DataFrame, others: DataFrame) -> DataFrame:
    b = base.select(
        "block",
        F.col("match_key").alias("base_key"),
        F.col("product_id").alias("base_id"),
        F.col("unit_type").alias("base_unit"),
        F.col("place").alias("base_place"),
    )
    o = others.select(
        F.col("block").alias("other_block"),
        F.col("match_key").alias("other_key"),
        F.col("product_id").alias("other_id"),
        F.col("unit_type").alias("other_unit"),
        F.struct("store_rank", "place").alias("other_place"),
    )
    longest = F.greatest(F.length("base_key"), F.length("other_key"))
    distance = F.levenshtein("base_key", "other_key", MAX_EDITS)
    return (
        pairs.join(b, "base_id").join(o, "other_id")
        .filter(F.col("block") == F.col("other_block"))
        .filter(units_compatible(F.col("base_unit"), F.col("other_unit")))
        .withColumn("distance", distance)
        .filter(F.col("distance").between(0, allowed_edits(longest)))
        .drop("other_block", "base_unit", "other_unit")
    )


def match_fuzzy(pool: DataFrame, dense_pairs: int = DENSE_PAIRS) -> DataFrame:
    """Members of fuzzy groups: every name of another store joins its first similar base name.

    A base name takes all names still free, in base order; so each other name simply belongs to
    the first base name it is similar to, and all can be decided at once.
    """
    pairs = similar_pairs(
        pool.filter(F.col("store_rank") == 1), pool.filter(F.col("store_rank") > 1), dense_pairs
    )
    base = F.struct("base_place", "base_id", "base_key", "distance", "other_place")
    return (
        pairs.groupBy("other_id")
        .agg(F.min(base).alias("base"))
        .select(
            F.col("base.base_id").alias("match_id"),
            F.col("other_id").alias("product_id"),
            F.col("base.base_key").alias("match_key"),
            F.col("base.distance").alias("distance"),
            F.col("base.other_place").alias("other_place"),
        )
    )


# ---- groups ---------------------------------------------------------------------------------


def exact_groups(exact: DataFrame) -> tuple[DataFrame, DataFrame]:
    matches = exact.filter(F.col("match_id") == F.col("product_id")).select(
        F.col("match_id").alias("id"),
        F.col("match_key").alias("canonical_name"),
        F.lit("exact").alias("match_type"),
        F.lit(EXACT_CONFIDENCE).alias("confidence"),
        F.lit(1).alias("confirmed"),
    )
    return matches, exact.select("match_id", "product_id")


def fuzzy_groups(fuzzy: DataFrame) -> tuple[DataFrame, DataFrame]:
    edits = F.min(F.struct("other_place", "distance"))["distance"]
    matches = (
        fuzzy.groupBy(F.col("match_id").alias("id"), F.col("match_key").alias("canonical_name"))
        .agg(edits.alias("_edits"))
        .select(
            "id",
            "canonical_name",
            F.lit("fuzzy").alias("match_type"),
            F.greatest(
                F.lit(MIN_CONFIDENCE), 1.0 - F.col("_edits") * CONFIDENCE_PER_EDIT
            ).alias("confidence"),
            F.lit(0).alias("confirmed"),
        )
    )
    others = fuzzy.select("match_id", "product_id")
    return matches, others.unionByName(matches.select(F.col("id").alias("match_id"), F.col("id")
                                                      .alias("product_id")))


def build_match_groups(
    products: DataFrame,
    category_map: DataFrame,
    members: DataFrame | None = None,
    category: str | None = None,
    stores: Sequence[str] = STORES,
) -> tuple[DataFrame, DataFrame]:
    """New match groups and their members; nothing is written.

    A group is numbered by the id of its first product: unique, as a product is in one group at
    most, and the same in every repeated run.
    """
    # Both stages read these results several times; the texts of the products are parsed once.
    candidates = cut_lineage(match_candidates(products, members, category, category_map, stores))
    exact = cut_lineage(match_exact(candidates))
    pool = cut_lineage(fuzzy_pool(candidates, exact, category_map))
    fuzzy = cut_lineage(match_fuzzy(pool))
    exact_matches, exact_members = exact_groups(exact)
    fuzzy_matches, fuzzy_members = fuzzy_groups(fuzzy)
    return (
        exact_matches.unionByName(fuzzy_matches),
        exact_members.unionByName(fuzzy_members),
    )


# ---- review and published groups ------------------------------------------------------------


def members_with_price(groups: DataFrame, members: DataFrame, products: DataFrame,
                       prices: DataFrame) -> DataFrame:
    """One row per member of the given groups, with product and newest price."""
    info = products.select(
        F.col("id").alias("product_id"), "name", "supermarket", "category", "unit", "unit_type",
        "price_per_unit",
    )
    rows = groups.withColumnRenamed("id", "match_id").join(members, "match_id")
    newest = latest_price(
        prices.join(rows.select("product_id").distinct(), "product_id", "left_semi")
    ).select("product_id", F.col("price").alias("latest_price"), "original_price", "is_sale")
    return join_large(rows, info, "product_id").join(newest, "product_id", "left")


def unconfirmed_matches(
    matches: DataFrame,
    members: DataFrame,
    products: DataFrame,
    prices: DataFrame,
    limit: int = 50,
    category: str | None = None,
    category_map: DataFrame | None = None,
) -> DataFrame:
    """Members of the `limit` most confident unconfirmed groups, for review."""
    groups = matches.filter(F.col("confirmed") == 0)
    if category is not None:
        fitting = in_category(products, category_map, category).select(
            F.col("id").alias("product_id")
        )
        fitting = members.join(fitting, "product_id", "left_semi").select(
            F.col("match_id").alias("id")
        )
        groups = groups.join(fitting, "id", "left_semi")
    # The limit comes first, so only these groups' products and prices are read.
    top = groups.select("id", "canonical_name", "match_type", "confidence").orderBy(
        F.desc("confidence"), "id"
    )
    return members_with_price(F.broadcast(top.limit(limit)), members, products, prices).orderBy(
        F.desc("confidence"), "match_id", "supermarket", "product_id"
    )


def matched_groups(
    matches: DataFrame,
    members: DataFrame,
    products: DataFrame,
    prices: DataFrame,
    confirmed: bool = True,
    limit: int = 100,
) -> DataFrame:
    """Members of the first `limit` groups by name, cheapest first."""
    top = (
        matches.filter(F.col("confirmed") == int(confirmed))
        .select("id", "canonical_name", "match_type", "confidence", "confirmed")
        .orderBy("canonical_name", "id")
        .limit(limit)
    )
    return members_with_price(F.broadcast(top), members, products, prices).orderBy(
        "canonical_name", "match_id", "latest_price", "product_id"
    )


def apply_review(
    matches: DataFrame, members: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Confirm groups decided true; drop groups decided false, with their members."""
    decided = decisions.select("match_id", F.col("confirmed").alias("_decision"))
    rejected = decided.filter(~F.col("_decision")).select("match_id")
    accepted = decided.filter("_decision").select(F.col("match_id").alias("id"), "_decision")
    kept = (
        matches.join(rejected.withColumnRenamed("match_id", "id"), "id", "left_anti")
        .join(accepted.distinct(), "id", "left")
        .withColumn("confirmed", F.when(F.col("_decision"), 1).otherwise(F.col("confirmed")))
        .drop("_decision")
    )
    return kept, members.join(rejected, "match_id", "left_anti")


def _confirmed_members(matches: DataFrame, members: DataFrame, products: DataFrame,
                       prices: DataFrame) -> DataFrame:
    groups = matches.filter(F.col("confirmed") == 1).select("id", "canonical_name", "confidence")
    return members_with_price(groups, members, products, prices)


def _plausible(rows: DataFrame, max_ratio: float) -> DataFrame:
    """Groups with two priced members or more, the dearest at most `max_ratio` x the cheapest."""
    best = F.struct("latest_price", "product_id", "supermarket", "price_per_unit", "unit_type")
    priced = rows.filter(F.col("latest_price") > 0)
    spread = priced.groupBy("match_id").agg(
        F.count("*").alias("_priced"),
        F.min(best).alias("best"),
        F.max("latest_price").alias("_dearest"),
    )
    return spread.filter(
        (F.col("_priced") >= 2) & (F.col("_dearest") / F.col("best.latest_price") <= max_ratio)
    )


def plausible_groups(
    matches: DataFrame,
    members: DataFrame,
    products: DataFrame,
    prices: DataFrame,
    max_ratio: float = 2.0,
) -> DataFrame:
    """All members of confirmed groups whose prices are close enough to be the same product."""
    # Read for the spread and for the members.
    rows = cut_lineage(_confirmed_members(matches, members, products, prices))
    return rows.join(_plausible(rows, max_ratio).select("match_id"), "match_id", "left_semi")


def comparison_table(
    matches: DataFrame,
    members: DataFrame,
    products: DataFrame,
    prices: DataFrame,
    max_ratio: float = 2.0,
) -> DataFrame:
    """Priced members of plausible groups: cheapest mark, cheapest store, surplus in percent.

    The surplus is by unit price when both have one of the same type, else by price.
    """
    # Read for the spread and for the members.
    rows = cut_lineage(_confirmed_members(matches, members, products, prices))
    best = F.col("best")
    per_unit = (
        (F.col("price_per_unit") != 0)
        & (best["price_per_unit"] != 0)
        & (F.col("unit_type") == best["unit_type"])
    )

    def surplus(name: str) -> Column:
        return round_up_half((F.col(name) - best[name]) / best[name] * 100)

    is_best = F.col("product_id") == best["product_id"]
    store = F.col("supermarket")
    seller = F.lit(None).cast("string")
    for code, label in STORE_NAMES.items():
        seller = F.when(store == code, label).otherwise(seller)
    return (
        rows.filter(F.col("latest_price") > 0)
        .join(_plausible(rows, max_ratio).drop("_priced", "_dearest"), "match_id")
        .select(
            "match_id",
            "canonical_name",
            slugify(F.col("canonical_name")).alias("slug"),
            "product_id",
            "name",
            "supermarket",
            F.coalesce(seller, store).alias("seller"),
            "category",
            "unit",
            "unit_type",
            "price_per_unit",
            F.col("latest_price").alias("price"),
            F.lit("EUR").alias("currency"),
            "is_sale",
            is_best.alias("is_cheapest"),
            best["supermarket"].alias("cheapest_store"),
            F.when(
                ~is_best,
                F.when(per_unit, surplus("price_per_unit")).otherwise(surplus("latest_price")),
            ).alias("diff_pct"),
        )
    )
