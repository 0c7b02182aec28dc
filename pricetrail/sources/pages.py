"""Captured store pages -> product cards -> observations, all in Spark SQL expressions.

Pages hold serialized DOM (double-quoted attributes), as a browser's outerHTML gives it. A page is read as
tokens first: comments, scripts and styles go, and angle brackets inside attribute values are written by
name; from then on every bracket left is that of a tag. Cards and elements reach to their own end tag,
whatever elements of their kind are inside.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.text import SPACES, once, trim_spaces
from pricetrail.schemas import STORE_SITES

# The attribute that marks a product card, by store layout. None: any article.
CARD_MARKS = {
    "ah": r'data-testid="product-card"',
    "jumbo": r'class="(?:[^"]*\s)?product-container(?:\s[^"]*)?"',
    "dirk": r"data-product-id=",
    None: None,
}

# Texts on a badge that stand for a sale.
SALE_BADGES = ("bonus", "korting", "actie", "% lager", "2e halve prijs", "1+1")

# The only characters a browser writes by name when it serializes a page.
ENTITIES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&amp;": "&"}

# Units of packs and of single sizes in a product title.
TITLE_PACK_UNITS = ("kg", "g", "gr", "ml", "cl", "l")
TITLE_UNITS = (*TITLE_PACK_UNITS, "liter", "stuks", "stuk", "st")

_SIZE = r"(\d+(?:[.,]\d+)?)\s*({units})(?!\w)"
_TITLE_SIZE = "(?i)" + _SIZE.format(units="|".join(TITLE_UNITS))
_TITLE_PACKS = r"(?i)(\d+)\s*x\s*" + _SIZE.format(units="|".join(TITLE_PACK_UNITS))
_TITLE_PIECE = r"(?i)(?<!\w)per\s+stuk(?!\w)"

_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))"


# ---- tokens ---------------------------------------------------------------------------------

# A comment, a script or style with its text, a tag with its quoted values, text, or a bracket alone.
_TOKEN = (
    r"(?s)<!--.*?(?:-->|\z)|<(script|style)[\s>].*?(?:</\1\s*>|\z)"
    r"""|</?[A-Za-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
)
_UNSEEN = r"^<(?:!--|script[\s>]|style[\s>])"
# Pages without any of these are their own tokens.
_NEEDS_TOKENS = r"""<(?:!--|script[\s>]|style[\s>])|=(?:"[^"<>]*[<>]|'[^'<>]*[<>])|<(?![A-Za-z/!])"""


def plain_tags(html: Column) -> Column:
    """The page with brackets at the ends of tags only, without comments, scripts and styles."""

    def token(t: Column) -> Column:
        inner = F.substring(t, 2, F.length(t) - 2)
        named = F.replace(F.replace(inner, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        odd = F.contains(inner, F.lit(">")) | F.contains(inner, F.lit("<"))
        return (
            F.when(~F.startswith(t, F.lit("<")), t)
            .when(t == "<", "&lt;")
            .when(t.rlike(_UNSEEN), "")
            .when(odd, F.concat(F.lit("<"), named, F.lit(">")))
            .otherwise(t)
        )

    tokens = F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), 0), token)
    return F.when(html.rlike(_NEEDS_TOKENS), F.array_join(tokens, "")).otherwise(html)


# ---- elements -------------------------------------------------------------------------------


def _has(attribute: str, value: str) -> str:
    return rf'\s{attribute}="{re.escape(value)}"'


def _has_class(name: str) -> str:
    return rf'\sclass="(?:[^"]*\s)?{re.escape(name)}(?:\s[^"]*)?"'


def _contains(attribute: str, value: str) -> str:
    return rf'\s{attribute}="[^"]*{re.escape(value)}[^"]*"'


def _inner(html: Column, condition: str, tag: str = r"\w+") -> Column:
    """Inner HTML of the first element that fits, with all its descendants; empty if none fits."""
    found = F.regexp_extract(html, rf"(?s)<{tag}\b[^>]*?{condition}[^>]*>.*\z", 0)

    def opened(text: Column) -> Column:
        # The start tag without its bracket: short, so that only it is read for its name.
        tag_text = F.call_function("substring_index", text, F.lit(">"), F.lit(1))
        return F.struct(tag_text.alias("tag"), text.alias("text"))

    def parts(e: Column) -> Column:
        return F.struct(
            F.regexp_extract(e["tag"], r"^<(\w+)", 1).alias("name"),
            F.substring(e["text"], F.length(e["tag"]) + 2, F.lit(1 << 30)).alias("rest"),
        )

    def whole(e: Column) -> Column:
        end = F.concat(F.lit("</"), e["name"], F.lit(">"))
        # Up to the first end tag, which is its own unless an element of its name is inside.
        flat = F.call_function("substring_index", e["rest"], end, F.lit(1))
        inner = once(flat, lambda text: own(e, text))
        return F.when(F.contains(e["rest"], end), inner).otherwise("")

    def own(e: Column, flat: Column) -> Column:
        nested = F.contains(flat, F.concat(F.lit("<"), e["name"]))
        return F.when(nested, _balanced(e["rest"], e["name"])).otherwise(flat)

    return once(once(once(found, opened), parts), whole)


def _balanced(rest: Column, name: Column) -> Column:
    """What stands before the end tag of the element `name` that `rest` is in."""
    # A mark in front, so that the first piece is never a tag; every other one opens with a start or
    # an end tag of that name.
    tags = F.concat(F.lit("(?=</?"), name, F.lit(r"[\s/>])"))
    pieces = F.split(F.concat(F.lit("|"), rest), tags)
    return F.substring(_up_to_own_end(pieces), 2, 1 << 30)


def _up_to_own_end(pieces: Column) -> Column:
    """Pieces that each open with a start or end tag of one name, joined while inside the element."""

    def step(state: Column, piece: Column) -> Column:
        change = F.when(F.startswith(piece, F.lit("</")), -1).when(
            F.startswith(piece, F.lit("<")), 1
        )
        depth = state["depth"] + F.coalesce(change, F.lit(0))
        # Once out of the element, the depth stays at zero.
        inside = (state["depth"] > 0) & (depth > 0)
        return F.struct(
            F.when(inside, depth).otherwise(0).alias("depth"),
            F.when(inside, F.concat(state["text"], piece)).otherwise(state["text"]).alias("text"),
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("text"))
    return F.aggregate(pieces, start, step, lambda end: end["text"])


def _without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def _decoded(text: Column) -> Column:
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return trim_spaces(text)


def _text(html: Column, condition: str, tag: str = r"\w+") -> Column:
    """Text of the first element that fits, empty if there is none."""
    return _decoded(_without_tags(_inner(html, condition, tag)))


def _digits(html: Column, condition: str, tag: str = "span") -> Column:
    """Text of an element that holds a number."""
    return F.trim(_without_tags(_inner(html, condition, tag)))


def _start_tag(html: Column, condition: str, tag: str) -> Column:
    """Start tag of the first element that fits, empty if there is none."""
    return F.regexp_extract(html, rf"<{tag}\b[^>]*?{condition}[^>]*>", 0)


def _attribute(start_tag: Column, name: str) -> Column:
    return _decoded(F.regexp_extract(start_tag, rf'\s{name}="([^"]*)"', 1))


def _leading_number(text: Column) -> Column:
    return _nonempty(F.regexp_extract(text, _LEADING_NUMBER, 1)).cast("double")


def _amount(whole: Column, fraction: Column) -> Column:
    """Price from its whole and fractional text; NULL unless both are there."""

    def price(it: Column) -> Column:
        number = _leading_number(F.concat(it["whole"], F.lit("."), it["fraction"]))
        return F.when((it["whole"] != "") & (it["fraction"] != ""), number)

    return once(F.struct(whole.alias("whole"), fraction.alias("fraction")), price)


def _nonempty(text: Column) -> Column:
    """NULL for the empty text; computed once, where nullif within a lambda computes it twice."""
    return once(text, lambda it: F.when(it != "", it))


# ---- shared rules ---------------------------------------------------------------------------


def _cards(html: Column, marked: Callable[[Column], Column]) -> Column:
    """Inner HTML of all articles that are `marked` by their start tag, in page order."""

    def inner(pieces: Column, i: Column) -> Column:
        piece, after = F.get(pieces, i), F.get(pieces, i + 1)
        own = F.substring(piece, F.locate(">", piece) + 1, F.length(piece))
        rest = F.slice(pieces, i + 2, F.size(pieces))
        # Nearly always the next article tag is the card's own end.
        return F.when(F.coalesce(F.startswith(after, F.lit("</")), F.lit(True)), own).otherwise(
            F.concat(own, _up_to_own_end(rest))
        )

    def cards(pieces: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(pieces) - 1)
        starts = F.filter(every, lambda i: marked(F.get(pieces, i)))
        return F.transform(starts, lambda i: inner(pieces, i))

    # A mark in front, so that the first piece is never a tag.
    page = F.concat(F.lit("|"), plain_tags(html))
    return once(F.split(page, r"(?=</?article[\s/>])"), cards)


def _marked(layout: str | None) -> Callable[[Column], Column]:
    mark = CARD_MARKS[layout]
    return lambda piece: piece.rlike("^<article" + ("" if mark is None else rf"\s(?:[^>]*?\s)?{mark}"))


def explode_cards(pages: DataFrame, layout: str | None) -> DataFrame:
    """One row per product card of a page: `card_pos` and inner `card` HTML.

    A card inside a card counts by itself too.
    """
    return pages.select(
        *(c for c in pages.columns if c != "html"),
        F.posexplode(_cards(F.col("html"), _marked(layout))).alias("card_pos", "card"),
    )


def absolute_url(href: Column, store: str) -> Column:
    return once(
        href, lambda it: F.when(F.length(it) > 0, F.concat(F.lit(STORE_SITES[store]), it))
    )


def infer_brand(name: Column, store: str, logo_text: Column | None = None) -> Column:
    """House brand by name prefix, or by the text of the brand logo."""
    if store == "ah":
        return F.when(name.startswith("AH "), "AH")
    if store == "jumbo":
        return F.when(name.startswith("Jumbo "), "Jumbo")
    return F.when(F.contains(F.lower(logo_text), F.lit("1 de beste")), "1 de Beste")


def unit_from_title(name: Column) -> Column:
    """Size text found in a product title: a multipack, else a size, else "per stuk"."""

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(name, pattern, group)

    packs = F.concat(
        part(_TITLE_PACKS, 1), F.lit(" x "), part(_TITLE_PACKS, 2), F.lit(" "),
        part(_TITLE_PACKS, 3),
    )
    size = F.concat_ws(" ", part(_TITLE_SIZE, 1), part(_TITLE_SIZE, 2))
    return (
        F.when(name.rlike(_TITLE_PACKS), packs)
        .when(name.rlike(_TITLE_SIZE), size)
        .when(name.rlike(_TITLE_PIECE), "per stuk")
    )


def infer_sale(offers: DataFrame, store: str | None = None) -> DataFrame:
    """Set `original_price` and `is_sale` from `old_price` and, where a store has one, `badge`.

    An old price counts only when it is above the price.
    """
    original = F.when(F.col("old_price") > F.col("price"), F.col("old_price"))
    sale = original.isNotNull()
    if store in ("ah", None):
        badge = F.lower("badge")
        for text in SALE_BADGES:
            sale = sale | F.coalesce(F.contains(badge, F.lit(text)), F.lit(False))
    return (
        offers.withColumn("original_price", original)
        .withColumn("is_sale", sale.cast("int"))
        .drop("old_price", "badge")
    )


def _complete(offers: DataFrame, keep: bool = True) -> DataFrame:
    """Cards without a name or a price are no offers; with `keep` false, those cards."""
    complete = F.coalesce((F.col("name") != "") & (F.col("price") != 0), F.lit(False))
    return offers.filter(complete if keep else ~complete)


# ---- layouts --------------------------------------------------------------------------------


def _offer(
    name: Column,
    href: Column,
    store: str,
    price: Column,
    old_price: Column,
    unit: Column,
    badge: Column | None = None,
    logo: Column | None = None,
) -> Column:
    """What a layout gives of a card; the same fields for all."""
    none = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"), absolute_url(href, store).alias("link"), price.alias("price"),
        old_price.alias("old_price"), unit.alias("unit"),
        (none if badge is None else badge).alias("badge"),
        (none if logo is None else logo).alias("logo"),
    )


def _offer_ah(card: Column) -> Column:
    def offer(part: Column) -> Column:
        old = F.regexp_replace(part["old"], r"[^\d.,]", "")
        return _offer(
            F.regexp_replace(_attribute(part["link"], "title"), f"^Bekijk[{SPACES}]+", ""),
            _attribute(part["link"], "href"), "ah",
            _amount(
                _digits(part["price"], _contains("class", "integer")),
                _digits(part["price"], _contains("class", "fractional")),
            ),
            _leading_number(F.regexp_replace(old, r"^([^,]*),", "$1.")),
            _nonempty(_text(card, _has("data-testid", "product-unit-size"))),
            badge=_text(card, _has("data-testid", "product-shield")),
        )

    parts = F.struct(
        _start_tag(card, _contains("href", "/producten/product/"), "a").alias("link"),
        _inner(card, _has("data-testid", "price-amount")).alias("price"),
        _digits(card, _has("data-testid", "price-was"), r"\w+").alias("old"),
    )
    return once(parts, offer)


def _offer_jumbo(card: Column) -> Column:
    title = _has_class("title-link")
    units = [
        _text(card, condition)
        for condition in (
            _has("data-testid", "jum-card-subtitle"),
            _has_class("jum-card-subtitle"),
            _has_class("subtitle"),
            _contains("class", "subtitle"),
        )
    ]

    def amount(box: Column) -> Column:
        return _amount(_digits(box, _has_class("whole")), _digits(box, _has_class("fractional")))

    def offer(part: Column) -> Column:
        return _offer(
            _text(card, title, "a"), _attribute(_start_tag(card, title, "a"), "href"), "jumbo",
            amount(part["price"]), amount(part["old"]), F.coalesce(*map(_nonempty, units)),
        )

    parts = F.struct(
        _inner(card, _has_class("current-price")).alias("price"),
        _inner(card, _has_class("old-price")).alias("old"),
    )
    return once(parts, offer)


def _offer_dirk(card: Column) -> Column:
    def boxes(part: Column) -> Column:
        return F.struct(
            part["link"].alias("link"), part["old"].alias("old"), part["logos"].alias("logos"),
            _start_tag(part["price"], _has_class("price-large"), "span").alias("large_tag"),
            _digits(part["price"], _has_class("price-large")).alias("large"),
            _digits(part["price"], _has_class("price-small")).alias("small"),
        )

    def offer(box: Column) -> Column:
        cents = _nonempty(F.regexp_extract(box["large"], r"^([+-]?\d+)", 1)).cast("double") / 100.0
        old_euros = F.coalesce(
            _nonempty(_digits(box["old"], _has_class("price-large"))),
            _digits(box["old"], _has_class("hasEuros")),
        )
        return _offer(
            _text(card, _has_class("title"), "p"), _attribute(box["link"], "href"), "dirk",
            # Below one euro a store shows cents only, and marks larger prices as having euros.
            F.when(box["large_tag"].rlike(_has_class("hasEuros")), _amount(box["large"], box["small"]))
            .otherwise(cents),
            _amount(old_euros, _digits(box["old"], _has_class("price-small"))),
            _nonempty(_text(card, _has_class("subtitle"), "span")),
            logo=_attribute(_start_tag(box["logos"], r'\salt="[^"]*"', "img"), "alt"),
        )

    parts = F.struct(
        F.coalesce(
            _nonempty(_start_tag(card, _has_class("bottom"), "a")),
            _start_tag(card, _has_class("top"), "a"),
        ).alias("link"),
        F.coalesce(
            _nonempty(_inner(card, _has_class("old-price"))), _inner(card, _has_class("from-price"))
        ).alias("old"),
        _inner(_inner(card, _has_class("price-container")), _has_class("price")).alias("price"),
        _inner(card, _has_class("logos")).alias("logos"),
    )
    return once(once(parts, boxes), offer)


_OFFER = {"ah": _offer_ah, "jumbo": _offer_jumbo, "dirk": _offer_dirk}


def _by_store(store: Column, of: Callable[[str], Column]) -> Column:
    """What `of` gives for the store of the row; only that branch is computed."""
    first, *others = _OFFER
    out = F.when(store == first, of(first))
    for name in others:
        out = out.when(store == name, of(name))
    return out


def _finished(offers: DataFrame, store: Column, complete: bool) -> DataFrame:
    """Brand, unit and sale of extracted offers."""
    unit = F.when(store == "jumbo", unit_from_title(F.col("name")))
    brand = _by_store(store, lambda name: infer_brand(F.col("name"), name, F.col("logo")))
    offers = offers.withColumns({"unit": F.coalesce("unit", unit), "brand": brand}).drop("logo")
    return infer_sale(_complete(offers, complete))


def _extract(cards: DataFrame, store: str, complete: bool) -> DataFrame:
    # A generator, so that no filter above it computes the offer once more.
    offers = cards.select(
        *_page_columns(cards), F.explode(F.array(_OFFER[store](F.col("card")))).alias("_offer")
    ).select(*_page_columns(cards), "_offer.*")
    return _finished(offers, F.lit(store), complete)


def extract_offers_ah(cards: DataFrame, complete: bool = True) -> DataFrame:
    return _extract(cards, "ah", complete)


def extract_offers_jumbo(cards: DataFrame, complete: bool = True) -> DataFrame:
    return _extract(cards, "jumbo", complete)


def extract_offers_dirk(cards: DataFrame, complete: bool = True) -> DataFrame:
    return _extract(cards, "dirk", complete)


def _page_columns(cards: DataFrame) -> list[str]:
    return [c for c in cards.columns if c != "card"]


EXTRACTORS = {
    "ah": extract_offers_ah,
    "jumbo": extract_offers_jumbo,
    "dirk": extract_offers_dirk,
}

# This spaces the arrival numbers of two pages; cards beyond it are rejects.
CARDS_PER_PAGE = 100_000


def attach_category(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Set the store category of a listing page from its path; a known category is kept."""
    path = F.regexp_replace(F.col("url"), r"^https?://[^/]+|[?#].*\z", "")
    lookup = paths.select("supermarket", F.col("path").alias("_path"), F.col("category").alias("_c"))
    if "category" not in pages.columns:
        pages = pages.withColumn("category", F.lit(None).cast("string"))
    # The list of listing paths is a fixed value of about a hundred rows.
    return (
        pages.withColumn("_path", path)
        .join(F.broadcast(lookup), ["supermarket", "_path"], "left")
        .withColumn("category", F.coalesce("category", "_c"))
        .drop("_path", "_c")
    )


def _all_offers(pages: DataFrame, complete: bool) -> DataFrame:
    """Offers of all known stores' pages, each by its layout, in one scan of the pages."""
    store = F.col("supermarket")

    def marked(piece: Column) -> Column:
        return _by_store(store, lambda name: _marked(name)(piece))

    def offer(card: Column) -> Column:
        return _by_store(store, lambda name: _OFFER[name](card))

    columns = [c for c in pages.columns if c != "html"]
    offers = F.transform(_cards(F.col("html"), marked), offer)
    found = pages.filter(store.isin(*_OFFER)).select(
        *columns, F.posexplode(offers).alias("card_pos", "_offer")
    )
    return _finished(found.select(*columns, "card_pos", "_offer.*"), store, complete)


def extract_observations(pages: DataFrame) -> DataFrame:
    """Observations of all stores' pages, numbered by page and place on the page."""
    return (
        _all_offers(pages, complete=True)
        .filter(F.col("card_pos") < CARDS_PER_PAGE)
        .select(
            (F.col("page_seq") * CARDS_PER_PAGE + F.col("card_pos")).alias("seq"),
            F.col("captured_at").alias("scraped_at"),
            "supermarket", "category", "name", "brand", "unit", F.col("link").alias("url"),
            "price", "original_price", "is_sale",
        )
    )


def rejected_cards(pages: DataFrame) -> DataFrame:
    """What extract_observations leaves out: pages of unknown stores, cards without name or price.

    `card_pos` and `name` are NULL for a page. Cards beyond the numbers of a page are rejects too.
    """
    unknown = pages.filter(
        F.col("supermarket").isNull() | ~F.col("supermarket").isin(*EXTRACTORS)
    ).select(
        "page_seq", "supermarket", F.lit(None).cast("int").alias("card_pos"),
        F.lit(None).cast("string").alias("name"), F.lit("unknown_store").alias("reason"),
    )
    reason = F.when(F.col("name") == "", "name_missing").otherwise("price_missing")
    cards = _all_offers(pages, complete=False).select(
        "page_seq", "supermarket", "card_pos", "name", reason.alias("reason")
    )
    beyond = _all_offers(pages, complete=True).filter(F.col("card_pos") >= CARDS_PER_PAGE)
    late = beyond.select(
        "page_seq", "supermarket", "card_pos", "name", F.lit("beyond_numbers").alias("reason")
    )
    return unknown.unionByName(cards).unionByName(late)
