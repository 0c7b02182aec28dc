"""The SQL each query is checked against, written for DuckDB and independent of the Spark code.

Spark uses aggregates, slices and piece joins where this SQL uses plain windows, correlated ranks
and comparisons of all names in a block; it is meant to be obvious, not fast.
"""

from pricetrail.sources.reference_data import CANONICAL_CATEGORIES

ORACLE: dict[str, str] = {}

# The seed list as it stands; the query joins it through the library.
_SEED = ", ".join(
    f"('{canonical}', '{store}', '{original}')"
    for canonical, stores in CANONICAL_CATEGORIES.items()
    for store, originals in stores.items()
    for original in originals
)

# Named building blocks, in order of use; a statement takes those it mentions.
BLOCKS: dict[str, str] = {}
# Blocks that compare all names or go row by row, or follow from that: evaluated once per statement.
ONCE = (
    "v_named", "v_keys", "v_key_firsts", "v_canonical", "v_latest", "v_pool", "v_pairs", "v_fuzzy",
    "v_exact", "v_matches", "v_members", "v_observations",
    *(f"{name}{part}" for name in ("v_resolved", "v_fresh")
      for part in ("_met", "_reach", "_rows", "_start", "_steps", "")),
)


def block(name: str, text: str) -> None:
    BLOCKS[name] = text


def check(name: str, body: str) -> None:
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for other in BLOCKS:
            if other not in needed and _mentions(text, other):
                needed.add(other)
                todo.append(BLOCKS[other])
    parts = [
        f"{other} AS {'MATERIALIZED ' if other in ONCE else ''}({BLOCKS[other]})"
        for other in BLOCKS
        if other in needed
    ]
    ORACLE[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _mentions(text: str, name: str) -> bool:
    words = "".join(c if c.isalnum() or c == "_" else " " for c in text).split()
    return name in words


def rounded(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale} + 0.0)"


def mean(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,10))) AS DOUBLE) / count({x})"


# ---- inputs ---------------------------------------------------------------------------------

block("stores3", "SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2")
block("v_products", """
SELECT p_partkey * 3 + s AS id,
  CASE s WHEN 0 THEN 'AH ' WHEN 1 THEN 'Jumbo ' ELSE '' END
    || CASE WHEN s = 1 AND p_partkey % 3 = 0 THEN replace(p_name, 'i', 'y')
            WHEN s = 2 AND p_partkey % 5 = 0 THEN p_name || 's' ELSE p_name END || ' ' || p_brand
    || CASE WHEN p_size % 4 = 0 THEN ' 500g' ELSE '' END AS name,
  CASE s WHEN 0 THEN 'AH' WHEN 1 THEN 'Jumbo' END AS brand,
  lower(p_type) || CASE s WHEN 0 THEN ' a' WHEN 1 THEN ' b' ELSE ' c' END AS category,
  CASE p_size % 10
    WHEN 0 THEN CAST(p_size AS STRING) || '0 g' WHEN 1 THEN 'per stuk'
    WHEN 2 THEN '6 x ' || CAST(p_size AS STRING) || '0 ml' WHEN 3 THEN '1,5 L'
    WHEN 4 THEN '2+ dagen houdbaar • ' || CAST(p_size AS STRING) || '0 g'
    WHEN 5 THEN CAST(p_size AS STRING) || ' wasbeurten' WHEN 6 THEN '75 cl'
    WHEN 7 THEN CAST(p_size AS STRING) || ' stuks' WHEN 8 THEN NULL
    ELSE '1 kg (ca. 10 stuks)' END AS unit,
  CASE s WHEN 0 THEN 'ah' WHEN 1 THEN 'jumbo' ELSE 'dirk' END AS supermarket,
  'https://store.example/' || CAST(p_partkey * 3 + s AS STRING) AS url,
  p_partkey, p_size, s
FROM part CROSS JOIN stores3""")
block("v_raw_prices", """
SELECT l_partkey * 3 + l_suppkey % 3 AS product_id, floor(l_extendedprice / 2) / 100 AS price,
  CASE WHEN l_discount < 0.005 THEN NULL
       WHEN l_discount > 0.045 AND l_discount < 0.055 THEN floor(l_extendedprice / 2) / 100
       ELSE floor(l_extendedprice * 0.6) / 100 END AS original_price,
  CASE WHEN l_discount > 0.025 THEN 1 ELSE 0 END AS is_sale, l_shipdate AS scraped_at,
  ((date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 68719476736 + l_orderkey) * 8
    + l_linenumber) * 4096 + (l_partkey * 31 + l_suppkey) % 4096 AS id
FROM lineitem""")
block("v_first_prices", """
SELECT id, product_id, price,
  CASE WHEN original_price IS NULL OR original_price = 0 THEN price ELSE original_price END
    AS original_price, is_sale, scraped_at
FROM (SELECT *, row_number() OVER (PARTITION BY product_id, CAST(scraped_at AS DATE) ORDER BY id)
        AS rn FROM v_raw_prices WHERE price > 0 AND price <= 500)
WHERE rn = 1""")
block("v_prices", """
SELECT id, product_id, price, original_price,
  CASE WHEN original_price = price THEN 0 ELSE is_sale END AS is_sale, scraped_at
FROM v_first_prices""")
block("v_category_map", """
SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'budget' WHEN p_type = 'LARGE' THEN 'bulk'
            ELSE 'regular' END AS canonical_category,
  supermarket, lower(p_type) || suffix AS original_category
FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> 'PROMO')
CROSS JOIN (SELECT 'ah' AS supermarket, ' a' AS suffix UNION ALL SELECT 'jumbo', ' b'
            UNION ALL SELECT 'dirk', ' c')""")
block("v_observations", """
SELECT r.id AS seq, r.scraped_at, p.supermarket, p.category, p.name, p.brand,
  CASE WHEN r.product_id % 9 = 4 AND r.id % 4 = 0 THEN NULL
       WHEN r.scraped_at >= TIMESTAMP '1999-01-01 00:00:00' AND p.unit LIKE '%0 g'
       THEN replace(p.unit, '0 g', '5 g') ELSE p.unit END AS unit,
  CASE WHEN r.product_id % 11 = 0 OR (r.product_id % 5 = 1 AND r.id % 3 = 0) THEN NULL
       WHEN r.product_id % 40 = 2 AND r.id % 2 = 0
       THEN 'https://store.example/' || CAST(r.product_id + 3 AS VARCHAR)
       WHEN r.product_id % 7 = 3 AND r.scraped_at >= TIMESTAMP '1998-01-01 00:00:00'
       THEN p.url || '?v=2' ELSE p.url END AS url,
  r.price, r.original_price, r.is_sale, r.product_id AS known_id
FROM v_raw_prices r JOIN v_products p ON p.id = r.product_id""")
block("v_event_prices", """
SELECT event_id AS id, user_id AS product_id, value AS price, ts AS scraped_at
FROM events""")

# ---- derived basics -------------------------------------------------------------------------


# Spellings of units with what they stand for.
block("unit_words", """
SELECT * FROM (VALUES ('g', 'g', 'g', 1.0), ('gr', 'g', 'g', 1.0), ('gram', 'g', 'g', 1.0),
  ('kg', 'kg', 'g', 1000.0), ('kilo', 'kg', 'g', 1000.0), ('ml', 'ml', 'ml', 1.0),
  ('cl', 'cl', 'ml', 10.0), ('l', 'l', 'ml', 1000.0), ('liter', 'l', 'ml', 1000.0),
  ('lt', 'l', 'ml', 1000.0), ('stuk', 'stuk', 'stuk', 1.0), ('stuks', 'stuk', 'stuk', 1.0),
  ('st', 'stuk', 'stuk', 1.0)) AS t(spelling, unit, base, factor)""")
# The size stands after the last bullet and before a bracket; its words are count, x, number, unit.
block("v_unit_parts", """
SELECT id, unit, words,
  CASE WHEN words[2] = 'x' THEN CAST(words[1] AS DOUBLE) ELSE 1 END AS packs,
  TRY_CAST(replace(CASE WHEN words[2] = 'x' THEN words[3] ELSE words[1] END, ',', '.') AS DOUBLE)
    AS number,
  CASE WHEN words[2] = 'x' THEN words[4] ELSE words[2] END AS word
FROM (SELECT id, unit, string_split(trim(split_part(string_split(lower(unit), '•')[-1], '(', 1)), ' ')
        AS words FROM v_products)""")
block("v_sizes", """
SELECT p.id, p.unit, CASE WHEN p.words[1] = 'per' THEN 1 ELSE p.packs * p.number * w.factor END AS qty,
  CASE WHEN p.words[1] = 'per' THEN 'stuk' WHEN p.number > 0 THEN w.base END AS type
FROM v_unit_parts p LEFT JOIN unit_words w ON w.spelling = p.word""")
block("v_latest", """
SELECT product_id, price, original_price, is_sale, scraped_at
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, id DESC) AS rn
      FROM v_prices) WHERE rn = 1""")
block("v_named", r"""
SELECT p.id, p.supermarket, p.category, lower(trim(regexp_replace(p.name,
  '^(AH Biologisch |AH Biologische |AH Terra Plant Based |AH Excellent |AH Basic |AH |Jumbo Biologische |Jumbo Biologisch |Jumbo |1 de Beste )',
  ''))) AS normalized_name FROM v_products p""")
block("v_norm", """
SELECT p.id, p.name, p.brand, p.category, p.unit, p.supermarket, p.url, n.normalized_name,
  CASE WHEN z.type IS NOT NULL THEN z.qty END AS unit_quantity, z.type AS unit_type,
  CASE WHEN l.price <> 0 AND z.qty > 0 THEN
    CASE WHEN z.type IN ('g', 'ml') THEN (l.price / z.qty) * 1000 ELSE l.price / z.qty END
  END AS price_per_unit,
  l.price AS latest_price, l.original_price, l.is_sale, l.scraped_at
FROM v_products p JOIN v_named n ON n.id = p.id JOIN v_sizes z ON z.id = p.id
LEFT JOIN v_latest l ON l.product_id = p.id""")
block("v_keys", r"""
SELECT n.id, n.supermarket, n.category, n.normalized_name, z.type AS unit_type,
  trim(regexp_replace(n.normalized_name,
    '\s+\d+[\d.,]*\s*(g|gr|gram|kg|ml|cl|l|liter|stuks?)\s*$', '', 'i')) AS match_key,
  CASE n.supermarket WHEN 'ah' THEN 1 WHEN 'jumbo' THEN 2 ELSE 3 END AS store_rank
FROM v_named n JOIN v_sizes z ON z.id = n.id""")

# ---- sources --------------------------------------------------------------------------------

check("explode_cards", r"""
SELECT page_id, CAST(pos - 1 AS INT) AS card_pos, md5(cards[pos]) AS card_md5
FROM (SELECT page_id, cards, unnest(range(1, len(cards) + 1)) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '(?s)<article\b[^>]*>(.*?)</article>', 1)
              AS cards FROM pages))""")
block("v_cards", """
SELECT *, p_partkey // 40 AS page, (p_partkey // 40) * 3 + s AS page_seq,
  CAST(p_partkey % 40 AS INT) AS card_pos,
  name || CASE WHEN p_size % 5 = 0 THEN ' & co' ELSE '' END
    || CASE WHEN s = 0 AND p_size % 6 = 1 THEN ' > groot' ELSE '' END AS title,
  CAST((p_partkey * 37 + s * 11) % 4900 + 20 AS DOUBLE) / 100 AS price,
  CASE WHEN p_size % 3 = 0 THEN CAST((p_partkey * 37 + s * 11) % 4900 + 70 AS DOUBLE) / 100 END
    AS original_price
FROM v_products""")


def _title_unit(x: str) -> str:
    """The word of a title that is digits and then "g"; the titles here hold no other size."""
    word = f"list_filter(string_split({x}, ' '), lambda w: w SIMILAR TO '[0-9]+g')[1]"
    return f"rtrim({word}, 'g') || ' g'"


block("v_offers", f"""
SELECT page, page_seq, card_pos, title AS name, supermarket, s,
  CASE s WHEN 0 THEN 'AH' WHEN 1 THEN 'Jumbo' ELSE CASE WHEN p_size % 4 = 1 THEN '1 de Beste' END
  END AS brand,
  CASE WHEN s <> 1 THEN unit
       ELSE coalesce(CASE WHEN p_size % 2 = 1 THEN unit END, {_title_unit("title")}) END AS unit,
  CASE s WHEN 0 THEN 'https://www.ah.nl/producten/product/' WHEN 1 THEN 'https://www.jumbo.com/p/'
         ELSE 'https://www.dirk.nl/p/' END || id AS link,
  price, original_price,
  CASE WHEN original_price IS NOT NULL OR (s = 0 AND p_size % 7 = 0) THEN 1 ELSE 0 END AS is_sale,
  CASE WHEN s = 0 AND page % 2 = 0 THEN 'vlees' WHEN s = 0 THEN 'kaas'
       WHEN s = 1 AND page % 2 = 0 THEN 'koffie & thee' WHEN s = 1 THEN 'diepvries'
       WHEN page % 2 = 0 THEN 'zuivel & kaas' END AS category,
  CASE WHEN s = 0 AND page % 2 = 0 THEN 'https://www.ah.nl/producten/9344/vlees?page=1'
       WHEN s = 0 THEN 'https://www.ah.nl/producten/1192/kaas'
       WHEN s = 1 AND page % 2 = 0 THEN 'https://www.jumbo.com/producten/koffie-en-thee/'
       WHEN s = 1 THEN 'https://www.jumbo.com/producten/diepvries/'
       WHEN page % 2 = 0 THEN 'https://www.dirk.nl/boodschappen/zuivel-kaas/melk'
       ELSE 'https://www.dirk.nl/boodschappen/elders/melk' END AS page_url
FROM v_cards""")
for _store in ("ah", "jumbo", "dirk"):
    check(f"extract_offers_{_store}", f"""
SELECT page_seq, card_pos, name, brand, unit, link, price, original_price, is_sale
FROM v_offers WHERE supermarket = '{_store}'""")
check("attach_category",
      "SELECT DISTINCT page_seq, supermarket, page_url AS url, category FROM v_offers")
check("extract_observations", """
SELECT page_seq * 100000 + card_pos AS seq, TIMESTAMP '2026-03-11 06:00:00' AS scraped_at,
  supermarket, category, name, brand, unit, link AS url, price, original_price, is_sale
FROM v_offers""")
check("seed_categories", f"""
SELECT m.canonical_category, count(*) AS product_count
FROM v_offers o JOIN (VALUES {_SEED}) AS m(canonical_category, supermarket, category)
  ON m.supermarket = o.supermarket AND m.category = o.category
GROUP BY m.canonical_category""")
check("unit_from_title", f"SELECT id, {_title_unit('name')} AS title_unit FROM v_products")
check("infer_brand", """
SELECT id, CASE WHEN supermarket = 'ah' AND starts_with(name, 'AH ') THEN 'AH'
  WHEN supermarket = 'jumbo' AND starts_with(name, 'Jumbo ') THEN 'Jumbo' END AS house_brand
FROM v_products""")

# ---- ingest ---------------------------------------------------------------------------------

block("v_stored", """
SELECT id, name, brand, category, unit, supermarket, CASE WHEN id % 7 <> 0 THEN url END AS url
FROM (SELECT *, row_number() OVER (PARTITION BY name, supermarket ORDER BY id) AS rn
      FROM v_products) WHERE rn = 1""")


def _resolve(name: str, stored: str) -> None:
    """Blocks {name}: observations with product_id, stored_unit, is_new, reason, found row by row.

    Names that meet by a url are gone through together; each step takes one row of every such group, with
    the group's products as the rows before have left them.
    """
    block(f"{name}_met", f"""
SELECT DISTINCT name || '/' || supermarket AS n, url
FROM (SELECT name, supermarket, url FROM v_observations
      UNION ALL SELECT name, supermarket, url FROM {stored})""")
    block(f"{name}_reach", f"""
WITH RECURSIVE reach AS (
  SELECT n AS a, n AS b FROM {name}_met
  UNION
  SELECT r.a, y.n FROM reach r JOIN {name}_met x ON x.n = r.b JOIN {name}_met y ON y.url = x.url)
SELECT a AS n, min(b) AS grp FROM reach GROUP BY a""")
    block(f"{name}_rows", f"""
SELECT r.grp, row_number() OVER (PARTITION BY r.grp ORDER BY o.seq) AS i, o.seq, r.n, o.unit, o.url
FROM v_observations o JOIN {name}_reach r ON r.n = o.name || '/' || o.supermarket""")
    block(f"{name}_start", f"""
SELECT g.grp, coalesce(list({{'id': s.id, 'n': r.n, 'unit': s.unit, 'url': s.url}} ORDER BY s.id)
                       FILTER (s.id IS NOT NULL), []) AS shelf
FROM (SELECT DISTINCT grp FROM {name}_rows) g
LEFT JOIN ({name}_reach r JOIN {stored} s ON r.n = s.name || '/' || s.supermarket) ON r.grp = g.grp
GROUP BY g.grp""")
    block(f"{name}_steps", f"""
WITH RECURSIVE steps AS (
  SELECT grp, 0::BIGINT AS i, shelf, NULL::BIGINT AS seq, NULL::BIGINT AS found, FALSE AS is_new
  FROM {name}_start
  UNION ALL
  SELECT grp, i,
    CASE WHEN hit IS NOT NULL THEN list_transform(shelf, lambda p: CASE WHEN p.id = hit
           THEN {{'id': p.id, 'n': p.n, 'unit': unit, 'url': url}} ELSE p END)
         WHEN taken THEN shelf
         ELSE list_append(shelf, {{'id': seq, 'n': n, 'unit': unit, 'url': url}}) END,
    seq, CASE WHEN hit IS NOT NULL THEN hit WHEN NOT taken THEN seq END, hit IS NULL AND NOT taken
  FROM (
    SELECT r.grp, r.i, r.seq, r.n, r.unit, r.url, s.shelf,
      len(list_filter(s.shelf, lambda p: p.n = r.n)) > 0 AS taken,
      coalesce(list_filter(s.shelf, lambda p: coalesce(p.url = r.url, FALSE))[1].id,
               list_filter(s.shelf, lambda p: p.n = r.n AND coalesce(p.unit = r.unit, FALSE))[1].id,
               list_filter(s.shelf, lambda p: p.n = r.n AND p.url IS NULL)[1].id) AS hit
    FROM steps s JOIN {name}_rows r ON r.grp = s.grp AND r.i = s.i + 1))
SELECT seq, found, is_new FROM steps WHERE seq IS NOT NULL""")
    block(name, f"""
SELECT o.seq, o.scraped_at, o.supermarket, o.category, o.name, o.brand, o.unit, o.url, o.price,
  o.original_price, o.is_sale, t.found AS product_id, s.unit AS stored_unit, t.is_new,
  CASE WHEN t.found IS NULL THEN 'duplicate_name' END AS reason
FROM v_observations o JOIN {name}_steps t ON t.seq = o.seq
LEFT JOIN {stored} s ON s.id = t.found""")


block("v_none", "SELECT * FROM v_stored WHERE FALSE")
_resolve("v_resolved", "v_stored")
_resolve("v_fresh", "v_none")
check("resolve_products", "SELECT seq, product_id, stored_unit, is_new, reason FROM v_resolved")
check("resolve_new_products", "SELECT seq, product_id, is_new, reason FROM v_fresh")
check("duplicate_names", """
SELECT name, supermarket, count(*) AS rejected FROM v_resolved
WHERE reason = 'duplicate_name' GROUP BY ALL""")
check("upsert_products", """
SELECT s.id, s.name, s.supermarket, CAST(NULL AS TIMESTAMP) AS created_at,
  CASE WHEN l.product_id IS NULL THEN s.brand ELSE l.brand END AS brand,
  CASE WHEN l.product_id IS NULL THEN s.category ELSE l.category END AS category,
  CASE WHEN l.product_id IS NULL THEN s.unit ELSE l.unit END AS unit,
  CASE WHEN l.product_id IS NULL THEN s.url ELSE l.url END AS url
FROM v_stored s LEFT JOIN
  (SELECT * FROM v_resolved WHERE product_id IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq DESC) = 1) l
  ON l.product_id = s.id
UNION ALL
SELECT l.product_id, c.name, c.supermarket, c.scraped_at, l.brand, l.category, l.unit, l.url
FROM v_resolved c JOIN
  (SELECT * FROM v_resolved WHERE product_id IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq DESC) = 1) l
  ON l.product_id = c.product_id
WHERE c.is_new""")
check("rejected_prices", """
SELECT id, product_id, price,
  CASE WHEN price <= 0 THEN 'price_not_positive' ELSE 'price_too_high' END AS reason
FROM v_raw_prices WHERE price <= 0 OR price > 500""")
check("first_price_per_day", "SELECT * FROM v_first_prices")
check("new_prices_only", """
SELECT f.* FROM v_first_prices f WHERE NOT EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_returnflag <> 'R'
    AND l.l_partkey * 3 + l.l_suppkey % 3 = f.product_id
    AND CAST(l.l_shipdate AS DATE) = CAST(f.scraped_at AS DATE))""")
check("default_original_price", """
SELECT id, price, is_sale,
  CASE WHEN original_price IS NULL OR original_price = 0 THEN price ELSE original_price END
    AS original_price FROM v_raw_prices""")
check("clean_false_sales", """
SELECT id, original_price,
  CASE WHEN original_price IS NULL OR original_price = price THEN 0 ELSE is_sale END AS is_sale
FROM v_raw_prices""")
check("add_missing_columns", """
SELECT id, 1 AS old, name, CAST(NULL AS VARCHAR) AS normalized_name,
  CAST(NULL AS DOUBLE) AS unit_quantity, CAST(NULL AS VARCHAR) AS unit_type,
  CAST(NULL AS DOUBLE) AS price_per_unit FROM v_norm
UNION ALL SELECT id, 0, name, normalized_name, unit_quantity, unit_type, price_per_unit FROM v_norm""")
for _name, _table in (("flag_price_jumps", "v_prices"), ("flag_event_price_jumps", "v_event_prices")):
    check(_name, f"""
SELECT id, product_id, price, scraped_at, abs(price - previous_price) / previous_price
  AS change_ratio, previous_price
FROM (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY scraped_at, id) AS previous_price
      FROM {_table})
WHERE previous_price > 0 AND abs(price - previous_price) / previous_price > 0.5""")
block("v_unit_changes", """
SELECT seq AS id, known_id AS product_id, old_unit, unit AS new_unit, scraped_at AS detected_at
FROM (SELECT *, lag(unit) OVER (PARTITION BY known_id ORDER BY seq) AS old_unit
      FROM v_observations)
WHERE old_unit <> '' AND unit <> '' AND old_unit <> unit""")
check("detect_unit_changes", "SELECT * FROM v_unit_changes")
check("detect_stored_unit_changes", """
SELECT seq AS id, product_id, old_unit, unit AS new_unit, scraped_at AS detected_at
FROM (SELECT *, CASE WHEN row_number() OVER w = 1 THEN stored_unit ELSE lag(unit) OVER w END
        AS old_unit
      FROM v_resolved WHERE product_id IS NOT NULL WINDOW w AS (PARTITION BY product_id ORDER BY seq))
WHERE old_unit <> '' AND unit <> '' AND old_unit <> unit""")
check("ingest_summary", """
SELECT r.supermarket, count(*) FILTER (WHERE reason IS NULL) AS scraped,
  count(f.seq) AS inserted,
  count(*) FILTER (WHERE reason IS NULL AND (price <= 0 OR price > 500)) AS rejected,
  count(reason) AS errors
FROM v_resolved r LEFT JOIN
  (SELECT seq FROM v_resolved WHERE product_id IS NOT NULL AND price > 0 AND price <= 500
   QUALIFY row_number() OVER (PARTITION BY product_id, CAST(scraped_at AS DATE) ORDER BY seq) = 1) f
  ON f.seq = r.seq
GROUP BY ROLLUP (r.supermarket)""")
check("day_stats", """
SELECT count(DISTINCT product_id) AS products, count(*) AS prices FROM v_prices
WHERE CAST(scraped_at AS DATE) = DATE '2001-06-01'""")

# ---- column functions and normalization -----------------------------------------------------

check("parse_units", "SELECT id, CASE WHEN type IS NOT NULL THEN qty END AS qty, type FROM v_sizes")
check("unit_words", """
SELECT p.id, CASE WHEN p.number > 0 THEN p.number END AS number, w.unit AS unit_name,
  CASE WHEN p.number > 0 THEN p.number * w.factor END AS base_qty,
  CASE WHEN p.number > 0 THEN w.base END AS base_type
FROM (SELECT id, TRY_CAST(replace(rtrim(string_split(unit, ' ')[1], '+'), ',', '.') AS DOUBLE)
          AS number, lower(string_split(unit, ' ')[-1]) AS last FROM v_products) p
LEFT JOIN unit_words w ON w.spelling = p.last""")
check("normalize_names", """
SELECT k.id, k.normalized_name, k.match_key,
  trim(regexp_replace(lower(p.name), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM v_keys k JOIN v_products p ON p.id = k.id""")
check("normalize_units", "SELECT id, unit_quantity, unit_type, price_per_unit FROM v_norm")
check("normalization_stats", """
SELECT count(type) AS parsed, count(*) FILTER (WHERE type IS NULL) AS skipped, count(*) AS total
FROM v_sizes""")
block("v_canonical", """
SELECT p.id, p.supermarket, p.category, m.canonical_category AS mapped,
  coalesce(m.canonical_category, p.category) AS canonical_category
FROM v_products p LEFT JOIN v_category_map m
  ON m.supermarket = p.supermarket AND m.original_category = p.category""")
check("canonical_category", "SELECT id, canonical_category FROM v_canonical")

# ---- lookup, search and comparison ----------------------------------------------------------

check("latest_price", "SELECT * FROM v_latest")
check("refresh_latest", "SELECT * FROM v_latest")
check("latest_event_price", """
SELECT product_id, price, scraped_at
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, id DESC) AS rn
      FROM v_event_prices) WHERE rn = 1""")
check("search", """
SELECT id, name, supermarket, normalized_name, latest_price, is_sale, scraped_at FROM v_norm
WHERE lower(name) LIKE '%bolt b_and%' ORDER BY supermarket, name, id LIMIT 50""")
check("search_postings", """
SELECT id, name, supermarket, normalized_name, latest_price, is_sale, scraped_at FROM v_norm
WHERE lower(name) LIKE '%bolt b_and%' ORDER BY supermarket, name, id LIMIT 50""")
check("posting_sizes", """
SELECT gram, count(DISTINCT id) AS n
FROM (SELECT id, substr(word, CAST(unnest(range(1, length(word) - 1)) AS INT), 3) AS gram
      FROM (SELECT id, lower(name) AS word FROM v_norm
            UNION ALL SELECT id, lower(normalized_name) FROM v_norm))
GROUP BY gram""")
check("search_store", """
SELECT id, name, supermarket, latest_price, original_price FROM v_norm
WHERE lower(name) LIKE '%gear%' AND supermarket = 'jumbo' ORDER BY supermarket, name, id LIMIT 30""")
block("v_compared", """
SELECT *, count(DISTINCT supermarket) OVER (PARTITION BY group_name) > 1 AS multi_store
FROM (SELECT *, normalized_name AS group_name FROM v_norm
      WHERE lower(name) LIKE '%widget%' OR lower(normalized_name) LIKE '%widget%')""")
check("compare", """
SELECT group_name, multi_store, id, supermarket, latest_price, unit_type, price_per_unit, is_sale
FROM v_compared""")
check("compare_postings", """
SELECT group_name, multi_store, id, supermarket, latest_price, unit_type, price_per_unit, is_sale
FROM v_compared""")
check("rank_offers", """
SELECT group_name, id, supermarket, latest_price, rn = 1 AS is_cheapest,
  CASE WHEN rn > 1 THEN CAST(floor((latest_price - cheapest) / cheapest * 100 + 0.5) AS BIGINT) END
    AS diff_pct
FROM (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY latest_price, supermarket, id)
        AS rn, min(latest_price) OVER (PARTITION BY group_name) AS cheapest
      FROM v_compared
      WHERE latest_price IS NOT NULL AND group_name IN (
        SELECT DISTINCT group_name FROM v_compared WHERE multi_store ORDER BY group_name LIMIT 15))""")
check("single_store_offers", """
SELECT group_name, supermarket, id, name, latest_price
FROM (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY supermarket, id) AS rn
      FROM v_compared WHERE NOT multi_store) WHERE rn = 1 ORDER BY group_name LIMIT 10""")
check("one_product_history", """
SELECT product_id, price, original_price, is_sale, CAST(scraped_at AS DATE) AS date, scraped_at, id
FROM v_prices WHERE product_id = 304""")
check("product_history", """
SELECT product_id, price, original_price, is_sale, CAST(scraped_at AS DATE) AS date, id
FROM v_prices""")
block("v_series", """
SELECT *, year(scraped_at) AS part,
  CAST(row_number() OVER (PARTITION BY product_id, year(scraped_at) ORDER BY scraped_at, id) - 1 AS INT)
    AS pos,
  count(*) OVER (PARTITION BY product_id) AS entries FROM v_prices""")
check("products_with_history", """
SELECT p.id, p.supermarket, p.name, CAST(v.part AS INT) AS part, v.pos, v.price, v.scraped_at, v.is_sale
FROM v_products p LEFT JOIN v_series v ON v.product_id = p.id""")
check("store_counts", """
SELECT p.supermarket, count(*) AS products, count(z.type) AS with_units
FROM v_products p JOIN v_sizes z ON z.id = p.id GROUP BY ROLLUP (p.supermarket)""")
check("price_totals", """
SELECT count(*) AS total_prices, min(CAST(scraped_at AS DATE)) AS first_date,
  max(CAST(scraped_at AS DATE)) AS last_date, count(DISTINCT CAST(scraped_at AS DATE)) AS days
FROM v_prices""")
check("category_total", "SELECT count(DISTINCT category) AS categories FROM v_products")
check("product_total", "SELECT count(*) AS product_count FROM v_products")
block("v_categories", """
SELECT mapped AS canonical_category, count(DISTINCT id) AS product_count FROM v_canonical
WHERE mapped IS NOT NULL GROUP BY mapped""")
check("canonical_categories", "SELECT * FROM v_categories")
check("published_categories", "SELECT * FROM v_categories")
check("products_in_category", """
SELECT n.id, c.mapped AS canonical_category, n.normalized_name, n.latest_price, n.price_per_unit
FROM v_norm n JOIN v_canonical c ON c.id = n.id WHERE c.mapped = 'regular'""")
check("category_page", """
SELECT canonical_category, CAST(rn AS INT) AS position, id, latest_price, category_size
FROM (SELECT c.mapped AS canonical_category, c.id, l.price AS latest_price,
        row_number() OVER (PARTITION BY c.mapped ORDER BY l.price ASC NULLS FIRST, c.id) AS rn,
        count(*) OVER (PARTITION BY c.mapped) AS category_size
      FROM v_canonical c LEFT JOIN v_latest l ON l.product_id = c.id WHERE c.mapped IS NOT NULL)
WHERE rn <= 200""")
check("in_category", """
SELECT c.id, a.asked FROM v_canonical c
JOIN (SELECT unnest(['bulk', 'PROMO', 'budget']) AS asked) a
  ON lower(c.category) LIKE '%' || lower(a.asked) || '%' OR c.mapped = a.asked""")

# ---- price changes --------------------------------------------------------------------------

block("v_window", """
SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY scraped_at, id) AS up,
  row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, id DESC) AS down
FROM v_prices WHERE CAST(scraped_at AS DATE) >= DATE '2001-11-04' - 673""")
block("v_first_last", """
SELECT f.product_id, f.price AS first_price, f.scraped_at AS first_date, l.price AS latest_price,
  l.scraped_at AS latest_date
FROM v_window f JOIN v_window l ON l.product_id = f.product_id AND l.down = 1 WHERE f.up = 1""")
block("v_changed", """
SELECT *, CASE WHEN first_price > 0 THEN (latest_price - first_price) / first_price * 100 END AS pct
FROM v_first_last WHERE first_price <> latest_price""")
check("first_last_prices", "SELECT * FROM v_first_last")
_CHANGE = f"""coalesce({rounded("c.pct", 2)}, 0.0) AS pct_change,
  {rounded("(c.latest_price - c.first_price)", 2)} AS abs_change"""
check("price_changes", f"""
SELECT n.id, n.name, n.supermarket, n.category, n.unit, n.unit_type, n.price_per_unit,
  c.first_price, c.first_date, c.latest_price, c.latest_date, {_CHANGE}
FROM v_norm n JOIN v_changed c ON c.product_id = n.id""")
check("price_changes_in_category", f"""
SELECT p.id, c.first_price, c.latest_price, {_CHANGE}
FROM v_canonical p JOIN v_changed c ON c.product_id = p.id
WHERE p.supermarket = 'ah' AND (p.category LIKE '%bulk%' OR p.mapped = 'bulk') AND abs(c.pct) >= 25""")
check("top_movers", f"""
SELECT direction, CAST(rn AS INT) AS position, id, first_price, latest_price, pct_change
FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY abs(pct_change) DESC, id) AS rn
      FROM (SELECT p.id, c.first_price, c.latest_price, {_CHANGE},
              CASE WHEN {rounded("c.pct", 2)} > 0 THEN 'up' WHEN {rounded("c.pct", 2)} < 0 THEN 'down'
              END AS direction
            FROM v_products p JOIN v_changed c ON c.product_id = p.id WHERE abs(c.pct) >= 10))
WHERE (direction = 'up' AND rn <= 50) OR (direction = 'down' AND rn <= 20)""")
_MEASURES = f"""count(*) AS products, {rounded("(" + mean("c.pct") + ")", 2)} AS avg_change_pct,
  count(*) FILTER (WHERE c.latest_price > c.first_price) AS increased,
  count(*) FILTER (WHERE c.latest_price < c.first_price) AS decreased"""
check("inflation_by_category", f"""
SELECT p.canonical_category AS category, {_MEASURES}, {rounded("max(c.pct)", 2)} AS max_increase_pct
FROM v_canonical p JOIN v_changed c ON c.product_id = p.id GROUP BY 1""")
check("inflation_by_store", f"""
SELECT p.supermarket, {_MEASURES} FROM v_products p JOIN v_changed c ON c.product_id = p.id
GROUP BY 1""")
check("fake_sales", f"""
SELECT p.id, p.name, p.supermarket, p.category, p.unit, t.* EXCLUDE (product_id)
FROM v_products p JOIN
  (SELECT product_id, count(*) AS total_prices, CAST(sum(is_sale) AS BIGINT) AS sale_count,
     min(price) AS min_price, max(price) AS max_price, {mean("price")} AS avg_price,
     {rounded("(CAST(sum(is_sale) AS DOUBLE) / count(*) * 100)", 1)} AS sale_pct
   FROM v_prices GROUP BY product_id) t ON t.product_id = p.id
WHERE t.total_prices >= 3 AND t.sale_pct >= 80""")
check("shrinkflation", """
SELECT u.*, p.name, p.supermarket, p.category
FROM v_unit_changes u JOIN v_products p ON p.id = u.product_id""")
block("v_index", f"""
SELECT CAST(r.scraped_at AS DATE) AS date, p.supermarket, {rounded("(" + mean("r.price") + ")", 4)}
  AS avg_price, count(*) AS products
FROM v_prices r JOIN v_products p ON p.id = r.product_id GROUP BY 1, 2""")
check("price_index", "SELECT * FROM v_index")
check("price_index_wide", """
SELECT date, max(CASE WHEN supermarket = 'ah' THEN avg_price END) AS ah,
  max(CASE WHEN supermarket = 'jumbo' THEN avg_price END) AS jumbo,
  max(CASE WHEN supermarket = 'dirk' THEN avg_price END) AS dirk
FROM v_index GROUP BY date""")

# ---- matching -------------------------------------------------------------------------------

block("v_key_firsts", """
SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY store_rank) AS in_key,
  first_value(unit_type) OVER (PARTITION BY match_key ORDER BY store_rank) AS lead_unit,
  first_value(id) OVER (PARTITION BY match_key ORDER BY store_rank) AS match_id
FROM (SELECT *, row_number() OVER (PARTITION BY store_rank, match_key ORDER BY normalized_name, id)
        AS rn FROM v_keys) WHERE rn = 1""")
block("v_exact", """
SELECT match_id, id AS product_id, match_key, CAST(store_rank AS INT) AS store_rank
FROM (SELECT *, count(*) OVER (PARTITION BY match_key) AS members FROM v_key_firsts
      WHERE unit_type IS NULL OR lead_unit IS NULL OR unit_type = lead_unit)
WHERE members >= 2""")
check("match_candidates", """
SELECT id, match_key, CAST(store_rank AS INT) AS store_rank FROM v_keys
WHERE id NOT IN (SELECT product_id FROM v_exact)""")
check("exact_matches", "SELECT * FROM v_exact")
block("v_pool", """
SELECT c.canonical_category AS block, CAST(k.store_rank AS INT) AS store_rank, k.match_key,
  k.id AS product_id, k.unit_type, f.normalized_name AS place_name, f.id AS place_id
FROM (SELECT *, row_number() OVER (PARTITION BY store_rank, match_key ORDER BY normalized_name, id)
        AS rn FROM v_keys WHERE id NOT IN (SELECT product_id FROM v_exact)) k
JOIN v_canonical c ON c.id = k.id
JOIN v_key_firsts f ON f.store_rank = k.store_rank AND f.match_key = k.match_key
WHERE k.rn = 1""")
check("fuzzy_pool", "SELECT block, store_rank, match_key, product_id, unit_type FROM v_pool")
block("v_pairs", """
SELECT * FROM (
  SELECT a.product_id AS base_id, a.match_key AS base_key, a.place_name, a.place_id,
    b.product_id AS other_id, b.store_rank AS other_rank, b.place_name AS other_name,
    b.place_id AS other_place, levenshtein(a.match_key, b.match_key) AS distance,
    greatest(length(a.match_key), length(b.match_key)) AS longest
  FROM v_pool a JOIN v_pool b ON b.block = a.block AND a.store_rank = 1 AND b.store_rank > 1
    AND length(b.match_key) BETWEEN length(a.match_key) - 3 AND length(a.match_key) + 3
    AND (a.unit_type IS NULL OR b.unit_type IS NULL OR a.unit_type = b.unit_type))
WHERE distance <= 3 AND distance / longest < 0.2""")
check("similar_pairs", "SELECT base_id, other_id, CAST(distance AS INT) AS distance FROM v_pairs")
block("v_fuzzy", """
SELECT base_id AS match_id, other_id AS product_id, base_key AS match_key,
  CAST(distance AS INT) AS distance, other_rank, other_name, other_place
FROM (SELECT *, row_number() OVER (PARTITION BY other_id ORDER BY place_name, place_id) AS rn
      FROM v_pairs) WHERE rn = 1""")
check("fuzzy_matches", "SELECT match_id, product_id, match_key, distance FROM v_fuzzy")
block("v_matches", """
SELECT match_id AS id, match_key AS canonical_name, 'exact' AS match_type,
  CAST(0.95 AS DOUBLE) AS confidence, 1 AS confirmed
FROM v_exact WHERE match_id = product_id
UNION ALL
SELECT match_id, match_key, 'fuzzy',
  greatest(CAST(0.7 AS DOUBLE), CAST(1 AS DOUBLE) - distance * CAST(0.1 AS DOUBLE)), 0
FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY other_rank, other_name, other_place)
        AS rn FROM v_fuzzy) WHERE rn = 1""")
block("v_members", """
SELECT match_id, product_id FROM v_exact UNION ALL SELECT match_id, product_id FROM v_fuzzy
UNION ALL SELECT DISTINCT match_id, match_id FROM v_fuzzy""")
check("match_groups", "SELECT * FROM v_matches")
check("match_members", "SELECT * FROM v_members")
check("unconfirmed_matches", """
SELECT m.match_id, t.canonical_name, t.confidence, m.product_id, c.supermarket,
  l.price AS latest_price
FROM (SELECT * FROM v_matches WHERE confirmed = 0 AND id IN (
        SELECT y.match_id FROM v_members y JOIN v_canonical c ON c.id = y.product_id
        WHERE c.mapped = 'budget' OR c.category LIKE '%budget%')
      ORDER BY confidence DESC, id LIMIT 100) t
JOIN v_members m ON m.match_id = t.id JOIN v_canonical c ON c.id = m.product_id
LEFT JOIN v_latest l ON l.product_id = m.product_id""")
block("v_reviewed", """
SELECT * EXCLUDE (confirmed), 1 AS confirmed FROM v_matches WHERE confirmed = 1 OR confidence > 0.85""")
check("apply_review", """
SELECT r.id, r.match_type, r.confirmed, count(*) AS members
FROM v_reviewed r JOIN v_members m ON m.match_id = r.id GROUP BY ALL""")
check("matched_groups", """
SELECT m.match_id, t.canonical_name, m.product_id, n.latest_price, n.price_per_unit
FROM (SELECT * FROM v_matches WHERE confirmed = 1 ORDER BY canonical_name, id LIMIT 100) t
JOIN v_members m ON m.match_id = t.id JOIN v_norm n ON n.id = m.product_id""")
block("v_group_rows", """
SELECT m.match_id, r.canonical_name, n.*,
  min(CASE WHEN n.latest_price > 0 THEN n.latest_price END) OVER (PARTITION BY m.match_id) AS low,
  max(CASE WHEN n.latest_price > 0 THEN n.latest_price END) OVER (PARTITION BY m.match_id) AS high,
  count(CASE WHEN n.latest_price > 0 THEN 1 END) OVER (PARTITION BY m.match_id) AS priced
FROM v_reviewed r JOIN v_members m ON m.match_id = r.id JOIN v_norm n ON n.id = m.product_id""")
check("plausible_groups", """
SELECT match_id, canonical_name, id AS product_id, latest_price FROM v_group_rows
WHERE priced >= 2 AND high / low <= 2""")
block("v_comparison", """
SELECT match_id, trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  id AS product_id, CASE supermarket WHEN 'ah' THEN 'Albert Heijn' WHEN 'jumbo' THEN 'Jumbo'
    ELSE 'Dirk' END AS seller,
  latest_price AS price, rn = 1 AS is_cheapest, first_value(supermarket) OVER w AS cheapest_store,
  CASE WHEN rn > 1 THEN CAST(floor(0.5 + 100 *
    CASE WHEN price_per_unit <> 0 AND first_value(price_per_unit) OVER w <> 0
              AND unit_type = first_value(unit_type) OVER w
         THEN (price_per_unit - first_value(price_per_unit) OVER w)
              / first_value(price_per_unit) OVER w
         ELSE (latest_price - low) / low END) AS BIGINT) END AS diff_pct
FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY latest_price, id) AS rn
      FROM v_group_rows WHERE priced >= 2 AND high / low <= 2 AND latest_price > 0)
WINDOW w AS (PARTITION BY match_id ORDER BY rn)""")
check("comparison_table", "SELECT * FROM v_comparison")

# ---- published datasets ---------------------------------------------------------------------

check("export_history", """
SELECT p.id, p.url, v.pos, v.price, v.original_price, v.is_sale = 1 AS is_sale, v.scraped_at AS date
FROM v_products p LEFT JOIN v_series v ON v.product_id = p.id""")
check("export_rows", """
SELECT r.product_id, p.name, coalesce(p.brand, '') AS brand, p.category,
  coalesce(p.unit, '') AS unit, p.supermarket, p.url, r.price, r.original_price,
  CASE r.is_sale WHEN 1 THEN 'ja' ELSE 'nee' END AS is_sale, r.scraped_at AS date
FROM v_prices r JOIN v_products p ON p.id = r.product_id""")
check("category_datasets", """
SELECT c.mapped AS category_slug, c.id, l.price AS latest_price, l.is_sale
FROM v_canonical c LEFT JOIN v_latest l ON l.product_id = c.id WHERE c.mapped IS NOT NULL""")
check("search_index", """
SELECT supermarket, id AS i, name AS n, supermarket AS s, category AS c, unit AS u, unit_type AS ut,
  unit_quantity AS uq, price_per_unit AS pp, normalized_name AS nn, latest_price AS p,
  original_price AS op, is_sale AS sa FROM v_norm""")
check("history_extract", """
SELECT product_id, pos, price, is_sale, CAST(scraped_at AS DATE) AS date FROM v_series
WHERE entries > 1""")
check("build_meta", """
SELECT TIMESTAMP '2001-11-05 00:00:00' AS generated_at,
  (SELECT count(*) FROM v_products) AS product_count, count(*) AS price_count,
  min(CAST(scraped_at AS DATE)) AS first_date, max(CAST(scraped_at AS DATE)) AS last_date,
  count(DISTINCT CAST(scraped_at AS DATE)) AS days FROM v_prices""")
check("site_urls", """
SELECT kind, slug, priority, count(*) AS pages FROM (
  SELECT 'page' AS kind, unnest(['', 'categorieen', 'over', 'privacy']) AS slug,
    CAST(1 AS DOUBLE) AS priority
  UNION ALL SELECT 'category', canonical_category, CAST(0.8 AS DOUBLE) FROM v_categories
  UNION ALL SELECT 'comparison', slug, CAST(0.7 AS DOUBLE) FROM v_comparison WHERE is_cheapest)
GROUP BY ALL""")
