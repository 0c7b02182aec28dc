"""One query per operator over its whole table, and its SQL where SQL can express it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricetrail.llm import (
    byte_bpe,
    containment,
    conversations,
    html_text,
    importance,
    maxscore,
    repeats,
    rules,
    secret_scan,
    simhash,
    token_files,
    toxicity,
    warc,
)
from pricetrail.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
WORD_FILE, WORD_END = public_tokenizers.path("word_bpe_49k.json"), 1
SIMHASH_WIDTH, SIMHASH_DISTANCE = 4, 4


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(
        table(spark, sf_dir, "documents"), SIMHASH_WIDTH, SIMHASH_DISTANCE
    )


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


ORACLE["op3_warc"] = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest
    FROM p
), r AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r
"""


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"))


ORACLE["op4_quality_rules"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), m AS (
    SELECT r, doc_id, w, len(w)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_capitals,
           list_filter(string_split(t, chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), p AS (
    SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM m WHERE len(w) >= 8
), g AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 7], ' ')) AS n FROM p
), c AS (
    SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS own
    FROM g WHERE n > 1
), s AS (
    SELECT r, sum(own)::BIGINT AS n_repeat_words FROM c GROUP BY r
), l AS (
    SELECT doc_id, n_words, word_chars, n_symbols, len(lines)::BIGINT AS n_lines,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_capitals,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM m LEFT JOIN s USING (r)
), b AS (
    SELECT *,
           (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
            + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
            + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
            + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
            + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
            + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
            + CASE WHEN 2 * n_capitals > word_chars THEN 64 ELSE 0 END)::BIGINT AS failures
    FROM l
)
SELECT *, failures & 3 <> 0 AS base_failed, failures = 0 AS kept FROM b
"""


@query
def op5_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


ORACLE["op7_decontamination"] = r"""
WITH i AS (
    SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark
    WHERE item_id IS NOT NULL AND text IS NOT NULL
), k AS (
    SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0
), s AS (
    SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM k)
), n AS (
    SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id
), d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), x AS (
    SELECT DISTINCT r, doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS g
    FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j
          FROM d, (SELECT DISTINCT k FROM k) WHERE len(w) >= k)
), f AS (
    SELECT r, doc_id, item_id, count(*) AS n_shared
    FROM x JOIN s USING (k, g) GROUP BY r, doc_id, item_id
)
SELECT doc_id, item_id, max(n_shared)::BIGINT AS n_shared, n_shingles::BIGINT AS n_shingles,
       max(n_shared)::DOUBLE / n_shingles AS containment
FROM f JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles
HAVING max(n_shared)::DOUBLE / n_shingles >= 0.8
"""


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), WORD_FILE, WORD_END)


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), RANK_FILE, PATTERN)


@query
def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE["op11_maxscore"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER
        AS rank
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(original), original)


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


ORACLE["op13_importance"] = r"""
WITH crc AS (
    SELECT list(x ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i] || [0 for k in range(8)], lambda x, y:
                   CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x
        FROM range(256) AS r(i))
), d AS (
    SELECT 0 AS side, row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
    UNION ALL
    SELECT 1, row_number() OVER (), item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    FROM benchmark
), f AS (
    SELECT side, r, unnest(w || [w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) AS g FROM d
), c AS (
    SELECT side, r, g, count(*) AS n FROM f GROUP BY ALL
), h AS (
    SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM c)
), b AS (
    SELECT g, xor(list_reduce(
        [4294967295] || [('0x' || x[2 * k + 1:2 * k + 2])::BIGINT for k in range(len(x) // 2)],
        lambda a, y: xor(t[(xor(a, y) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket
    FROM h, crc
), s AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s,
           coalesce(sum(n) FILTER (side = 1), 0) AS t
    FROM c JOIN b USING (g) GROUP BY bucket
), a AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
               / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain
    FROM s
), m AS (
    SELECT r, sum(n) AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
    FROM c JOIN b USING (g) JOIN a USING (bucket) WHERE side = 0 GROUP BY r
), e AS (
    SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
           coalesce(weight, 0)::BIGINT AS weight,
           (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' ||
               coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5) / 4294967296::DOUBLE)))
           )::BIGINT AS score
    FROM d LEFT JOIN m USING (r) WHERE side = 0
), p AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place,
           count(*) OVER () AS n
    FROM e WHERE n_words >= 20
)
SELECT doc_id, n_words, n_features, weight, score,
       CASE WHEN place <= 25 * n // 100 THEN place END::BIGINT AS rank
FROM e LEFT JOIN p USING (r)
"""
