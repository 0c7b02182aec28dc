"""A training-data pipeline: each stage works on all that the stage before it kept.

Toxic documents go, one document of each group of near-duplicates stays, documents that contain a benchmark
item go, secrets are blanked out, and what is left is encoded. Every stage but the last returns the columns
of its input. Rows with null id go through the stages like others; they belong to no group that could name
them, so near-duplicate removal and decontamination leave them in. Repeated rows of an id and text are copies: the
least of them stays after near-duplicate removal; different texts of an id that stays all stay. Empty
tables pass through as empty tables.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.llm import byte_bpe, containment, secret_scan, simhash, toxicity
from pricetrail.llm.common import WorkFolder, table
from pricetrail.llm.queries import PATTERN, RANK_FILE, SIMHASH_DISTANCE, SIMHASH_WIDTH

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    labels = table(spark, sf_dir, "labels")
    chain = toxicity.fit(docs, labels, WorkFolder(spark, "toxicity"))
    return toxicity.without_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates, the document with the smallest id stays."""
    groups = simhash.near_duplicates(docs, SIMHASH_WIDTH, SIMHASH_DISTANCE)
    ids = groups.groupBy("doc_id").agg(
        F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n")
    )
    kept = WorkFolder(spark, "near-dedup").write(ids.where("stays"), "kept")
    # One plan at every size, whether or not the ids would fit a broadcast.
    single = kept.where("n = 1").hint("merge")
    out = docs.join(single, "doc_id", "left_semi").select(docs.columns)
    out = out.union(docs.where("doc_id IS NULL"))
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return out
    # Only rows of repeated ids are compared as texts.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = (
        docs.join(repeated, "doc_id", "left_semi")
        .groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_others"))
    )
    return out.union(
        one.select(*(F.col(c if c in ("doc_id", "text") else f"_others.{c}") for c in docs.columns))
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return containment.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; all documents stay."""
    work = WorkFolder(spark, "secret-scan")
    scanned = work.write(secret_scan.scan(docs), "scanned")
    return secret_scan.redact(docs, secret_scan.fit(scanned))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, RANK_FILE, PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: Models, fingerprints and merges are beyond SQL; tests/llm/ compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    work = WorkFolder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
