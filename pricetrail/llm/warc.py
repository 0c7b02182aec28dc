"""Content-addressed WARC archive: payload bytes once, exact record headers apart, joined on reading.

* `payloads`: one row per digest with the payload's bytes. Copies are combined before the shuffle, and
  all copies of a digest must agree in length and in a second, independent hash.
* `headers`: one row per record with its exact header block (WARC/1.1, up to the empty line), holding
  the SHA-256 of the payload. Of records with equal payloads of at least 100 bytes, that with the
  smallest id is a response and the others are revisits that refer to it; smaller ones all are responses.

Reading joins headers and payloads on the digest, takes the fields from the header block, and checks
digest and length of the bytes found. `export_warc` writes plain WARC files from the same records.

Null payload counts as empty, null url leaves its field out. A null id sorts after all others; rows that
repeat the smallest id of a payload are responses all. An empty table gives an empty archive; other
columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import WorkFolder

#: Shorter payloads are stored as responses, copies or not.
MIN_REVISIT_BYTES = 100
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
#: Records of a table without capture times bear this one.
NO_DATE = "1970-01-01T00:00:00Z"


def _field(name: str, value: Column) -> Column:
    """The header line, or nothing where the value is null; line breaks in it are escaped."""
    escaped = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), escaped, F.lit(LINE)), F.lit(""))


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), key.cast("string"), F.lit(">"))


def header_block(key: str, url: str) -> Column:
    """The exact header of a record, with its closing empty line."""
    response = F.col("record_type") == "response"
    return F.concat(
        F.lit(VERSION + LINE),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _urn(F.col(key))),
        _field("WARC-Target-URI", F.col(url)),
        _field("WARC-Date", F.lit(NO_DATE)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(~response, _urn(F.col("refers_to")))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(response, F.col("n_bytes")).otherwise(0).cast("string")),
        F.lit(LINE),
    )


def write_archive(
    df: DataFrame, work: WorkFolder, payload: str = "html", key: str = "page_id", url: str = "url"
) -> None:
    """Write `payloads` and `headers` under the work folder."""
    data = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = df.select(
        F.col(key).cast("long").alias(key), F.col(url).cast("string").alias(url),
        data.alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    n_bytes = F.octet_length("payload").cast("long")
    other = F.xxhash64("payload")
    copies = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"),
        F.min(n_bytes).alias("n_bytes"),
        F.min(key).alias("first_id"),
        ((F.min(n_bytes) == F.max(n_bytes)) & (F.min(other) == F.max(other))).alias("agree"),
    )
    checked = F.when(F.col("agree"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("different payloads under digest "), F.col("digest")))
    )
    copies = copies.select("digest", "n_bytes", "first_id", checked.alias("payload"))
    payloads = work.write(copies, "payloads")
    firsts = payloads.select("digest", "n_bytes", "first_id").hint("merge")
    repeat = (F.col("n_bytes") >= MIN_REVISIT_BYTES) & ~F.col(key).eqNullSafe(F.col("first_id"))
    records = (
        rows.select(key, url, "digest")
        .join(firsts, "digest")
        .withColumn("record_type", F.when(repeat, F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(repeat, F.col("first_id")))
    )
    work.write(records.select(key, "digest", header_block(key, url).alias("header")), "headers")


def read_records(work: WorkFolder, key: str = "page_id") -> DataFrame:
    """Every record with its header block, the fields read from it, and its payload."""
    spark = work.spark
    payloads = spark.read.parquet(f"{work.path}/payloads").select("digest", "payload")
    sound = F.sha2("payload", 256) == F.col("digest")
    # Checked once per payload, however many records refer to it.
    payloads = payloads.select(
        "digest",
        F.when(sound, F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("payload is not that of "), F.col("digest"))))
        .alias("payload"),
    )
    headers = spark.read.parquet(f"{work.path}/headers").select(key, "header")

    def field(name: str, pattern: str) -> Column:
        return F.nullif(F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1), F.lit(""))

    fields = headers.select(
        key,
        "header",
        field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:x-page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        field("WARC-Target-URI", "([^\\r]*)").alias("target_uri"),
        field("Content-Length", "([0-9]+)").cast("long").alias("content_length"),
    )
    return fields.join(payloads.hint("merge"), "digest")


def export_warc(work: WorkFolder, path: str, key: str = "page_id", codec: str = "gzip") -> None:
    """Plain WARC files: header block, payload of responses, and an empty line after each record."""
    block = F.when(F.col("record_type") == "response", F.col("payload").cast("string"))
    records = read_records(work, key)
    (
        records.select(F.concat("header", F.coalesce(block, F.lit(""))).alias("value"))
        .write.option("lineSep", LINE + LINE)
        .option("compression", codec)
        .text(path)
    )


def archived_pages(
    df: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url"
) -> DataFrame:
    """Write the archive and read it back: what each record says and what its payload is."""
    work = WorkFolder(df.sparkSession, "warc")
    write_archive(df, work, payload, key, url)
    records = read_records(work, key)
    return records.select(
        key,
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
