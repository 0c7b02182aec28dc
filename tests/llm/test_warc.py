import gzip
import hashlib
from pathlib import Path

import pytest
from odd import check_shapes, clashing

from pricetrail.llm import warc
from pricetrail.llm.common import WorkFolder

BIG = "<p>" + "payload \r\n\r\n WARC/1.1 " * 9 + "</p>"
PAGES = [
    (3, "http://a/x", BIG), (1, "http://b/\r\nx", BIG), (2, None, BIG), (2, None, BIG), (4, "u", None),
    (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "n", BIG), (8, "é", "é" * 50),
    (9, "é", "é" * 50), (10, "l", BIG * 2000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows):
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(first.get(html or "", key), key)
    for key, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and key != first.get(html or "", key)
        yield (
            key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
            first[html or ""] if revisit else None,
        )


def test_records(spark):
    got = check_shapes(pages(spark), warc.archived_pages)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert names == sorted(names)
    assert got == sorted(expected(PAGES), key=repr)


def test_payloads_are_stored_once(spark):
    work = WorkFolder(spark, "test")
    warc.write_archive(clashing(pages(spark)), work)
    assert spark.read.parquet(f"{work.path}/payloads").count() == len({h or "" for *_, h in PAGES})
    record = warc.read_records(work).where("page_id = 3").first()
    assert bytes(record.payload).decode() == BIG
    assert record.header.startswith("WARC/1.1\r\nWARC-Type: revisit\r\n")
    assert "WARC-Refers-To: <urn:x-page:1>\r\n" in record.header
    assert record.header.endswith("Content-Length: 0\r\n\r\n")


def test_damage_is_noticed(spark):
    work = WorkFolder(spark, "test")
    warc.write_archive(pages(spark), work)
    path = f"{work.path}/payloads"
    broken = spark.read.parquet(path).selectExpr("digest", "n_bytes", "first_id",
                                                 "concat(payload, X'00') AS payload")
    rows = broken.collect()
    spark.createDataFrame(rows, broken.schema).write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="payload is not that of"):
        warc.read_records(work).collect()


def test_export(spark, tmp_path):
    work = WorkFolder(spark, "test")
    warc.write_archive(pages(spark), work)
    warc.export_warc(work, str(tmp_path / "out"))
    found = {}
    for file in Path(tmp_path / "out").glob("part-*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            kind = fields["WARC-Type"]
            found.setdefault(fields.get("WARC-Record-ID"), []).append((kind, rest[:size]))
            data = rest[size + 4 :]
    assert sum(map(len, found.values())) == len(PAGES)
    assert found["<urn:x-page:1>"] == [("response", BIG.encode())]
    assert found["<urn:x-page:3>"] == [("revisit", b"")]
