"""The pipeline against its stages' plain versions, and all queries against their SQL."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from odd import documents
from test_byte_bpe import CODER
from test_containment import expected as contained
from test_simhash import expected as near_groups

import __spark_entry__ as entry_point
import corpus_pipeline
from checks.run import TABLES, rows_of
from pricetrail.llm import secret_scan, toxicity
from pricetrail.llm.common import WorkFolder, table
from pricetrail.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, result.fetchall())
    assert len(want) > 0 and got == want


def test_registered():
    names = set(entry_point.queries())
    for n in range(1, 14):
        assert sum(re.match(rf"op{n}_", name) is not None for name in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    labels, items = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    columns = docs.columns
    stages = [stage for _, stage in corpus_pipeline.STAGES]

    chain = toxicity.fit(docs, labels, WorkFolder(spark, "test"))
    toxic = {r.doc_id for r in toxicity.score(docs, chain).where("toxic").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = {k: t for k, t in rows.items() if k not in toxic}

    def check(stage, df, want):
        out = stage(spark, df, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / stage.__name__))
        out = spark.read.parquet(str(tmp_path / stage.__name__))
        assert {r.doc_id: r.text for r in out.collect()} == want and out.count() == len(want)
        return out

    df = check(stages[0], docs, left)
    left = {k: left[k] for c, k, _ in near_groups(list(left.items())) if c == k}
    df = check(stages[1], df, left)
    hit = {r[1] for r in contained(list(left.items()), [tuple(r) for r in items.collect()])}
    left = {k: t for k, t in left.items() if k not in hit}
    df = check(stages[2], df, left)
    network = secret_scan.fit(secret_scan.scan(df))

    def blank(text):
        base = secret_scan.base_spans(text)
        seen = secret_scan.judged(text, base)
        gone = [False] * (len(text) + 1)
        out, starts = [], set()
        for a, b, _ in sorted(base + secret_scan.added_spans(seen, network)):
            if not gone[a]:
                starts.add(a)
            gone[a:b] = [True] * (b - a)
        for k, c in enumerate(text):
            out.append("[SECRET]" if k in starts else "" if gone[k] else c)
        return "".join(out)

    left = {k: blank(t) for k, t in left.items()}
    df = check(stages[3], df, left)
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in stages[4](spark, df, SF).collect()}
    assert got == {
        k: (len(CODER.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())
        for k, t in left.items()
    }
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in final.collect()} == got


def test_odd_documents(spark):
    df = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert stage(spark, df.limit(0), SF).count() == 0
        df = WorkFolder(spark, "test").write(out, name)
    left = Counter(r.doc_id for r in df.collect())
    # Copies and near copies of document 6 go, one of the repeated rows of 12 stays.
    assert left[6] == 1 and left[7] == 0 and left[12] == 1 and left[None] == 2
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == sum(left.values())


def test_texts_of_one_id(spark):
    """Different texts of an id all stay; of equal ones the row that is least in the other columns."""
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "en", "b", 1), (1, text, "en", "a", 1), (1, "quite another text of it", "en", "z", 1),
            (2, text, "en", "a", 1), (3, None, "en", "a", 1), (3, None, "de", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, df.repartition(4), SF)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [
        (1, "quite another text of it", "en", "z", 1), (1, text, "en", "a", 1), (3, None, "de", "a", 1),
    ]
