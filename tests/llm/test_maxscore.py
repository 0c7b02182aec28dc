import numpy as np
import pytest
from odd import CLASHING, sorted_rows
from pyspark.sql import functions as F

from pricetrail.llm import maxscore

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k, scale):
    """All inner products of whole numbers, sorted."""

    def whole(vector):
        if vector is None or any(x is None or not np.isfinite(x) for x in vector):
            return None
        return [int(np.floor(float(np.float32(x)) * scale)) for x in vector]

    known = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = []
    for q, v in queries:
        if q is None or whole(v) is None:
            continue
        scores = [(-sum(a * b for a, b in zip(whole(v), w)), i) for i, w in known if i != q]
        out += [(q, n + 1, -s, i) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def search(spark, rows, queries, k=3, **sizes):
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    asked = spark.createDataFrame([(i, v, 0) for i, v in queries], VECTORS)
    found = maxscore.top_k(vectors, asked, k, 64, **sizes)
    assert found.dtypes == [
        ("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")
    ]
    return sorted((r.query_id, r.rank, r.score, r.vec_id) for r in found.collect())


def test_grid_of_parts_and_groups(spark):
    random = np.random.default_rng(5)
    rows = [(k, (random.normal(size=12) * 0.3).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[7][1]) for k in range(60)]  # copies, hence ties
    got = search(spark, rows, rows[::5], 20, shard=16, part=64, group=30)
    assert got == brute(rows, rows[::5], 20, 64)


def test_sparse_terms(spark):
    random = np.random.default_rng(6)
    rows = [(k, (random.random(30) * (random.random(30) < 0.1)).tolist()) for k in range(200)]
    assert search(spark, rows, rows[::7], 5, shard=32) == brute(rows, rows[::7], 5, 64)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [-0.5, 0.5]), (3, [0.0, 0.0]), (4, []), (5, None),
        (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (9, [0.25]),
        (10, [1.0, 1.0, 1.0]), (0, [0.5, -0.5]), (11, [1e6, -1e6]), (-20, [0.1, 0.1]),
    ]
    for k in (1, 4, 50):
        assert search(spark, rows, rows, k, shard=4) == brute(rows, rows, k, 64)
    assert search(spark, rows, []) == [] and search(spark, [], rows) == []
    with pytest.raises(Exception, match="64 bits"):
        search(spark, [(1, [1e10, 1e10])], [(2, [1e10, 1e10])])


def test_extra_columns_and_partitions(spark):
    df = spark.range(300).select(
        F.col("id").alias("vec_id"),
        F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.sin(F.col("id") * x)).alias(
            "embedding"
        ),
    )
    plain = sorted_rows(maxscore.top_k(df, df.where("vec_id % 20 = 0")))
    names = [*CLASHING, "id", "v", "n", "ids", "number", "cell", "query", "rank", "score"]
    wide = df.withColumns({name: F.lit("clash") for name in names}).repartition(5)
    assert sorted_rows(maxscore.top_k(wide, wide.where("vec_id % 20 = 0"))) == plain


def test_pruning_skips_postings():
    """Once the floor is high, non-essential lists and whole shards are left alone."""
    search = maxscore.Search(1)
    search.add_queries(np.array([0]), np.array([[10, 1]]))
    for ids, matrix in (([1], [[10, 0]]), ([2, 3], [[1, 9], [0, 5]])):
        lists = maxscore.posting_lists(np.array(matrix))
        shard = maxscore.read_shard(len(ids), np.array(ids, "<i8").tobytes(), lists)
        search.visit(shard)
    assert search.best[0][0].tolist() == [100] and search.best[0][1].tolist() == [1]
    found, _ = search._candidates(
        0, np.array([10, 1]), np.array([0, 1]), np.array([19, 9, 0]), shard, shard.full
    )
    assert len(found) == 0
