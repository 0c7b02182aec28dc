"""Tables with everything that is odd at once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def sentence(seed: int, n: int) -> str:
    out = []
    for _ in range(n):
        seed = (seed * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(seed >> 12) % len(WORDS)] + str((seed >> 20) % 97))
    return " ".join(out)


LONG = "\n".join(sentence(k, 40) for k in range(900))
#: (doc_id, text): nulls, empty texts, white space, a very long text, copies and repeated rows.
ROWS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, LONG), (5, "word"), (6, sentence(1, 60)),
    (7, sentence(1, 60)), (7, sentence(1, 60)), (8, sentence(1, 60) + " tail"), (None, "no id here"),
    (None, None), (9, "é" * 500 + " ß İ é \U0001f600 x"), (10, "a" * 5000),
    (-11, sentence(2, 30) + "\x00\x1c end"), (12, sentence(3, 25)), (12, sentence(3, 25)),
]
#: Names that operators use inside, as columns of the input.
CLASHING = (
    "_text _words _lines _hashes _data row digest fp ids bands shingles part seq spans candidates "
    "n_words kept toxic _toxic payload header copies data nodes n component marks".split()
)


def documents(spark: SparkSession, rows=ROWS) -> DataFrame:
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    return df.withColumn("n_chars", F.col("n_chars").cast("long"))


def clashing(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.lit("clash") for name in CLASHING if name not in df.columns})


def sorted_rows(df: DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


def check_shapes(df: DataFrame, operator) -> list[tuple]:
    """Extra columns and the partitioning do not matter, an empty table gives an empty result."""
    plain = sorted_rows(operator(df))
    assert sorted_rows(operator(clashing(df).repartition(3))) == plain
    assert sorted_rows(operator(df.limit(0))) == []
    return plain
