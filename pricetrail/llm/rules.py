"""Quality rules as a ledger of failure bits: measured once, judged by any policy afterwards.

`measure` computes what the rules look at, `ledger` evaluates every rule and stores its outcome as one bit
beside the measurements, and policies, versioned masks over those bits, are applied to the ledger alone.
What a policy would keep without one of its rules follows from the bits too (`ablation`).

Only built-in functions, no shuffle: a text is measured within its row. Words are runs of characters other
than ASCII white space. Repeated eight-word windows are found by their 64-bit hashes; they are sorted only
in texts whose windows are not all different.

Null text has no words, like empty text. Rows are independent: repeated rows and null ids are kept. Other
columns are not read, whatever their names.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Rules by bit. Each says when a text fails; null counts as not failed.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 20,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 15 * F.col("n_words"),
    "capitals": lambda: 2 * F.col("n_capitals") > F.col("word_chars"),
}
BIT = {name: k for k, name in enumerate(RULES)}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_repeat_words"
)


@dataclass(frozen=True)
class Policy:
    """The rules that a version of the policy applies."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("v1", ("few_words", "repeated_words", "symbols", "capitals")),
    Policy("v2", tuple(RULES)),
)
CURRENT = POLICIES[-1]


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in windows whose hash occurs twice or more."""
    ordered = F.sort_array(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )

    def twice(rows: Column) -> Column:
        last = F.size(rows) - 1

        def place(row: Column, k: Column) -> Column:
            like_before = (k > 0) & (F.get(rows, k - 1)["h"] == row["h"])
            like_after = (k < last) & (F.get(rows, k + 1)["h"] == row["h"])
            return F.when(like_before | like_after, row["i"])

        return F.sort_array(F.array_compact(F.transform(rows, place)))

    def covered(places: Column) -> Column:
        # A window adds its eight words, less those that the next one covers too.
        own = F.transform(
            places,
            lambda at, k: F.least(
                F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - at, F.lit(WINDOW))
            ),
        )
        return F.aggregate(own, F.lit(0), lambda total, n: total + n)

    return _with(_with(ordered, twice), covered)


def measure(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and the measurements (long) of every row."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(content, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACES)
    )
    lines = F.filter(
        F.split(content, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != ""
    )
    rows = df.select(
        F.col(key).cast("long").alias(key),
        words.alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(content, F.lit(SYMBOLS)).alias("n_symbols"),
        F.regexp_count(content, F.lit(r"\p{Lu}")).alias("n_capitals"),
    )
    starts = F.when(
        F.size("_words") >= WINDOW, F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))
    ).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))
    rows = rows.select(
        key,
        F.size("_words").alias("n_words"),
        F.length(F.array_join("_words", "")).alias("word_chars"),
        "n_symbols",
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        "n_capitals",
        hashes.alias("_hashes"),
    )
    distinct = F.size(F.array_distinct("_hashes")) == F.size("_hashes")
    repeats = F.when(distinct, F.lit(0)).otherwise(_repeat_words(F.col("_hashes")))
    rows = rows.withColumn("n_repeat_words", repeats)
    return rows.select(key, *(F.col(m).cast("long").alias(m) for m in MEASURES))


def ledger(measured: DataFrame) -> DataFrame:
    """The measurements with `failures`: bit k is set where rule k fails."""
    bits = [
        F.when(rule(), F.lit(1 << BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()
    ]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failures", total.cast("long"))


def fails(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) != 0


def apply_policies(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """One verdict column `kept_<version>` per policy."""
    return entries.select("*", *((~fails(p)).alias(f"kept_{p.version}") for p in policies))


def ablation(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """(rule, failed, only): texts that fail a rule, and those that only this rule removes."""
    applied = F.col("failures").bitwiseAND(F.lit(policy.mask))
    # Groups of equal bits first: at most 2 ** rules of them, whatever the number of texts.
    groups = entries.groupBy(applied.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(
        *(F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit"))
          for r in policy.rules)
    )
    each = groups.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only"),
    )


def quality(
    df: DataFrame, policy: Policy = CURRENT, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Measurements, failure bits, the base verdict and the policy's."""
    entries = ledger(measure(df, text, key))
    base_failed = fails(BASE)
    return entries.select(
        key,
        *MEASURES,
        "failures",
        base_failed.alias("base_failed"),
        (~base_failed & ~fails(policy)).alias("kept"),
    )
