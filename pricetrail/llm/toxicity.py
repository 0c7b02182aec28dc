"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; the last is the overall label. A later model sees the
word-stem features and the probabilities of all earlier categories. It is trained on their out-of-fold
predictions, so that it meets in training what it will meet in use; the models that are applied are fitted
on the whole sample.

The given labels say only whether a text is toxic. Earlier categories are weak labels: toxic texts that
hold a seed word of the category. Features are word stems (opening letters of words) that occur
significantly more often in toxic texts of the sample; the sample, chosen by hash, has at most SAMPLE texts
of either class. A text is read in half overlapping passages of PASSAGE characters that together cover it, and
stands for itself by the passage whose stems speak most for toxic, in training and in use. As the most
toxic of many passages is more toxic by chance, its odds are divided by the number of passages. The decision
threshold maximises F1 of the out-of-fold predictions, so divided, at the class sizes of all labels. Every
text is scored whole in one scan without a shuffle.

Null text counts as empty; rows are independent, so repeated rows and null ids are kept. Of several labels
of one id the highest counts; null labels and labels without a document are left out. Without labels of
both classes nothing is learnt and no text is toxic. Other columns are not read.
"""

import re
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import Batches, WorkFolder, by_rows

#: Labelled texts of either class to learn from.
SAMPLE = 4000
STEMS = range(4, 9)
FEATURES = 256
#: A stem is a feature from this many toxic texts, and this chi-square (one degree of freedom) on.
LEAST_TEXTS, LEAST_CHI2 = 5, 30.0
FOLDS = 5
#: Characters of a passage; passages start at every half of one.
PASSAGE = 2000

#: Seed words of the categories that come before the overall label.
CATEGORIES = {
    "insult": ("clown", "idiot", "loser", "moron", "stupid"),
    "contempt": ("disgusting", "pathetic", "worthless"),
    "dehumanising": ("scum", "trash"),
}
OVERALL = "toxic"

_WORD = re.compile(r"[^\W\d_]+")


def stems(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {w[:n] for w in words for n in STEMS if len(w) >= n}


@dataclass
class Chain:
    names: list[str]
    features: list[str]
    #: Per category: weights of the features and of the earlier categories, then the constant.
    weights: list[np.ndarray]
    threshold: float
    #: How much each feature speaks for toxic when passages are compared; alike if not given.
    loud: list[float] | None = None

    def automaton(self) -> "ahocorasick.Automaton":
        search = ahocorasick.Automaton()
        for k, stem in enumerate(self.features):
            search.add_word(stem, (k, len(stem)))
        if self.features:
            search.make_automaton()
        return search

    def present(self, text: str, search: "ahocorasick.Automaton") -> tuple[list[int], int]:
        """Features whose stem opens a word of the loudest passage, and the number of passages."""
        text = text.lower()
        half = PASSAGE // 2
        passages = max(-(-len(text) // half) - 1, 1)
        if not self.features or not text:
            return [], passages
        found: dict[int, set[int]] = {}
        for end, (k, size) in search.iter(text):
            before = end - size
            if before < 0 or not _WORD.match(text[before]):
                cell = (before + 1) // half
                # A cell of half a passage belongs to the passage before it and to its own.
                for passage in {max(cell - 1, 0), min(cell, passages - 1)}:
                    found.setdefault(passage, set()).add(k)
        if not found:
            return [], passages
        loud = self.loud or [1.0] * len(self.features)
        return list(max(found.items(), key=lambda f: (sum(loud[k] for k in f[1]), -f[0]))[1]), passages

    def verdicts(self, texts: Iterable[str | None], search: "ahocorasick.Automaton") -> np.ndarray:
        """A row of probabilities per text; the last is that of the whole text."""
        seen = [self.present(text or "", search) for text in texts]
        x = np.zeros((len(seen), len(self.features)))
        for k, (found, _) in enumerate(seen):
            x[k, found] = 1
        p = self.probabilities(x)
        p[:, -1] = among(p[:, -1], np.array([n for _, n in seen]))
        return p

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column per category, each computed from the features and the columns before it."""
        out = np.zeros((len(x), 0))
        for weights in self.weights:
            out = np.column_stack([out, predict(np.column_stack([x, out]), weights)])
        return out


def among(p: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Probabilities with their odds divided by the number of passages."""
    return p / (p + passages * (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def predict(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ weights[:-1] + weights[-1])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-5, steps: int = 200) -> np.ndarray:
    """Penalised logistic regression by accelerated gradient steps."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    y = y.astype(np.float32)
    # The loss curves by at most a quarter of the largest eigenvalue of the second moments.
    scale = np.float32(4 / (np.linalg.norm(x.T @ x / len(x), 2) + 4 * penalty))
    weights = ahead = np.zeros(x.shape[1], np.float32)
    keep = np.append(np.ones(x.shape[1] - 1, np.float32), np.float32(0))
    for k in range(steps):
        gradient = x.T @ (_sigmoid(x @ ahead) - y) / len(x) + np.float32(penalty) * keep * ahead
        following = ahead - scale * gradient
        ahead = following + np.float32(k / (k + 3)) * (following - weights)
        weights = following
    return weights.astype(float)


def train(
    x: np.ndarray, labels: dict[str, np.ndarray], folds: np.ndarray
) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of the chain, and the out-of-fold probabilities of the last category."""
    earlier, weights = np.zeros((len(x), 0)), []
    out = np.zeros(len(x))
    for y in labels.values():
        seen = np.column_stack([x, earlier])
        out = np.zeros(len(x))
        for fold in range(FOLDS):
            rest, held = folds != fold, folds == fold
            if rest.any() and held.any():
                out[held] = predict(seen[held], logistic(seen[rest], y[rest]))
        weights.append(logistic(seen, y))
        earlier = np.column_stack([earlier, out])
    return weights, out


def best_threshold(p: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The probability that parts the classes at the highest F1, midway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((weight * toxic)[order])
    called = np.cumsum(weight[order])
    score = 2 * hits / (called + (weight * toxic).sum())
    # Only between different probabilities.
    ends = np.flatnonzero(np.diff(p[order], append=-1.0) < 0)
    at = ends[np.argmax(score[ends])]
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def fit(
    df: DataFrame,
    labels: DataFrame,
    work: WorkFolder,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> Chain | None:
    """The chain learnt from a bounded sample of labelled texts; None without both classes."""
    given = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).cast("long").alias(key))
        .agg((F.max(F.col(label).cast("int")) > 0).alias("_toxic"))
    )
    given = work.write(given, "labels")
    sizes = {row["_toxic"]: row["n"] for row in
             given.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    chosen = None
    for toxic in (True, False):
        part = given.where(F.col("_toxic") == toxic).orderBy(F.xxhash64(key), key).limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    chosen = work.write(chosen, "chosen")
    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    # At most 2 * sample ids: small enough for every task, whatever the size of the tables.
    texts = rows.join(F.broadcast(chosen), key)
    texts = work.write(texts.select(key, "_toxic", "_text"), "sample")

    def count(batches: Batches) -> Batches:
        counts: dict[str, list[int]] = {}
        n = [0, 0]
        for batch in batches:
            for toxic, value in zip(batch.column("_toxic").to_pylist(), batch.column("_text")):
                n[toxic] += 1
                for stem in stems(value.as_py() or ""):
                    counts.setdefault(stem, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *counts], pa.string()),
             pa.array([n[0], *(c[0] for c in counts.values())], pa.int64()),
             pa.array([n[1], *(c[1] for c in counts.values())], pa.int64())],
            names=["stem", "clean", "toxic"],
        )

    counts = texts.mapInArrow(count, "stem string, clean long, toxic long").groupBy("stem")
    counts = work.write(
        counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "stems"
    )
    totals = counts.where("stem = ''").first()
    if totals is None or not totals.clean or not totals["toxic"]:
        return None
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n, m = float(totals["toxic"]), float(totals.clean)
    chi2 = (
        (n + m) * F.pow(a * (m - b) - b * (n - a), 2) / (n * m * (a + b) * (n + m - a - b + 1))
    )
    best = (
        counts.where((F.col("stem") != "") & (a >= LEAST_TEXTS) & (a * m > b * n))
        .select("stem", chi2.alias("chi2"), F.log(a * (m + 1) / ((b + 1) * n)).alias("loud"))
        .where(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "stem")
        .limit(FEATURES)
    )
    best = best.collect()
    chain = Chain([*CATEGORIES, OVERALL], [row.stem for row in best], [], 1.0,
                  [max(row.loud, 0.0) for row in best])

    def mark(batches: Batches) -> Batches:
        search = chain.automaton()
        for batch in batches:
            found, passages, seeds = [], [], []
            for value in batch.column("_text"):
                content = value.as_py() or ""
                stems_found, n = chain.present(content, search)
                found.append(stems_found)
                passages.append(n)
                words = set(_WORD.findall(content.lower()))
                seeds.append([not words.isdisjoint(s) for s in CATEGORIES.values()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("_toxic"),
                 pa.array(found, pa.list_(pa.int32())), pa.array(passages, pa.int64()),
                 pa.array(seeds, pa.list_(pa.bool_()))],
                names=[key, "_toxic", "found", "passages", "seeds"],
            )

    marked = texts.mapInArrow(
        mark,
        f"`{key}` long, _toxic boolean, found array<int>, passages long, seeds array<boolean>",
    )
    # A repeated document is one example, so that its copies do not stand on both sides of a fold.
    data = sorted(marked.dropDuplicates([key]).collect(), key=lambda row: row[key])
    x = np.zeros((len(data), len(chain.features)))
    for k, row in enumerate(data):
        x[k, row.found] = 1
    toxic = np.array([row["_toxic"] for row in data], bool)
    marks = {
        name: toxic & np.array([row.seeds[k] for row in data], bool)
        for k, name in enumerate(CATEGORIES)
    }
    folds = np.random.default_rng(0).permutation(len(data)) % FOLDS
    chain.weights, out = train(
        x, {k: v.astype(float) for k, v in (marks | {OVERALL: toxic}).items()}, folds
    )
    out = among(out, np.array([row.passages for row in data]))
    weight = np.where(toxic, sizes[True] / toxic.sum(), sizes[False] / (~toxic).sum())
    chain.threshold = best_threshold(out, toxic, weight)
    return chain


def score(
    df: DataFrame, chain: Chain | None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """`key`, a probability per category (null without a chain) and the verdict `toxic`."""
    names = [*CATEGORIES, OVERALL]
    columns = [f"p_{name}" for name in names]

    def run(batches: Batches) -> Batches:
        search = chain.automaton() if chain else None
        for batch in batches:
            if chain is None:
                p = np.full((len(batch), len(names)), np.nan)
                verdict = np.zeros(len(batch), bool)
            else:
                p = np.zeros((len(batch), len(names)))
                for at in range(0, len(batch), 1024):
                    values = batch.column("_text").slice(at, 1024)
                    texts = (value.as_py() for value in values)
                    p[at : at + len(values)] = chain.verdicts(texts, search)
                verdict = p[:, -1] >= chain.threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(p[:, k], from_pandas=True) for k in range(len(names))),
                 pa.array(verdict)],
                names=[key, *columns, "toxic"],
            )

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"{c} double" for c in columns)
    return rows.mapInArrow(run, f"`{key}` long, {kinds}, toxic boolean")


def toxicity(
    df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    chain = fit(df, labels, WorkFolder(df.sparkSession, "toxicity"), text, key)
    return score(df, chain, text, key)


def without_toxic(df: DataFrame, chain: Chain | None) -> DataFrame:
    """The documents that the chain does not call toxic, in one scan with all their columns."""
    if chain is None:
        return df

    def run(batches: Batches) -> Batches:
        search = chain.automaton()
        for batch in by_rows(batches):
            p = chain.verdicts((value.as_py() for value in batch.column("text")), search)
            yield batch.filter(pa.array(p[:, -1] < chain.threshold))

    return df.mapInArrow(run, df.schema)
