"""Secret scans: fixed patterns, and a character convolutional network over other candidates.

The fixed patterns give findings of three kinds (`assign`, `access`, `hex`). Every run of key characters
is a candidate; those that overlap a finding are labelled secret, the others not. A small convolutional
network, written in numpy, reads each candidate whole, with the text around it, in windows that overlap; the
one most like a secret counts. Characters of the candidate and of its surroundings are told apart, so that
a word beside a key is no key. It is trained on
all different labelled candidates, in parts whose weights are averaged after every pass; its logits are calibrated on a
third held out of them, and its threshold is
the highest that still finds the demanded share of held-out secrets, shown as they stand, without the text
before them, behind the text before another candidate, and behind a part of one; other candidates are also shown behind the text before
a secret. Candidates at
or above it that no finding covers wholly are added with the kind `model`; findings of the patterns always stay.

Whole texts are scanned, one at a time; nothing is shuffled. Null text counts as empty; rows are
independent, so repeated rows and null ids are kept as they are. Without candidates of both labels there
is nothing to learn and only the patterns report. Other columns are not read.
"""

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import Batches, WorkFolder, by_rows

#: What the patterns are and how long a match must be.
_ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
KINDS = ("assign", "access", "hex", "model")

_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_DIGIT = re.compile(r"[0-9]")

#: What the network sees at once: text before a part of a candidate, the part, text after it. Parts start
#: every STEP characters.
BEFORE, INSIDE, AFTER = 32, 48, 16
STEP = 24
WIDTH = BEFORE + INSIDE + AFTER
#: Windows that a kind of candidates (label, with or without a digit) counts for in training, at most.
EMPHASIS = 3000
#: Windows that one task trains on between two averages of the weights.
SHARD = 20_000
EPOCHS = 8
#: Windows of several texts that the network reads together, at least, when it looks for secrets.
TOGETHER = 2048
RECALL = 0.99

Span = tuple[int, int, int]


def key_runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each run of key characters."""
    return [run.span() for run in _RUN.finditer(text)]


def base_spans(text: str, within: list[tuple[int, int]] | None = None) -> list[Span]:
    """(start, end, kind) of the patterns' findings, ordered by start, then kind.

    `within`: the text's key runs, where they are known.
    """
    spans = []
    if "=" in text or ":" in text:
        spans += [
            (m.start(), m.end(), 0)
            for m in _ASSIGN.finditer(text)
            if m.end(1) - m.start(1) >= ASSIGN_CHARS
        ]
    if "AKIA" in text:
        spans += [
            (m.start(), m.end(), 1)
            for m in _ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_CHARS
        ]
    # Hex digits are key characters, and their runs are longer than the shortest key run.
    for start, end in key_runs(text) if within is None else within:
        if end - start >= HEX_CHARS:
            spans += [(m.start(), m.end(), 2) for m in _HEX.finditer(text, start, end)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def runs(
    text: str, spans: list[Span], within: list[tuple[int, int]] | None = None
) -> Iterator[tuple[int, int, list[Span]]]:
    """(start, end, overlapping findings) of each run of key characters."""
    k = 0
    for start, end in key_runs(text) if within is None else within:
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        # Later findings may start earlier than one that ends late: look on from the first open one.
        own, at = [], k
        while at < len(spans) and spans[at][0] < end:
            if spans[at][1] > start:
                own.append(spans[at])
            at += 1
        yield start, end, own


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int, bool]]:
    """(start, end, overlaps a finding) of each run of key characters."""
    return [(start, end, bool(own)) for start, end, own in runs(text, spans)]


def window(text: str, start: int, end: int) -> bytes:
    """A part of a candidate in its surroundings, one byte a character, at fixed places."""
    end = min(end, start + INSIDE)
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inside = text[start:end].ljust(INSIDE, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    shown = before + inside + after
    return shown.encode() if shown.isascii() else bytes(min(ord(c), 127) for c in shown)


def parts(start: int, end: int) -> range:
    """Where the windows of a candidate start; together they hold all of it."""
    return range(start, max(end - INSIDE + STEP, start + 1), STEP)


def example(text: str, start: int, end: int, spans: list[Span]) -> bytes:
    """The window that stands for a candidate in training: the first part with a finding in it, or the first."""
    first = min((max(a, start) for a, *_ in spans), default=start)
    places = parts(start, end)
    return window(text, places[min((first - start) // STEP, len(places) - 1)], end)


def judged(text: str, spans: list[Span], within: list[tuple[int, int]] | None = None) -> list[dict]:
    """The candidates as the network sees them: an example to learn from, and all windows to score."""
    found = []
    for start, end, own in runs(text, spans, within):
        whole = any(a <= start and end <= b for a, b, _ in own)
        scored = [] if whole else [window(text, at, end) for at in parts(start, end)]
        found.append({"start": start, "end": end, "found": bool(own),
                      "digit": bool(_DIGIT.search(text, start, end)),
                      "window": example(text, start, end, own) if own else scored[0],
                      "scored": b"".join(scored)})
    return found


# ---- network -----------------------------------------------------------------------------------


@dataclass
class Network:
    """Embedding, one convolution, maximum over places, and a logistic unit."""

    seed: int = 0
    size: int = 8
    filters: int = 24
    reach: int = 5
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0
    #: Of held-out windows, at the class sizes of all candidates.
    recall: float = 0.0
    precision: float = 0.0

    def __post_init__(self):
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            shapes = {"embed": (256, self.size), "conv": (self.reach * self.size, self.filters),
                      "bias": (self.filters,), "out": (self.filters,), "zero": (1,)}
            self.weights = {
                k: (rng.standard_normal(s) * (0 if k in ("bias", "zero") else 0.2)).astype("f4")
                for k, s in shapes.items()
            }

    def _embedding(self) -> np.ndarray:
        """The embedding of every code; nothing, code 0, lies at the origin."""
        table = self.weights["embed"].copy()
        table[0] = 0
        return table

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        n, width = codes.shape
        places, span = width - self.reach + 1, self.reach * self.size
        seen = np.take(self._embedding(), codes, axis=0).reshape(n, -1)
        # What the convolution sees at a place is one stretch of the embedded text.
        view = np.lib.stride_tricks.sliding_window_view(seen, span, axis=1)[:, :: self.size]
        maps = (view.reshape(n * places, span) @ w["conv"]).reshape(n, places, -1)
        best = maps.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(maps, best[:, None], 1)[:, 0] + w["bias"], 0)
        return pooled @ w["out"] + w["zero"][0], pooled, best

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[at : at + 512])[0] for at in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.zeros(0, "f4")

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * logits + self.shift)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(codes))

    def state(self) -> np.ndarray:
        """The weights, then Adam's means and squares, as one vector."""
        flat = np.concatenate([w.ravel() for w in self.weights.values()]).astype("f8")
        return np.concatenate([flat, np.zeros(2 * len(flat))])

    def load(self, state: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Take the weights from a state; returns Adam's part of it."""
        size, at, adam = len(state) // 3, 0, {}
        for k, w in self.weights.items():
            cells = [state[p + at : p + at + w.size].reshape(w.shape).astype("f4") for p in (0, size, 2 * size)]
            self.weights[k], adam[k], at = cells[0], (cells[1], cells[2]), at + w.size
        return adam

    def train_once(
        self, state: np.ndarray, codes: np.ndarray, labels: np.ndarray, share: np.ndarray,
        epoch: int = 0, rate: float = 0.01,
    ) -> np.ndarray:
        """The state after one pass of Adam over small batches in a fixed random order."""
        rng = np.random.default_rng([self.seed, epoch])
        adam = self.load(state)
        # Steps get smaller with every pass, so that the parts' weights come together.
        rate *= 1 - epoch / EPOCHS
        parts = np.array_split(rng.permutation(len(codes)), max(1, len(codes) // 64))
        for step, part in enumerate(parts, epoch * len(parts) + 1):
            for k, g in self._gradients(codes[part], labels[part], share[part]).items():
                mean, square = adam[k]
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                self.weights[k] -= (
                    rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
                ).astype("f4")
        flat = [[c.ravel() for c in cells] for cells in
                zip(*((w, *adam[k]) for k, w in self.weights.items()))]
        return np.concatenate([np.concatenate(cells) for cells in flat]).astype("f8")

    def _gradients(
        self, codes: np.ndarray, labels: np.ndarray, share: np.ndarray | float = 1.0
    ) -> dict[str, np.ndarray]:
        w, (reach, size, filters) = self.weights, (self.reach, self.size, self.filters)
        logit, pooled, best = self._forward(codes)
        error = (_sigmoid(logit) - labels) * share / len(codes)
        to_pool = error[:, None] * w["out"] * (pooled > 0)
        # Both layers below are linear in the characters at the best places: errors are summed by character,
        # place in the reach and filter, and meet the weights as one small table.
        at = (best[:, :, None] + np.arange(reach)).reshape(len(codes), -1)
        cell = np.take_along_axis(codes, at, 1).reshape(-1, filters, reach).astype(np.intp)
        cell = (cell * reach + np.arange(reach)) * filters + np.arange(filters)[:, None]
        sums = np.bincount(cell.ravel(), np.repeat(to_pool.ravel(), reach), len(w["embed"]) * reach * filters)
        sums = sums.astype(w["conv"].dtype).reshape(-1, reach * filters)
        conv = (self._embedding().T @ sums).reshape(size, reach, filters)
        by_place = w["conv"].reshape(reach, size, filters).transpose(0, 2, 1)
        embed = sums @ by_place.reshape(reach * filters, size)
        embed[0] = 0
        return {"out": pooled.T @ error, "zero": error.sum(keepdims=True),
                "conv": conv.transpose(1, 0, 2).reshape(w["conv"].shape),
                "bias": to_pool.sum(0), "embed": embed}

    def calibrate(
        self,
        codes: np.ndarray,
        labels: np.ndarray,
        recall: float,
        shown: np.ndarray | None = None,
        weight: np.ndarray | None = None,
    ):
        """Fit slope and shift of the logits by Newton steps, then place the threshold.

        Recall is kept in every one of the ways in which windows are `shown`; `weight` is how many
        candidates a window stands for.
        """
        z = self.logits(codes).astype(float)
        weight = np.ones(len(z)) if weight is None else weight
        positives = max(labels.sum(), 1)
        # Smoothed targets keep the fit finite where the labels separate.
        target = np.where(
            labels, (positives + 1) / (positives + 2), 1 / (len(labels) - positives + 2)
        )
        x = np.stack([z, np.ones_like(z)], 1)
        beta = np.zeros(2)
        for _ in range(50):
            p = _sigmoid(x @ beta)
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
            beta += np.linalg.solve(hessian, x.T @ (weight * (target - p)))
        self.slope, self.shift = float(beta[0]), float(beta[1])
        p = self.probability(codes)
        shown = np.zeros(len(codes), int) if shown is None else shown
        points = []
        for way in np.unique(shown[labels]):
            secret = np.sort(p[labels & (shown == way)])[::-1]
            points.append(float(secret[max(int(np.ceil(recall * len(secret))), 1) - 1]))
        self.threshold = min(points, default=1.0)
        called = p >= self.threshold
        hits = weight[called & labels].sum()
        self.recall = float(hits / max(weight[labels].sum(), 1e-9))
        self.precision = float(hits / max(weight[called].sum(), 1e-9))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _codes(windows: list[bytes]) -> np.ndarray:
    """One code a character; those of the candidate itself lie above those of its surroundings."""
    codes = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH).copy()
    own = codes[:, BEFORE : BEFORE + INSIDE]
    own[own > 0] += 128
    return codes


def _shown(codes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, which row each shows, and ways.

    All as they stand (0), secrets without text before them (1), with that of others (2) and behind a part of
    others within one run (3), others with the text before secrets (4).
    """
    secrets, others = np.flatnonzero(labels), np.flatnonzero(~labels)
    bare, moved, beside = codes[secrets].copy(), codes[secrets].copy(), codes[others].copy()
    bare[:, :BEFORE] = 0
    joined = bare.copy()
    if len(others) and len(secrets):
        for k, other in enumerate(np.resize(others, len(joined))):
            # A run is read from every STEP characters on: a key starts at most that far in a window.
            open_, close = BEFORE + k % STEP, BEFORE + INSIDE
            joined[k, open_:close] = codes[secrets[k], BEFORE : close - k % STEP]
            joined[k, BEFORE:open_] = np.resize(codes[other, BEFORE : BEFORE + 12], k % STEP)
        moved[:, :BEFORE] = codes[np.resize(others, len(moved)), :BEFORE]
        beside[:, :BEFORE] = codes[np.resize(secrets, len(beside)), :BEFORE]
    rows = np.concatenate([np.arange(len(codes)), secrets, secrets, secrets, others])
    ways = np.repeat(range(5), [len(codes), *[len(secrets)] * 3, len(others)])
    return np.concatenate([codes, bare, moved, joined, beside]), rows, ways


def fit(scanned: DataFrame, emphasis: int = EMPHASIS, recall: float = RECALL) -> Network | None:
    """A network trained and calibrated on all different windows of the candidates.

    A kind of candidates, by label and digit, counts for at most `emphasis` windows in training, so that
    plenty of words do not drown few secrets; none is left out.
    """
    work = WorkFolder(scanned.sparkSession, "secret-scan-fit")
    one = scanned.select(F.explode("candidates").alias("c")).select("c.found", "c.digit", "c.window")
    # Different windows, not copies.
    windows = work.write(one.groupBy("found", "digit", "window").agg(F.count("*").alias("n")), "windows")
    kinds = {(k.found, k.digit): k.n for k in windows.groupBy("found", "digit").agg(F.count("*").alias("n")).collect()}
    if len({found for found, _ in kinds}) < 2:
        return None
    # Parts of about SHARD windows, and a third of each kind apart for calibration, by hash. Few windows
    # are cut as well: the mean of some parts' weights lies more steadily than one part's.
    order, n = F.xxhash64("window"), sum(kinds.values())
    shards = max(-(-n // SHARD), min(n // 500, 4), 1)
    share = F.coalesce(*(
        F.when((F.col("found") == found) & (F.col("digit") == digit), min(emphasis / n, 1.0))
        for (found, digit), n in kinds.items()
    ))
    cut = work.write(
        windows.select("found", "window", order.alias("order"), share.alias("share"),
                       F.pmod(order, F.lit(shards)).cast("int").alias("shard"),
                       (F.pmod(F.xxhash64(order, F.lit(1)), F.lit(3)) == 0).alias("held")),
        "cut",
    )
    held, rest = cut.where("held"), cut.where("NOT held")
    if held.where("found").isEmpty() or any(rest.where(F.col("found") == x).isEmpty() for x in (True, False)):
        held = rest = cut
    network = Network()
    state = network.state()
    for epoch in range(EPOCHS):
        state = _mean_state(rest.groupBy("shard").applyInArrow(_epoch(network, state, epoch), _STATE), state)
    network.load(state)
    shown = work.write(held.groupBy("shard").applyInArrow(_judge(network), _SHOWN), "shown")
    _calibrate(network, shown, recall)
    return network


_STATE = "n double, state array<double>"
_SHOWN = "z double, found boolean, way int, weight double"


def _shard(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and shares of a part's windows, in an order that does not depend on the tasks."""
    rows = table.sort_by([("order", "ascending"), ("window", "ascending"), ("found", "ascending")])
    return (_codes(rows.column("window").to_pylist()), np.array(rows.column("found").to_pylist(), bool),
            rows.column("share").to_numpy())


def _epoch(network: Network, state: np.ndarray, epoch: int) -> Callable[[pa.Table], pa.Table]:
    """One pass over a part's windows, from the weights that all parts share."""

    def run(table: pa.Table) -> pa.Table:
        codes, labels, share = _shard(table)
        own = Network(network.seed, network.size, network.filters, network.reach)
        # Secrets are also shown without what stands before them, so that the network learns how secrets
        # look, not only the words that the patterns know.
        every, at, _ = _shown(codes, labels)
        after = own.train_once(state, every, labels[at].astype("f4"), share[at].astype("f4"), epoch)
        return pa.table([pa.array([float(len(codes))]), pa.array([after.tolist()], pa.list_(pa.float64()))],
                        names=["n", "state"])

    return run


def _mean_state(parts: DataFrame, before: np.ndarray) -> np.ndarray:
    """The parts' states averaged; sums of whole numbers do not depend on the order of the parts."""
    cells = parts.select("n", F.posexplode("state").alias("k", "x"))
    # Fine steps: Adam's squares are tiny, and divide.
    total = F.sum((F.col("n") * F.col("x") * float(1 << 70)).cast("decimal(38,0)")).cast("double")
    mean = np.empty_like(before)
    for row in cells.groupBy("k").agg((total / F.sum("n") / float(1 << 70)).alias("x")).collect():
        mean[row.k] = row.x
    return mean


def _judge(network: Network) -> Callable[[pa.Table], pa.Table]:
    """Logits of a part's held-out windows in all ways in which they are shown."""

    def run(table: pa.Table) -> pa.Table:
        codes, labels, _ = _shard(table)
        every, at, ways = _shown(codes, labels)
        weight = 1 / np.bincount(at)[at]
        return pa.table([network.logits(every).astype("f8"), labels[at], ways.astype("i4"), weight],
                        names=["z", "found", "way", "weight"])

    return run


def _calibrate(network: Network, shown: DataFrame, recall: float) -> None:
    """As `Network.calibrate`, by sums over all held-out windows."""
    n, positives = shown.agg(F.count("*"), F.count_if("found")).head()
    target = F.when(F.col("found"), (max(positives, 1) + 1) / (max(positives, 1) + 2)).otherwise(
        1 / (n - max(positives, 1) + 2)
    )
    z, weight, beta = F.col("z"), F.col("weight"), np.zeros(2)

    def probability(slope: float, shift: float) -> Column:
        y = F.least(F.greatest(F.lit(slope) * z + F.lit(shift), F.lit(-30.0)), F.lit(30.0))
        return 1 / (1 + F.exp(-y))

    for _ in range(50):
        p = probability(*map(float, beta))
        curve, slope = weight * p * (1 - p), weight * (target - p)
        a, b, c, d, e = shown.agg(*map(F.sum, (curve * z * z, curve * z, curve, slope * z, slope))).head()
        step = np.linalg.solve(np.array([[a, b], [b, c]]) + 1e-6 * np.eye(2), np.array([d, e]))
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    network.slope, network.shift = float(beta[0]), float(beta[1])
    # The places of the threshold are exact: windows are counted in steps of the logit, then one is looked up.
    sign = 1.0 if network.slope >= 0 else -1.0
    found = shown.where("found").select("way", (z * sign).alias("z"))
    found = found.withColumn("step", F.floor(F.col("z") * 16))
    counts, points = {}, []
    for row in found.groupBy("way", "step").count().orderBy(F.desc("step")).collect():
        counts.setdefault(row.way, []).append((row.step, row["count"]))
    for way, steps in counts.items():
        left = max(int(np.ceil(recall * sum(c for _, c in steps))), 1) - 1
        for step, many in steps:
            if left < many:
                there = found.where((F.col("way") == way) & (F.col("step") == step))
                points.append(there.orderBy(F.desc("z")).offset(left).limit(1).head().z * sign)
                break
            left -= many
    point = min((network.slope * z + network.shift, z) for z in points)[1]
    network.threshold = float(network.calibrated(np.float32([point]))[0])
    called = z * sign >= point * sign
    hits, secrets, calls = shown.agg(
        F.sum(F.when(called & F.col("found"), weight).otherwise(0.0)),
        F.sum(F.when(F.col("found"), weight).otherwise(0.0)),
        F.sum(F.when(called, weight).otherwise(0.0)),
    ).head()
    network.recall, network.precision = hits / max(secrets, 1e-9), hits / max(calls, 1e-9)


# ---- scan --------------------------------------------------------------------------------------


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row the patterns' findings, and the candidates as the network sees them."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])
    seen = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("found", pa.bool_()),
                      ("digit", pa.bool_()), ("window", pa.binary()), ("scored", pa.binary())])

    def run(batches: Batches) -> Batches:
        for batch in by_rows(batches):
            spans, others = [], []
            for value in batch.column("_text"):
                content = value.as_py() or ""
                within = key_runs(content)
                found = base_spans(content, within)
                spans.append(found)
                others.append(judged(content, found, within))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), _lists(spans, span), _lists([map(dict.values, o) for o in others], seen)],
                names=[key, "spans", "candidates"],
            )

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(
        run,
        f"`{key}` long, spans array<struct<start:int,end:int,kind:int>>, "
        "candidates array<struct<start:int,end:int,found:boolean,digit:boolean,window:binary,"
        "scored:binary>>",
    )


def _lists(rows: list, kind: pa.StructType) -> pa.ListArray:
    """Lists of structs from the values of their fields, column by column."""
    rows = [list(row) for row in rows]
    columns = list(zip(*(values for row in rows for values in row))) or [()] * kind.num_fields
    cells = pa.StructArray.from_arrays(
        [pa.array(c, field.type) for c, field in zip(columns, kind)], fields=list(kind)
    )
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype="i4"), cells)


def added_spans(found: list[dict], network: Network | None) -> list[Span]:
    """Candidates that the network holds for secrets and no finding covers wholly."""
    return next(added_by_text([found], network))


def added_by_text(texts: Iterable[list[dict]], network: Network | None) -> Iterator[list[Span]]:
    """`added_spans` of each text; the network reads the candidates of many texts together."""
    waiting, windows = [], 0
    for found in texts:
        free = [c for c in found if c["scored"]]
        waiting.append(free)
        windows += sum(len(c["scored"]) for c in free) // WIDTH
        if windows >= TOGETHER:
            yield from _added(waiting, network)
            waiting, windows = [], 0
    yield from _added(waiting, network)


def _added(texts: list[list[dict]], network: Network | None) -> list[list[Span]]:
    free = [c for found in texts for c in found]
    if network is None or not free:
        return [[] for _ in texts]
    sure = network.probability(_codes([c["scored"] for c in free])) >= network.threshold
    sizes = np.array([len(c["scored"]) // WIDTH for c in free])
    some = iter(np.logical_or.reduceat(sure, np.cumsum(sizes) - sizes))
    return [[(c["start"], c["end"], 3) for c, yes in zip(found, islice(some, len(found))) if yes]
            for found in texts]


def _scored(candidates: pa.ListArray) -> Iterator[list[dict]]:
    """Per text the candidates with what `added_spans` reads of them."""
    cells, sizes = candidates.flatten(), candidates.value_lengths().to_pylist()
    starts, ends = (cells.field(name).to_pylist() for name in ("start", "end"))
    rows = zip(starts, ends, cells.field("scored"))
    for n in sizes:
        yield [{"start": a, "end": b, "scored": scored.as_py()} for a, b, scored in islice(rows, n)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def report(scanned: DataFrame, network: Network | None, key: str = "doc_id") -> DataFrame:
    """Counts of the patterns' findings, their digest, and all spans with those added."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = [[], [], [], [], []]
            added = added_by_text(_scored(batch.column("candidates")), network)
            for spans, more in zip(batch.column("spans"), added):
                base = [(s["start"], s["end"], s["kind"]) for s in spans.as_py()]
                every = sorted(base + more, key=lambda s: (s[0], s[2]))
                for k in range(3):
                    out[k].append(sum(s[2] == k for s in base))
                out[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[4].append(_joined(every))
            names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            columns = [pa.array(c, pa.int64()) for c in out[:3]]
            columns += [pa.array(c, pa.string()) for c in out[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=names)

    return scanned.mapInArrow(
        run,
        f"`{key}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def find_secrets(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    work = WorkFolder(df.sparkSession, "secret-scan")
    scanned = work.write(scan(df, text, key), "scanned")
    return report(scanned, fit(scanned), key)


def redact(df: DataFrame, network: Network | None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by a mark; `n_chars` follows the new text."""
    schema = df.schema

    def run(batches: Batches) -> Batches:
        for batch in by_rows(batches):
            texts = []
            contents = [(value.as_py(), key_runs(value.as_py() or "")) for value in batch.column("text")]
            found = [base_spans(content or "", within) for content, within in contents]
            seen = (judged(text or "", base, within) for (text, within), base in zip(contents, found))
            for (content, _), base, more in zip(contents, found, added_by_text(seen, network)):
                if content:
                    parts, at = [], 0
                    for start, end, _ in sorted(base + more):
                        if start >= at:
                            parts += [content[at:start], mark]
                        at = max(at, end)
                    content = "".join([*parts, content[at:]])
                texts.append(content)
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, "text", pa.array(texts, pa.string()))

    out = df.mapInArrow(run, schema)
    if "n_chars" in df.columns:
        changed = F.length("text").cast(schema["n_chars"].dataType)
        out = out.withColumn("n_chars", changed).select(df.columns)
    return out
