"""Quality classifier by weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Labellers look at a whole text and vote bad, good or abstain; they overlap, and none is right alone. A two-class latent
model with votes that are independent given the class is fitted by expectation-maximisation to the counts of vote
patterns over all texts; it estimates each labeller's rates under either class, and so the posterior of each pattern. No
gold label is used.

Posteriors are the soft labels of a logistic scorer on hashed features: relative frequencies of byte trigrams, and
buckets of the statistics that the labellers use. It is fitted on a bounded sample, about TRAIN_ROWS rows drawn by a
hash of id and text, and then scores every text.

Defined results: a null text counts as empty; texts of fewer than FEW words get only abstentions from labellers about
words. Without a text on which a labeller votes, the posterior is the prior. An empty table gives no row. Ids may repeat
or be null. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import starmap
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import as_rows, claim, map_arrow, of_rows, slices, table

SLICE_BYTES = 8 << 20
#: The expected number of rows that the scorer is fitted on; twice as many at most.
TRAIN_ROWS = 6_000
DIMS = 4096
ROUNDS = 300
FEW = 12

#: (statistic, good up to, bad from); between them a labeller abstains.
LABELLERS = (
    ("symbols", 0.010, 0.03),
    ("capitals", 0.12, 0.35),
    ("shouts", 0.02, 0.10),
    ("bars", 0.005, 0.05),
    ("top_word", 0.13, 0.22),
    ("echoes", 0.03, 0.10),
    ("sameness", 0.45, 0.62),
    ("same_lines", 0.12, 0.30),
    ("odd_signs", 0.22, 0.27),
    ("long_words", 7.4, 8.6),
)
ABSTAIN, GOOD, BAD = 0, 1, 2
#: Upper borders of the buckets that statistics are cut into for the scorer, as shares of the span good..bad.
CUTS = np.array([-1.0, -0.5, 0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 3.0])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+<=>@[\\]^_`{|}~")] = True
_GROUPS = np.zeros((256, 7))  # capitals, letters, symbols, '!', '|', white space, digits
for _b in range(256):
    _c = chr(_b)
    _GROUPS[_b] = ("A" <= _c <= "Z", _c.isascii() and _c.isalpha() or _b >= 0xC0, _SYMBOL[_b], _c == "!", _c == "|", _c in " \t\n\x0b\x0c\r", "0" <= _c <= "9")


def statistics(text: str, raw: np.ndarray) -> list[float | None]:
    """In the order of LABELLERS; None where the text is too short to tell."""
    n_bytes = len(raw)
    capitals, letters, symbols, shouts, bars, space, digits = (np.bincount(raw, minlength=256) @ _GROUPS).tolist()
    words = text.split()
    n = len(words)
    if not n:
        return [None] * len(LABELLERS)
    shown = n_bytes - space
    out: list[float | None] = [symbols / shown, capitals / letters if letters >= 20 else None, shouts / n, bars / n]
    if n < FEW:
        out += [None, None, None]
    else:
        count = Counter(words)
        out += [
            max(count.values()) / n if n >= 25 else None,
            sum(starmap(eq, zip(words, words[1:], strict=False))) / (n - 1),
            1.0 - len(count) / n if n >= 40 else None,
        ]
    lines = [x for x in text.split("\n") if x]
    out.append(1.0 - len(set(lines)) / len(lines) if len(lines) >= 4 else None)
    continuing = int(np.count_nonzero((raw & 0xC0) == 0x80))
    told = shown - continuing - digits
    out.append(1.0 - letters / told if told >= 40 else None)
    out.append(len(text) / n if n >= FEW else None)
    return out


def votes(values: list[float | None]) -> int:
    """All votes as one number, two bits each."""
    out = 0
    for i, (x, (_, good, bad)) in enumerate(zip(values, LABELLERS, strict=True)):
        if x is not None:
            out |= (BAD if x >= bad else GOOD if x <= good else ABSTAIN) << 2 * i
    return out


def buckets(values: list[float | None]) -> list[int]:
    """Hashed feature of each statistic's bucket."""
    out = []
    for i, (x, (_, good, bad)) in enumerate(zip(values, LABELLERS, strict=True)):
        k = len(CUTS) + 1 if x is None else int(np.searchsorted(CUTS, (x - good) / (bad - good)))
        out.append(((i * 64 + k + 1) * 2654435761 >> 7) % DIMS)
    return out


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashed features of a text's byte trigrams."""
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    b = raw.astype(np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 12)


class WeakModel:
    """Class prior and vote rates [class, labeller, vote]; class 1 is bad."""

    def __init__(self, patterns: dict[int, int]):
        n = len(LABELLERS)
        codes = np.array(sorted(patterns), np.int64)
        weight = np.array([patterns[c] for c in codes.tolist()], float)
        vote = (codes[:, None] >> 2 * np.arange(n)) & 3
        bad = (vote == BAD).any(axis=1)
        p = np.where(bad, 0.9, 0.02)  # start: one voice against a text
        for _ in range(200):
            q = np.stack([1 - p, p]) * weight
            total = q.sum(axis=1)
            self.prior = (total + 1) / (total.sum() + 2)
            rates = np.stack([[(q[c][:, None] * (vote == v)).sum(axis=0) for v in range(3)] for c in (0, 1)])  # class, vote, labeller
            smooth = np.array([[1.0, 1.0, 0.05], [1.0, 1.0, 1.0]])[:, :, None]
            self.rates = (rates + smooth) / (rates + smooth).sum(axis=1, keepdims=True)
            new = self._posterior(vote)
            done = np.abs(new - p).max(initial=0) < 1e-9
            p = new
            if done:
                break

    def _posterior(self, vote: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)[:, None] + np.zeros((2, len(vote)))
        for c in (0, 1):
            for i in range(vote.shape[1]):
                v = vote[:, i]  # an abstention says nothing
                logs[c] += np.where(v == ABSTAIN, 0.0, np.log(self.rates[c, v, i] / self.rates[c, 1:, i].sum()))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))

    def posterior(self, pattern: int) -> float:
        return float(self._posterior(np.array([[pattern >> 2 * i & 3 for i in range(len(LABELLERS))]]))[0])


def _read(text: str | None) -> tuple[str, np.ndarray]:
    text = text or ""
    return text, np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def vote_patterns(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """pattern -> number of texts, over all rows; at most 3 ** len(LABELLERS) patterns."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches):
        claim()
        count: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                count.update(votes(statistics(*_read(t))) for t in part.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], names=["p", "n"])

    return {r.p: r.n for r in map_arrow(rows, run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()}


def train_scorer(docs: DataFrame, weak: WeakModel, total: int, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights [DIMS + 1], the last is the offset; fitted by one task on a bounded sample."""
    text = F.col(text_col).cast("string").alias("text")
    chosen = F.pmod(F.xxhash64(F.col(id_col), text, F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, TRAIN_ROWS / max(1, total)))
    rows = docs.filter(chosen).select(text)

    def features(batches):
        claim()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                x, y = [], []
                for t in part.column("text").to_pylist():
                    t, raw = _read(t)
                    values = statistics(t, raw)
                    at = trigrams(raw)
                    row = np.bincount(at, minlength=DIMS).astype(np.float32) * np.float32(SCALE / max(1, len(at)))
                    row[buckets(values)] += 1
                    x.append(row.astype("<f4").tobytes())
                    y.append(weak.posterior(votes(values)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.float64())], names=["x", "y"])

    def fit(batches):
        claim()
        xs, ys = [], []
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if len(ys) < 2 * TRAIN_ROWS:
                    xs.append(np.frombuffer(x, "<f4"))
                    ys.append(y)
        yield pa.RecordBatch.from_arrays([pa.array([gradient_fit(np.stack(xs), np.array(ys)).tobytes()] if ys else [], pa.binary())], names=["w"])

    got = map_arrow(map_arrow(rows, features, "x binary, y double").repartition(1), fit, "w binary").collect()
    return np.frombuffer(got[0].w) if got else np.zeros(DIMS + 1)


#: Weight of the trigram part against the buckets.
SCALE = 10.0


def gradient_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps."""
    n = len(y)
    norm = float(np.einsum("ij,ij->i", x, x).max()) + 1
    rate = 4 / norm
    w = np.zeros(DIMS + 1)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[-1] = np.log(base / (1 - base))
    v, last = w.copy(), w.copy()
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:-1].astype(np.float32) + v[-1], -50, 50)))
        g = np.append(x.T @ (p - y).astype(np.float32) / n + ridge * v[:-1], (p - y).mean())
        w = v - rate * g
        v = w + t / (t + 3) * (w - last)
        last = w
    return w


def score(docs: DataFrame, weights: np.ndarray, weak: WeakModel, text_col: str = "text") -> DataFrame:
    """(row, quality, weak): the rows of ``docs`` as structs, the scorer's probability that a text is good, and the posterior's."""
    rows = as_rows(docs, text_col)
    flat = weights.astype(np.float32)

    def run(batches):
        claim()
        memory: dict[int, float] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                good, seen = [], []
                for t in part.column("text").to_pylist():
                    t, raw = _read(t)
                    values = statistics(t, raw)
                    at = trigrams(raw)
                    z = float(flat[at].sum(dtype=np.float64)) * SCALE / max(1, len(at)) + float(weights[-1])
                    z += sum(float(weights[b]) for b in set(buckets(values)))
                    good.append(1 / (1 + np.exp(min(60.0, max(-60.0, z)))))
                    pattern = votes(values)
                    if pattern not in memory:
                        memory[pattern] = 1 - weak.posterior(pattern)
                    seen.append(memory[pattern])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(good, pa.float64()), pa.array(seen, pa.float64())], names=["row", "quality", "weak"])

    return map_arrow(rows, run, StructType([rows.schema["row"], StructField("quality", DoubleType()), StructField("weak", DoubleType())]))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, WeakModel]:
    patterns = vote_patterns(docs, text_col)
    weak = WeakModel(patterns)
    return train_scorer(docs, weak, sum(patterns.values()), id_col, text_col), weak


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, quality (0 to 1, higher: better), weak, keep (quality >= 0.5)."""
    weights, weak = fit(docs, id_col, text_col)
    scored = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), weights, weak)
    return scored.select(F.col("row").getField("id").alias(id_col), "quality", "weak", (F.col("quality") >= 0.5).alias("keep"))


def good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with their columns."""
    weights, weak = fit(docs, id_col, text_col)
    return of_rows(score(docs, weights, weak, text_col).filter("quality >= 0.5"), docs.columns)


def query(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


SQL = None
