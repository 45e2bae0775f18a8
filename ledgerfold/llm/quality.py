"""Operator 10: quality rules.

assess(docs, model) counts what the base rules need over whole texts and scores every text with a logistic regression
on hashed word and character n-grams, in Arrow batches; the probability is calibrated and held against a fixed
threshold. train() fits the model on at most `sample` labelled rows (those of the smallest hashed ids): three in four
fit the weights, the fourth the calibration (Platt's two parameters).

Words are runs of non-white-space (space and U+0009 to U+000D). Null and empty texts have no words, fail the base rule
and score as the intercept says. Null ids and repeated rows stay rows of their own. Without labels of both kinds the
model is neutral: every text scores 1/2 and passes. Empty tables give empty tables; texts may be of any length. Extra
columns are ignored. Documents are not shuffled; the sampled
ids (at most `sample`) and the weights (1 << bits numbers, twice) are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import to_workers
from .common import map_batches, map_columns, picked, type_of, written
from .hashing import word_hashes

SAMPLE, BITS, THRESHOLD = 4_000, 14, 0.5
#: Tasks that share the sample; steps of the optimiser, at most; ridge.
PARTS, ROUNDS, DECAY = 8, 30, 1e-3
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Features are shares of a text; the scale gives the optimiser numbers near one.
SCALE = 30.0
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines, seen = [x for x in text.split("\n") if x and x.strip(SPACES)], len(words)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        first, again = set(), set()
        for w in windows:
            (again if w in first else first).add(w)
        covered = -1
        for k, w in enumerate(windows):
            if w in again:
                repeated += k + 2 - max(covered, k - 1)
                covered = k + 2
    return seen, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def ngrams(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (two and four bytes of UTF-8) and hashed words of a text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    b = raw.astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    four = two[:-2] * np.uint32(0xC2B2AE35) + two[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    chars = np.concatenate([two, four]) >> np.uint32(32 - bits)
    return chars, (word_hashes(raw) >> np.uint64(64 - bits)).astype(np.uint32)


@dataclass
class Model:
    chars: np.ndarray
    words: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int = BITS

    def margin(self, text: str | None) -> float:
        c, w = ngrams(text, self.bits)
        return self.bias + SCALE * (float(self.chars[c].mean()) if len(c) else 0.0) + SCALE * (float(self.words[w].mean()) if len(w) else 0.0)

    def probability(self, text: str | None) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -30, 30))))


def neutral(bits: int = BITS) -> Model:
    return Model(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), 0.0, 1.0, 0.0, bits)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Of a labelled id that several rows have, the text of the smallest hash counts, so there are at most `sample` rows.
    Their hashed features are a table in the shared folder; each step of the optimiser is one job over it that brings a
    gradient from each of PARTS tasks, so the driver holds a few vectors of 2 << bits numbers, however long the texts."""
    known = picked(labels, k=id_col, y="quality").where(F.col("k").isNotNull() & F.col("y").isNotNull()).groupBy("k").agg(F.max("y").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = picked(docs, k=id_col, t=text_col).where(F.col("t") != "").join(F.broadcast(known), "k").withColumn("h", F.xxhash64("k", "t"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("h", "t"))).where("place = 1").select("h", "y", "t")

    def make():
        def step(hs, ys, texts):
            at, share = [], []
            for text in texts.to_pylist():
                ks, vs = [], []
                for start, x in zip((0, 1 << bits), ngrams(text, bits)):
                    u, n = np.unique(x, return_counts=True)
                    ks.append(u.astype(np.int32) + np.int32(start))
                    vs.append((n * (SCALE / max(1, len(x)))).astype(np.float32))
                at.append(np.concatenate(ks).tobytes())
                share.append(np.concatenate(vs).tobytes())
            return hs, ys, at, share

        return step

    got = map_batches(rows, ["h", "y", "t"], make, "h long, y int, at binary, share binary", [("h", pa.int64()), ("y", pa.int32()), ("at", pa.binary()), ("share", pa.binary())])
    got = written(got.repartition(PARTS, "h").sortWithinPartitions("h", "y").withColumn("fits", F.pmod("h", F.lit(4)) != 3), "quality-sample")
    counts = {(r["fits"], r["good"]): r["n"] for r in got.groupBy("fits", (F.col("y") > 0).alias("good")).agg(F.count("*").alias("n")).collect()}
    every = [sum(n for (_, good), n in counts.items() if good == kind) for kind in (False, True)]
    if not every[0] or not every[1]:
        return neutral(bits)
    alone = bool(counts.get((True, False)) and counts.get((True, True)))  # else all rows fit the weights
    w = descend(got.where("fits") if alone else got, 2 << bits, rounds)
    apart = alone and counts.get((False, False), 0) + counts.get((False, True), 0) >= 50
    points = margins(got.where("not fits") if apart else got, w)
    slope, shift = platt(points[:, 0], points[:, 1])
    return Model(w[: 1 << bits].astype(np.float32), w[1 << bits : -1].astype(np.float32), float(w[-1]), slope, shift, bits)


def sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, their shares, the row of each, and the labels of a batch of y, at, share."""
    at = [np.frombuffer(x.as_py(), np.int32) for x in batch.column(1)]
    share = [np.frombuffer(x.as_py(), np.float32) for x in batch.column(2)]
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    return np.concatenate(at), np.concatenate(share), row, (batch.column(0).to_numpy() > 0).astype(float)


def loss_and_gradient(rows: DataFrame, w: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss with a ridge over rows (y, at, share), and its gradient; the last weight is the bias."""
    given = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w, n, loss, g = given.value, 0, 0.0, np.zeros(len(given.value))
        for batch in batches:
            if not batch.num_rows:
                continue
            cols, vals, row, y = sparse(batch)
            z = w[-1] + np.bincount(row, vals * w[cols], len(y))
            err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            n, loss = n + len(y), loss + float((np.logaddexp(0, z) - y * z).sum())
            g[:-1] += np.bincount(cols, vals * err[row], len(w) - 1)
            g[-1] += err.sum()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([g.tobytes()])], ["n", "loss", "g"])

    parts = rows.select("y", "at", "share").mapInArrow(run, "n long, loss double, g binary").collect()
    n = sum(r["n"] for r in parts)
    total = np.sum([np.frombuffer(r["g"], np.float64) for r in parts], axis=0) / n
    total[:-1] += decay * w[:-1]
    given.unpersist()
    return sum(r["loss"] for r in parts) / n + decay / 2 * float(w[:-1] @ w[:-1]), total


def descend(rows: DataFrame, dims: int, rounds: int = ROUNDS, decay: float = DECAY, memory: int = 8) -> np.ndarray:
    """Logistic regression by L-BFGS: dims weights and the bias."""
    to_workers(rows.sparkSession)
    w = np.zeros(dims + 1)
    loss, g = loss_and_gradient(rows, w, decay)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-4:
            break
        d, used = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            used.append(a)
            d -= a * y
        d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(g).max())
        for (s, y), a in zip(steps, reversed(used)):
            d += (a - (y @ d) / (s @ y)) * s
        size = 1.0
        while True:  # half the step until the loss falls enough
            there = w - size * d
            new_loss, new_g = loss_and_gradient(rows, there, decay)
            if new_loss <= loss - 1e-4 * size * (g @ d) or size < 1e-3:
                break
            size /= 2
        if new_loss >= loss:
            break
        if (there - w) @ (new_g - g) > 1e-12:
            steps = [*steps, (there - w, new_g - g)][-memory:]
        w, loss, g = there, new_loss, new_g
    return w


def margins(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Margin and label of each row, in order of the margins."""
    given = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cols, vals, row, y = sparse(batch)
                z = given.value[-1] + np.bincount(row, vals * given.value[cols], len(y))
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(y)], ["z", "y"])

    return np.array(sorted(map(tuple, rows.select("y", "at", "share").mapInArrow(run, "z double, y double").collect())))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins probabilities, by Newton's method; smoothed targets as Platt gave them."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, x = np.array([1.0, 0.0]), np.column_stack([z, np.ones(len(z))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def assess(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability
    (that the text is of good quality) and kept."""

    def make():
        def step(ids, texts):
            texts = texts.to_pylist()
            counts = [counts_of(t) for t in texts]
            return ids, *(list(x) for x in zip(*counts, strict=True)), [model.probability(t) for t in texts]

        return step

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = map_columns(docs, [id_col, text_col], make, [(id_col, type_of(docs, id_col)), *((n, "long") for n in names), ("probability", "double")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.select(id_col, *names, failed.alias("base_failed"), "probability", (~failed & (F.col("probability") >= threshold)).alias("kept"))
