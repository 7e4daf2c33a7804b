"""Quality classification by naive-Bayes support vectors.

Features are indicators of word one- and two-grams (with one family for words
that repeat themselves) and of character three-grams, hashed to ``2**bits`` places.  Each is scaled by its log-count
ratio between the two classes, each text to unit length in its number of
features; a linear model with hinge loss is fitted by dual coordinate descent
and drawn towards the mean weight as usual for this method.  A sigmoid fitted
on rows that the descent did not see turns margins into scores.

The model is fitted on at most ``sample_rows`` labelled rows, taken by the hash
of doc_id among those whose fold is not 1; scoring covers all rows and whole
texts in one narrow stage.

Defined results: null and empty texts have no features and get the score of the
bias; labels other than 0 and 1 and null doc_ids teach nothing, and of several
labels of one doc_id the largest counts; with one class the score is that class,
without labels 0.5; repeated rows get equal results.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import arrow_rows, fold, narrow

BITS = 18
_MEMORY: dict[str, int] = {}
_KEPT = 200_000


def _word(word: str) -> int:
    code = _MEMORY.get(word)
    if code is None:
        code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(_MEMORY) >= _KEPT:
                _MEMORY.clear()
            _MEMORY[word] = code
    return code


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature places of a whole text, ascending."""
    if not text:
        return np.zeros(0, np.int32)
    words = text.lower().split()
    single = np.fromiter(map(_word, words), np.uint64, len(words))
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    double = single[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ single[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = (chars[:-2] << np.uint64(42)) ^ (chars[1:-1] << np.uint64(21)) ^ chars[2:] if len(chars) > 2 else chars[:0]
    # A word that follows itself is one two-gram more, whichever word, once per doubling of their number.
    repeats = np.arange(int((single[:-1] == single[1:]).sum()).bit_length(), dtype=np.uint64)
    codes = np.concatenate([single, repeats ^ np.uint64(0x94D049BB133111EB), double ^ np.uint64(0x5851F42D4C957F2D), triple ^ np.uint64(0x14057B7EF767814F)])
    return np.unique((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def packed(places: np.ndarray, bits: int) -> bytes:
    """Places as whole numbers or, where that is shorter, as one bit per place: at most ``2**bits / 8`` bytes."""
    if 4 * len(places) < (1 << bits) // 8:
        return places.astype(np.int32).tobytes()
    whole = np.zeros(1 << bits, bool)
    whole[places] = True
    return np.packbits(whole).tobytes()


def unpacked(data: bytes, bits: int) -> np.ndarray:
    if len(data) < (1 << bits) // 8:
        return np.frombuffer(data, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int = BITS

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum() / np.sqrt(max(len(places), 1)) + self.bias)

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text, self.bits)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int, smooth: float = 1.0) -> np.ndarray:
    counts = [
        np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == c] or [np.zeros(0, np.int32)]), minlength=1 << bits)
        + smooth
        for c in (1, 0)
    ]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_descent(
    rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 15, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Hinge loss, dual variables in [0, cost of the class]; the rarer class weighs more."""
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, labels.mean(), 1 - labels.mean())
    most = cost * 0.5 / share
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    scale = [1 / np.sqrt(max(len(r), 1)) for r in rows]
    diagonal = [float((ratios[r] ** 2).sum()) * s * s + 1.0 for r, s in zip(rows, scale)]
    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            x = ratios[rows[i]] * scale[i]
            gradient = sign[i] * (x @ weights[rows[i]] + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), most[i])
            if (step := (new - alpha[i]) * sign[i]) != 0:
                alpha[i] = new
                weights[rows[i]] += step * x
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights, bias


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic of the margins, by damped Newton steps on smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    loss = lambda t: np.logaddexp(0, x @ t).sum() - goal @ (x @ t)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        gradient = x.T @ (p - goal)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, blend: float = 0.25) -> Model:
    if len(set(labels.tolist())) < 2:
        side = {0: 0.0, 1: 500.0, 2: -500.0}[0 if not len(labels) else 1 if labels[0] else 2]
        return Model(np.zeros(1 << bits, np.float32), 0.0, 1.0, side, bits)
    kept = np.arange(len(rows)) % 5 != 0
    if min(labels[kept].sum(), (1 - labels[kept]).sum()) < 1 or len(rows) < 20:
        kept[:] = True
    inner = [r for r, k in zip(rows, kept) if k]
    ratios = log_ratios(inner, labels[kept], bits)
    learned, bias = dual_descent(inner, labels[kept], ratios)
    learned = (1 - blend) * np.abs(learned).mean() * np.sign(ratios) * (learned != 0) + blend * learned
    model = Model((learned * ratios).astype(np.float32), bias * blend, 1.0, 0.0, bits)
    outer = [(r, y) for r, y, k in zip(rows, labels, kept) if not k] or list(zip(rows, labels))
    model.slope, model.offset = sigmoid_fit(np.array([model.margin(r) for r, _ in outer]), np.array([y for _, y in outer]))
    return model


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = 6000, bits: int = BITS,
) -> Model:
    """Fit on at most ``sample_rows`` rows: the sampled ids are broadcast, features come from the tasks.

    Of rows that share an id one counts, that of the smallest text hash; they are reduced before the exchange,
    so only texts of the sample are shuffled.  The driver gets at most ``2**bits / 8`` bytes of each.
    """
    marks = narrow(labels, key=id_col, label=label_col).filter(F.col("label").isin(0, 1) & (fold(F.col("key")) != 1))
    marks = marks.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max("label").cast("int").alias("label"))
    sample = F.broadcast(marks.orderBy(F.xxhash64("key"), "key").limit(sample_rows))
    rows = narrow(docs, doc_id=id_col, text=text_col).join(sample, F.col("doc_id") == F.col("key")).select("key", "label", "text")

    def make(keys: list, marks_: list, texts: list) -> list[list]:
        return [keys, marks_, [packed(features(t, bits), bits) for t in texts]]

    rows = rows.groupBy("key").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.withColumn("key", F.col("key").cast("long"))
    found = arrow_rows(rows, make, "key long, label int, places binary", "key", "label", "text").collect()
    found.sort(key=lambda r: (r.key, r.places))
    return fit([unpacked(r.places, bits) for r in found], np.array([r.label for r in found], np.int64), bits)


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the weights, of fixed size, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(ids: list, texts: list) -> list[list]:
        known = shared.value
        return [ids, [known.score(t) for t in texts]]

    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_rows(rows, make, "doc_id long, score double", "doc_id", "text")
