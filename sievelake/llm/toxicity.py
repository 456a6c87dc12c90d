"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words is the gap-weighted subsequence kernel: common subsequences of ``LENGTH``
characters (a word's beginning counts as one), each weighted by ``DECAY`` to the power of the stretch
it takes in both words, as a share of the landmark's kernel with itself. Characters inserted into a
word or left out of it lower the kernel but don't void it. A word with less than ``SHARED`` of a
landmark's letters counts as kernel zero with it, so most words cost a bit test.

Landmarks are the words of the training texts that tell the labels apart best. A sentence's kernel
value with a landmark is the sum over its words, those below ``FLOOR`` left out: that much any two words have in
common by chance. The Nyström map (inverse square root of the landmarks' whole kernel matrix, scaled to ones on
its diagonal, without such a floor) turns the values into features for a linear SVM (squared hinge loss,
Newton's method). Training is on sentences: each one of a clean text is negative, and of a toxic
text the ``WITNESSES`` that score highest are positive, chosen anew in each round, since a label says
only that some sentences are toxic. A logistic curve over a text's ``TOP`` highest margins, fitted on
the training texts, gives the score.

Runs of single characters set apart by blanks are joined to one word before scoring, and a word with
other characters than letters and digits inside is also scored without them. Words longer than
``WINDOW`` characters are scored by windows that overlap by half, so nothing is cut off.

Trained on at most ``SAMPLE_ROWS`` labelled rows. Null text counts as empty and gets the score of a
text without any suspect word. Without labels of both kinds all scores are the share of toxic labels
(zero without any). Other columns pass through; columns named like the outputs are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fold, spread_sample

#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 4000
LENGTH, DECAY = 3, 0.7
LANDMARKS = 96
WITNESSES = TOP = 3
SHARED = 0.75
#: Kernel values below this count as zero.
FLOOR = 0.68
WINDOW = 32
ROUNDS = 4
THRESHOLD = 0.7
#: Words whose kernel values a worker remembers; the memo is emptied when full, results don't depend on it.
MEMO = 1_500_000
#: Characters of a word that is remembered at most.
MEMO_CHARS = 64

_spaced = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")
_edge = re.compile(r"^[\W_]+|[\W_]+$")
_inner = re.compile(r"[\W_]+")


def reach(n: int) -> np.ndarray:
    """[i, j]: DECAY ** (j - i - 1) for j > i, the weight of the gap between two places; else 0."""
    gap = np.arange(n)[None, :] - np.arange(n)[:, None] - 1.0
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)


def kernel(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each pair of rows: character codes, padded with 0 in one and -1 in the other."""
    n, a = words.shape
    b = others.shape[1]
    # axes: place in the word, pair, place in the other; so both sums over gaps are one matrix product each
    match = (words.T[:, :, None] == others[None, :, :]).astype(np.float32) * np.float32(DECAY**2)
    table = match
    for _ in range(LENGTH - 1):
        before = reach(a).T @ table.reshape(a, n * b)
        table = match * (before.reshape(a * n, b) @ reach(b)).reshape(a, n, b)
    return table.sum(axis=(0, 2))


def codes(words: list[str], pad: int) -> np.ndarray:
    """Character codes of words of any length, each after a mark for its beginning."""
    size = max(map(len, words), default=0) + 1
    return np.array([[1, *map(ord, w), *[pad] * (size - 1 - len(w))] for w in words], np.int32)


def letter_sets(words: list[str]) -> np.ndarray:
    """The characters of each word as bits of a 64-bit set, by code modulo 64."""
    sets = []
    for word in words:
        bits = 0
        for c in word:
            bits |= 1 << (ord(c) & 63)
        sets.append(bits)
    return np.array(sets, np.uint64)


class Landmarks:
    """The landmark words with what is needed to compare others with them."""

    def __init__(self, words: list[str]):
        self.words = words
        if words:
            self.codes = codes(words, -1)
            self.sets = letter_sets(words)
            self.need = np.ceil(SHARED * np.bitwise_count(self.sets)).astype(int)
            own = codes(words, 0)
            self.own = np.array([kernel(own[i : i + 1], self.codes[i : i + 1])[0] for i in range(len(words))])

    def gram(self) -> np.ndarray:
        """The kernel of each landmark with each, scaled to ones on the diagonal."""
        own = codes(self.words, 0)
        rows = np.array([kernel(np.repeat(own[i : i + 1], len(own), axis=0), self.codes) for i in range(len(own))], float)
        scale = 1 / np.sqrt(np.diag(rows))
        square = rows * scale[:, None] * scale[None, :]
        return (square + square.T) / 2

    def similarity(self, words: list[str]) -> np.ndarray:
        """Kernel of every word with every landmark, in shares of the landmark's own; zero below FLOOR."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        order = sorted((i for i, w in enumerate(words) if len(w) >= LENGTH), key=lambda i: len(words[i]))
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            own = [words[i] for i in part]
            shared = np.bitwise_count(letter_sets(own)[:, None] & self.sets[None, :])
            row, landmark = np.nonzero(shared >= self.need)
            rows = codes(own, 0)
            for k in range(0, len(row), 8192):
                i, j = row[k : k + 8192], landmark[k : k + 8192]
                out[np.array(part)[i], j] = kernel(rows[i], self.codes[j]) / self.own[j]
        out[out < FLOOR] = 0
        return np.minimum(out, 1)


def windows(word: str) -> list[str]:
    """What is compared with the landmarks for a word: itself, or windows of it, and the same for its letters only."""
    if not word.isalnum() and (letters := _inner.sub("", word)):
        return cut(letters) + cut(word)
    return cut(word)


def cut(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[at : at + WINDOW] for at in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def words_of(text: str) -> list[str]:
    """Lower-cased words of a text; a line break gives a word of its own that ends a sentence."""
    return _spaced.sub(lambda m: m[0].replace(" ", ""), text.lower().replace("\n", " . ")).split()


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # on kernel values
    bias: float = 0.0
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(TOP))  # on the highest margins
    shift: float = 0.0

    def __post_init__(self):
        self.landmarks = Landmarks(self.words)
        self.forget()

    def forget(self) -> None:
        #: Twice the place of a word's kernel values (0 if it has none), plus one if it ends a sentence.
        self.memo: dict[str, int] = {}
        self.vectors: list[np.ndarray] = [np.zeros(len(self.words), np.float32)]

    def look_up(self, words: set[str]) -> None:
        """Remember the kernel values of new words."""
        fresh = [w for w in words if w not in self.memo]
        parts = [(i, p) for i, w in enumerate(fresh) for p in windows(_edge.sub("", w))]
        values = np.zeros((len(fresh), len(self.words)), np.float32)
        if parts:
            np.maximum.at(values, [i for i, _ in parts], self.landmarks.similarity([p for _, p in parts]))
        some = values.any(axis=1).tolist()
        for i, w in enumerate(fresh):
            place = 0
            if some[i]:
                place = len(self.vectors)
                self.vectors.append(values[i])
            self.memo[w] = 2 * place + (w[-1] in ".!?")

    def values(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the kernel values of the sentences that have any, one row each; never empty."""
        words = [words_of(t) for t in texts]
        if len(self.memo) > MEMO:
            self.forget()
        every = {w for of in words for w in of}
        self.look_up(every)
        out = [self.of_words(w) for w in words]
        for w in every:
            if len(w) > MEMO_CHARS:
                del self.memo[w]
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        known = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        ends = known & 1
        at = np.flatnonzero(known > 1)
        if not len(at):
            return np.zeros((1, len(self.words)), np.float32)
        rows = np.array([self.vectors[k] for k in (known[at] >> 1).tolist()])
        of = (np.cumsum(ends) - ends)[at]
        return np.add.reduceat(rows, np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))), axis=0)

    def margins(self, values: list[np.ndarray]) -> np.ndarray:
        """The highest margins of each text's sentences; a sentence without any suspect word has the bias."""
        out = np.full((len(values), TOP), self.bias)
        for i, v in enumerate(values):
            best = np.sort(v @ self.weights + self.bias)[::-1][:TOP]
            out[i, : len(best)] = np.maximum(best, self.bias)
        return out

    def score(self, texts: list[str]) -> list[float]:
        if not self.words:
            return [self.shift] * len(texts)
        z = self.margins(self.values(texts)) @ self.slopes + self.shift
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def choose_landmarks(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Words whose presence tells toxic from clean texts best."""
    seen = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, toxic, strict=True):
        seen[int(label)].update({c for w in words_of(text) if LENGTH <= len(c := _edge.sub("", w)) <= WINDOW})
    bad, good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))

    def telling(w: str) -> float:
        p, q = (seen[1][w] + 0.1) / (bad + 1), (seen[0][w] + 0.1) / (good + 1)
        return seen[1][w] / bad * math.log(p / q)

    return sorted((w for w in seen[1] if telling(w) > 0), key=lambda w: (-telling(w), w))[:LANDMARKS]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton's method; the bias is not penalised."""
    rows = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w = np.zeros(rows.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    for _ in range(30):
        slack = 1 - y * (rows @ w)
        on = slack > 0
        active = rows[on] * weight[on, None]
        new = np.linalg.solve(np.diag(ridge) + active.T @ rows[on], active.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic curve, by Newton's method."""
    rows = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        hessian = rows.T @ (rows * (p * (1 - p))[:, None]) + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, rows.T @ (p - y) + penalty * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(rows: list[tuple[str, int]]) -> Model:
    """Fit landmarks, SVM and logistic curve on (text, toxic) rows."""
    texts, toxic = [t for t, _ in rows], np.array([int(bool(y)) for _, y in rows])
    if not len(rows) or toxic.all() or not toxic.any():
        return Model(shift=float(toxic.mean()) if len(rows) else 0.0)
    model = Model(choose_landmarks(texts, toxic))
    eigen, vectors = np.linalg.eigh(model.landmarks.gram())
    nystroem = vectors @ np.diag(1 / np.sqrt(np.maximum(eigen, 1e-3))) @ vectors.T  # equal landmarks have eigenvalue 0
    values = model.values(texts)
    features = [v @ nystroem for v in values]
    empty = np.zeros((1, len(model.words)))
    clean = np.vstack([empty, *[f for f, y in zip(features, toxic, strict=True) if not y]])
    clean, copies = np.unique(np.round(clean, 4), axis=0, return_counts=True)
    bags = [f for f, y in zip(features, toxic, strict=True) if y]
    chosen = [b[np.argsort(-b.sum(axis=1), kind="stable")[:WITNESSES]] for b in bags]
    for _ in range(ROUNDS):
        witness = np.vstack(chosen)
        x = np.vstack([clean, witness])
        y = np.concatenate([-np.ones(len(clean)), np.ones(len(witness))])
        share = np.concatenate([copies / copies.sum(), np.full(len(witness), 1 / len(witness))])
        weights, model.bias = svm(x, y, share)
        chosen = [b[np.argsort(-(b @ weights), kind="stable")[:WITNESSES]] for b in bags]
    model.weights = nystroem @ weights
    model.slopes, model.shift = logistic(model.margins(values), toxic)
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``most`` labelled rows: ``labels`` (doc_id, toxic) joined to ``docs`` (doc_id, text)."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").join(marked, "doc_id")
    sizes = docs.select("doc_id", F.octet_length("text").alias("bytes")).join(marked, "doc_id")
    return train([(r.text or "", r.toxic) for r in spread_sample(rows, "doc_id", most, sizes=sizes)])


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(
        (model.words, model.weights, model.bias, model.slopes, model.shift)
    )

    def make():
        own = Model(*shipped.value)
        return lambda texts: [own.score([t or "" for t in texts.to_pylist()])]

    return arrow_map(docs, text_col, [T.StructField(out_col, T.DoubleType())], make)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(fold("doc_id", 3) != 1))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
