"""Language identification by averaged hashed subword embeddings with a linear softmax.

Subwords are character n-grams (one to four characters, lower-cased letters, a word boundary
counting as a character at either end), hashed into buckets. A text's vector is the mean of its
buckets' embeddings; a linear softmax gives the language. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows (``SAMPLE_ROWS``). A part of
the sample is held back to calibrate: a temperature for the probabilities, and a threshold below
which a prediction is rejected.

At prediction time the embeddings are folded into one score per bucket and language, so a text
costs a hash and a lookup per subword. Whole texts are read.

Text that is null or has no letter is ``und`` with score 0, and is rejected. Rows without a label are
not learned from; if no row has one, every text is ``und`` (and the pipeline's stage keeps all rows). Ties go to the first language in
alphabetical order. Other columns pass through, and columns named like the outputs are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fold, held, spread_sample

#: Labelled rows that the classifier is fitted on at most, spread evenly by a hash of the id.
SAMPLE_ROWS = 4000
BUCKET_BITS = 17
DIMENSIONS = 16
EPOCHS = 6
#: Steps of gradient descent at least, so that a small sample is passed over more often.
STEPS = 600
BATCH = 32
RATE = 4.0
#: Share of right predictions on the calibration rows that may be rejected.
REJECTED = 0.002
#: Characters that are hashed at once.
BLOCK = 1 << 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Per code point: the lower-cased letter, or 0 where it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                table[c] = ord(s.lower()[0])
        _letters.append(table)
    return _letters[0]


def subwords(texts: list[str]):
    """For each n-gram length: bucket ids of all texts, one after the other, and where each text's begin."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate((np.zeros(1, np.uint32), letters()[points]))  # a boundary before the first text
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    letter = codes != 0
    for n in (1, 2, 3, 4):
        size = len(codes) - n + 1
        inner = letter[:size] if n < 3 else letter[1 : size + 1]
        if n == 2:
            inner = inner | letter[1 : size + 1]
        if n == 4:
            inner = inner & letter[2 : size + 2]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        yield (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), np.searchsorted(at, starts)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares of its subwords."""
    out = []
    for text in texts:
        ids, counts = np.unique(np.concatenate([i for i, _ in subwords([text])]), return_counts=True)
        out.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    return out


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean score of each text's subwords plus bias, and the number of subwords."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for ids, starts in subwords(texts):
            ends = np.concatenate((starts[1:], [len(ids)]))
            some = np.flatnonzero(ends > starts)
            if len(some):
                total[some] += np.add.reduceat(self.scores[ids], starts[some], axis=0)
                count += ends - starts
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, accepted = [], [], []
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) < BLOCK:
                size += len(texts[to])
                to += 1
            logits, count = self.logits(texts[at:to]) if self.languages else (np.zeros((to - at, 1)), np.zeros(to - at))
            p = softmax(logits / self.temperature)
            for best, score, n in zip(p.argmax(1), p.max(1), count, strict=True):
                names.append(self.languages[best] if n else "und")
                scores.append(float(score) if n else 0.0)
                accepted.append(bool(n and score >= self.threshold))
            at = to
        return names, scores, accepted


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit embeddings and softmax on (text, language) rows, then calibrate on every fifth of them."""
    languages = sorted({lang for _, lang in rows})
    model = Model(languages, np.zeros((1 << BUCKET_BITS, len(languages)), np.float32), np.zeros(len(languages)))
    if not rows:
        return model
    y = np.array([languages.index(lang) for _, lang in rows])
    held = np.arange(len(rows)) % 5 == 4
    learn = [i for i in range(len(rows)) if not held[i]]
    found = dict(zip(learn, bags([rows[i][0] for i in learn]), strict=True))
    learn = [i for i in learn if len(found[i][0])]
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weight = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(learn)))) if learn else 0
    steps = epochs * max(1, len(learn) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            rate = RATE * max(0.02, 1 - step / steps)
            step += 1
            sizes = [len(found[i][0]) for i in batch]
            ids = np.concatenate([found[i][0] for i in batch])
            share = np.concatenate([found[i][1] for i in batch])[:, None]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            mean = np.add.reduceat(embed[ids] * share, starts, axis=0)
            grad = softmax(mean @ weight + bias).astype(np.float32)
            grad[np.arange(len(batch)), y[batch]] -= 1
            down = np.repeat(grad @ weight.T, sizes, axis=0) * share
            weight -= rate / len(batch) * (mean.T @ grad)
            bias -= rate / len(batch) * grad.sum(0)
            np.add.at(embed, ids, -rate * down)
    model.scores = (embed @ weight).astype(np.float32)
    model.bias = bias.astype(float)
    calibrate(model, [rows[i] for i in np.flatnonzero(held)])
    return model


def calibrate(model: Model, rows: list[tuple[str, str]]) -> None:
    """Set temperature (least log loss) and rejection threshold from rows that were not trained on."""
    logits, count = model.logits([t for t, _ in rows]) if rows else (np.zeros((0, 1)), np.zeros(0))
    some = count > 0
    if not some.any():
        return
    truth = np.array([model.languages.index(lang) for _, lang in rows])[some]
    logits = logits[some]
    pick = np.arange(len(truth))
    grid = [2.0**k for k in np.arange(-6, 4.01, 0.25)]
    model.temperature = min(grid, key=lambda t: -np.log(softmax(logits / t)[pick, truth] + 1e-12).mean())
    p = softmax(logits / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    model.threshold = float(min(0.5, right[int(REJECTED * len(right))])) if len(right) else 0.0


def fit(docs: DataFrame, learn: Column, most: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``most`` of the rows of ``docs`` (doc_id, text, lang) for which ``learn`` holds."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return train([(r.text, r.lang) for r in spread_sample(rows.select("doc_id", "text", "lang"), "doc_id", most)])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    run_key = uuid.uuid4().hex
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]

    def make():
        own = held(("language", run_key), lambda: shipped.value)
        return lambda texts: list(own.predict([t or "" for t in texts.to_pylist()]))

    return arrow_map(docs, text_col, fields, make)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit(docs, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is recognised; all of them if no row has a label to learn from."""
    model = fit(docs, F.lit(True))
    if not model.languages:
        return docs
    # the columns go along as one value, so that none is replaced by an output of its name
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").cast("string").alias("_text"))
    return identify(whole, model, "_text").where("accepted").select("_doc.*")
