"""A quality classifier learnt from trusted positives and unlabelled web text.

Negative labels are not used. With positives P, unlabelled U and the share pi of positives in U, the risk of a scorer g
is pi * E_P[loss(g, +)] + max(0, E_U[loss(g, -)] - pi * E_P[loss(g, -)]): what unlabelled text costs as negative, less
what the positives in it are expected to cost, and never below zero, since a negative value there means that g has
begun to learn the sample by heart. pi is estimated first: among texts that a plain P-against-U scorer puts above a
threshold, the share of U over the share of P is at least pi for every threshold, and near pi where no negatives are
left, so the smallest such ratio is taken. Each scorer gives an upper bound, and the scorer learnt with one bound, which ranks
better, gives the next.

A text is described by how often each pair of byte classes follows each other, by how varied its words and lines are
and by its length. The fit uses bounded samples: about SAMPLE (a parameter) trusted rows and as many unlabelled ones, which are
any rows of the table, labelled or not; whole texts are used throughout, and every text is scored.

Results: null and empty texts have a description of zeros and the score the model gives that; repeated rows have equal
scores; without training positives every score is 1, so nothing is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import cut, small_slices, texts

#: Trusted rows that the fit uses, about, and unlabelled ones; chosen by a hash of doc_id.
SAMPLE = 10_000
#: Rows whose crc32 of doc_id leaves remainder 0 modulo FOLDS are never learnt from.
FOLDS = 5
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE, DECAY, CLIP, ROUNDS = 16, 30, 512, 0.005, 1e-4, 8.0, 2

CLASSES = 15


def _classes() -> np.ndarray:
    table = np.full(256, 10, np.uint8)
    groups = {0: b" ", 1: b"\n", 2: b"\t\r\v\f", 6: b".", 7: b",;:", 8: b"!?", 9: b"|", 11: b"\"'()[]{}<>"}
    for c, members in groups.items():
        table[list(members)] = c
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 3, 4, 5
    # Upper and lower case letters with accents differ in the second byte.
    table[0x80:0xA0], table[0xA0:0xC0], table[0xC0:] = 12, 13, 14
    return table


FEATURES = CLASSES * CLASSES + 7


def describe(text: bytes) -> np.ndarray:
    """The description of one UTF-8 text."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    kinds = _classes()[np.frombuffer(text, np.uint8)].astype(np.int16)
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(kinds) - 1))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    unique = len(set(words))
    out[CLASSES * CLASSES :] = (
        unique / n,
        np.log1p(unique) / np.log1p(n),
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        np.log1p(len(text)),
        min(len(text) / n, 100) / 10,
        np.log1p(n / len(lines)),
    )
    return out


@dataclass
class Model:
    """A network with one hidden layer over standardised descriptions."""

    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(self.standard(rows) @ w1 + b1) @ w2 + b2

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -CLIP, CLIP)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -40, 40)))


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int = 7) -> list[np.ndarray]:
    """Adam on the non-negative risk; without a prior, on plain P-against-U with equal weight."""
    rng = np.random.default_rng(seed)
    d = pos.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    size = min(BATCH, len(unl))
    for step in range(1, EPOCHS * max(4, len(unl) // size) + 1):
        n = min(BATCH, len(pos))
        rows = np.concatenate([pos[rng.integers(0, len(pos), n)], unl[rng.integers(0, len(unl), size)]])
        hidden = np.tanh(rows @ w[0] + w[1])
        z = hidden @ w[2] + w[3]
        s = _sigmoid(z)
        grad = np.empty(len(rows))
        if prior is None:
            grad[:n], grad[n:] = (s[:n] - 1) / n, s[n:] / size
        elif _soft(z[n:]).mean() >= prior * _soft(z[:n]).mean():
            grad[:n], grad[n:] = -prior / n, s[n:] / size
        else:  # undo what has been learnt by heart
            grad[:n], grad[n:] = prior * s[:n] / n, -s[n:] / size
        back = np.outer(grad, w[2]) * (1 - hidden**2)
        grads = [rows.T @ back + DECAY * w[0], back.sum(0), hidden.T @ grad + DECAY * w[2], grad.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in the unlabelled sample, from the scores of both."""
    cuts = np.quantile(pos, np.linspace(0.02, 0.9, 89))
    return float(np.clip(min((unl >= c).mean() / (pos >= c).mean() for c in cuts), 0.01, 0.99))


def fit(pos: np.ndarray, unl: np.ndarray) -> Model | None:
    """The model of descriptions of positives and of unlabelled texts; None if one of them is empty."""
    if not len(pos) or not len(unl):
        return None
    mean, spread = unl.mean(0), unl.std(0) + 1e-3
    model = Model(mean, spread, [], 1.0)
    a, b = model.standard(pos), model.standard(unl)
    for prior in (None, *[0.0] * (ROUNDS - 1)):
        # Each half is scored by what the other one has taught, so that no scorer knows by heart which rows are trusted.
        scores: list[list[np.ndarray]] = [[], []]
        for half in (0, 1):
            if len(a) > 1 and len(b) > 1:
                model.weights = _train(a[half::2], b[half::2], None if prior is None else model.prior)
            else:
                model.weights = _train(a, b, None)
            scores[0].append(model.logits(pos[1 - half :: 2]))
            scores[1].append(model.logits(unl[1 - half :: 2]))
        model.prior = min(model.prior, estimate_prior(*(np.concatenate(s) for s in scores)))
    model.weights = _train(a, b, model.prior)
    return model


def held_out(doc_id="doc_id"):
    """True for rows that are not learnt from."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def _described(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, label) as (label, x)."""

    def run(batches):
        for batch in small_slices(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            x = pa.array([describe(t) for t in raw], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), x], names=["label", "x"])

    return rows.select("text", "label").mapInArrow(run, "label int, x array<float>")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from rows outside the held-out fold: those of label 1 are trusted, and unlabelled are all of docs, labels unseen.

    About ``sample`` labelled and as many unlabelled doc_ids are picked by their hash, and of each one text, so the sample is bounded
    whatever the table holds. A doc_id with several labels counts as positive if all of them are 1.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    trusted = known.filter("label = 1")
    # About ``sample`` ids: small enough to send to every task whatever the table's size.
    trusted = cut(trusted.filter(_picked(trusted.count(), sample)).select("doc_id", F.lit(1).alias("label")))
    own = texts(docs).filter(F.col("doc_id").isNotNull() & ~held_out())
    unlabelled = own.filter(_picked(docs.count(), sample)).select("doc_id", F.lit(0).alias("label"), "text")
    rows = own.join(F.broadcast(trusted), "doc_id").select("doc_id", "label", "text").unionByName(unlabelled)
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = _described(rows).toArrow()
    if not got.num_rows:
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, FEATURES)
    label = got.column("label").to_numpy()
    # The fit must not depend on the order in which rows arrive.
    order = np.lexsort(np.vstack([label, x.T]))
    x, label = x[order].astype(np.float64), label[order]
    return fit(x[label == 1], x[label == 0])


def _picked(rows: int, sample: int):
    """True for about ``sample`` of so many rows, by the hash of doc_id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(rows, 1)) * (1 << 30))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row: how likely its text is of label 1."""

    def run(batches):
        for batch in small_slices(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            x = np.stack([describe(t) for t in raw]) if raw else np.zeros((0, FEATURES))
            s = np.ones(len(x)) if model is None else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least threshold, with all their columns."""
    model = learn(docs, labels)
    if model is None:
        return docs

    def run(batches):
        for batch in small_slices(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            x = np.stack([describe(t or b"") for t in raw]) if raw else np.zeros((0, FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
