"""Quality classifier: regularised quadratic discriminant over statistics of whole texts.

Each text gives a fixed vector of transformed statistics. Labelled rows give, for each class, a count, a sum and a
matrix of products, added up in Spark (a few thousand numbers reach the driver, whatever the corpus). A class's
covariance is shrunk towards the pooled one and towards its diagonal; its Cholesky factor is computed once and sent
with the model, and a score is the logistic of the difference of the two Gaussian log densities.

Defined cases: null text counts as empty and has a score like any other; labels other than 0 and 1 and rows without a
document are ignored; without labelled rows of both classes every score is the share of label 1 (0.5 if there are
none); a null doc_id is scored and never held out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishflow.llm.common import documents, materialise, text_rows

FEATURES = ("bytes", "words", "word_bytes", "word_spread", "lower", "upper", "digit", "stop", "comma", "bar", "mark", "symbol", "other", "newline", "high", "distinct", "top", "twice", "line_repeats", "line_words", "long_words", "capitals")
WORDS_AT = FEATURES.index("words")
CLIP, FEW_WORDS = 5.0, 20.0
_KINDS = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",;:", "bar": b"|", "mark": b"!?", "symbol": b"#$%&*@^~+=<>_\\/", "newline": b"\n\r"}


def _kind_table() -> np.ndarray:
    table = np.full(256, len(_KINDS), np.int64)  # whatever is none of these
    for i, x in enumerate(_KINDS.values()):
        table[list(x)] = i
    table[128:] = len(_KINDS) + 1
    table[list(b" \t\x0b\x0c")] = len(_KINDS) + 2
    return table


_KIND = _kind_table()


def statistics(text: bytes) -> list[float]:
    n = len(text)
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=len(_KINDS) + 3)
    words = text.split()
    m = len(words)
    share = {k: kinds[i] / max(n, 1) for i, k in enumerate(_KINDS)}
    rate = lambda x: float(np.log(x + 0.002))
    lengths = np.fromiter(map(len, words), np.int64, m) if m else np.zeros(1, np.int64)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    twice = sum(map(bytes.__eq__, words[1:], words))
    lines = [x for x in text.split(b"\n") if x]
    capitals = sum(map(bytes.isupper, words))
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        share["lower"], rate(share["upper"]), rate(share["digit"]), rate(share["stop"]), rate(share["comma"]), rate(share["bar"]), rate(share["mark"]), rate(share["symbol"]),
        rate(kinds[len(_KINDS)] / max(n, 1)), rate(share["newline"]), rate(kinds[len(_KINDS) + 1] / max(n, 1)),
        len(counts) / max(m, 1), rate(top / max(m, 1)), rate(twice / max(m, 1)), rate(1 - len(set(lines)) / max(len(lines), 1)),
        float(np.log1p(m / max(len(lines), 1))), rate(float((lengths > 20).sum()) / max(m, 1)), rate(capitals / max(m, 1)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics in the order of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in text_rows(batch)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return documents(docs).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Means and Cholesky factors of both classes, over standardised statistics, and the factors' inverses."""

    centre: np.ndarray
    scale: np.ndarray
    prior: np.ndarray  # of classes 0 and 1
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None
    whiten: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior[1])
        z = standardised(x, self.centre, self.scale)
        density = []
        for c in (0, 1):
            white = (z - self.mean[c]) @ self.whiten[c].T
            density.append(np.log(self.prior[c]) - np.log(np.diag(self.factor[c])).sum() - (white**2).sum(axis=1) / 2)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def standardised(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """In standard deviations from the centre, within +-CLIP; statistics of few words say little and count for less."""
    words = np.expm1(x[:, WORDS_AT : WORDS_AT + 1])
    return np.clip((x - centre) / scale, -CLIP, CLIP) * (words / (words + FEW_WORDS))


def _sums(labelled: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each class the sum of of(x): partial sums in each task, the rest by groupBy; 2 * width numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
            y = batch.column(1).to_numpy()
            part = np.stack([of(x[y == c]) for c in (0, 1)])
            total = part if total is None else total + part
        if total is not None:
            n = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n)), pa.array(np.tile(np.arange(n), 2)), pa.array(total.ravel())], names=["y", "i", "v"])

    rows = labelled.mapInArrow(run, "y long, i long, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, len(of(np.zeros((0, len(FEATURES)))))))
    for r in rows:
        sums[r.y, r.i] = r.v
    return sums


def fit(labelled: DataFrame, pooled: float = 0.05, diagonal: float = 0.02, ridge: float = 0.02) -> Model:
    """labelled: x, y. pooled, diagonal: how far a class covariance shrinks to the common one, and to its diagonal."""
    d = len(FEATURES)
    rows = materialise(labelled.select("x", F.col("y").cast("int").alias("y")))
    sums = _sums(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n = sums[:, 0]
    prior = np.array([0.5, 0.5]) if n.sum() == 0 else n / n.sum()
    if n.min() < 2:
        return Model(np.zeros(d), np.ones(d), prior)
    centre, squares = sums[:, 1:].sum(axis=0).reshape(2, d) / n.sum()
    scale = np.sqrt(np.maximum(squares - centre**2, 1e-6))

    def moments(x: np.ndarray) -> np.ndarray:
        z = standardised(x, centre, scale)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    sums = _sums(rows, moments)
    means = sums[:, :d] / n[:, None]
    within = sums[:, d:].reshape(2, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    common = (n[:, None, None] * within).sum(axis=0) / n.sum()
    factors = []
    for own in within:
        mixed = (1 - pooled) * own + pooled * common
        mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(mixed)) + ridge * np.eye(d)
        factors.append(np.linalg.cholesky(mixed))
    # the ridge keeps the factors well conditioned, so that their inverses are as good as a solve for each batch
    return Model(centre, scale, prior, means, np.array(factors), np.linalg.inv(np.array(factors)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs. Learns from labels of what isn't held out."""
    found = materialise(document_statistics(docs))
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).where(~held_out(F.col("doc_id")))
    model = fit(found.join(known, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = found.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier predicts as 1: learned as in classify, no shuffle
    of texts."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).where(~held_out(F.col("doc_id")))
    model = fit(document_statistics(docs).join(known, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in text_rows(batch)], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
