"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics of its bytes, words
and lines.  Both classes get a mean and a covariance that is shrunk towards
the pooled one and towards a multiple of the identity.  The score is the
posterior from the difference of the two Mahalanobis log-densities; their
Cholesky factors are inverted once and travel with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, TextSlice, held_out, mix64, prefix_hash, range_hash, sigmoid, text_slices, word_bounds
from .labelled import labelled_sample

#: Labelled documents that the model is fitted on, at most about this many.
TRAIN_ROWS = 8_000
SHRINK_POOLED, SHRINK_RIDGE = 0.1, 0.02
THRESHOLD = 0.3

FEATURES = ("chars", "words", "upper", "digit", "stop", "loud", "bar", "symbol", "high", "space", "word_len", "short_words", "long_words", "new_words", "new_grams", "new_lines", "line_len", "entropy", "plain_words", "words_a_stop")


def _classes() -> np.ndarray:
    """Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 stop, 5 loud, 6 bar, 7 symbol, 8 high lead, 9 high tail, 10 space, 11 newline."""
    c = np.zeros(256, np.uint8)
    c[97:123], c[65:91], c[48:58] = 1, 2, 3
    c[[ord(x) for x in ".,;:"]] = 4
    c[[ord(x) for x in "!?"]] = 5
    c[ord("|")] = 6
    c[[ord(x) for x in "#$%&*@~^=+<>\\_{}[]/"]] = 7
    c[0xC0:], c[0x80:0xC0] = 8, 9
    c[SPACE] = 10
    c[10] = 11
    return c


_CLASS = _classes()


def _novel(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each document."""
    key = (doc.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12))
    key.sort()
    if not len(key):
        return np.zeros(n)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount((key[first] >> np.uint64(52)).astype(np.int64), minlength=n)


def statistics(s: TextSlice) -> np.ndarray:
    """[document, feature]; every value is finite for any text, the empty one included."""
    n, data = len(s), s.data
    size = np.diff(s.starts)
    doc = s.doc_of_byte()
    by_class = np.bincount(doc * np.int64(12) + _CLASS[data], minlength=12 * n).reshape(n, 12).astype(float)
    hist = np.bincount(doc * np.int64(256) + data, minlength=256 * n).reshape(n, 256)
    first, last, wdoc = word_bounds(data, s.starts, SPACE)
    words = np.bincount(wdoc, minlength=n)
    length = last - first
    h = mix64(range_hash(prefix_hash(LOWER[data]), first, last))
    grams = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7) if len(h) > 2 else h[:0]
    inside = wdoc[2:] == wdoc[:-2]
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((_CLASS[data] == 1) | (_CLASS[data] >= 8) & (_CLASS[data] < 10), out=letters[1:])
    plain = letters[last] - letters[first] >= length - 1
    newline = np.zeros(256, bool)
    newline[10] = True
    lfirst, llast, ldoc = word_bounds(data, s.starts, newline)
    lines = np.bincount(ldoc, minlength=n)
    lh = mix64(range_hash(prefix_hash(data), lfirst, llast))
    part = lambda x, of: (x + 0.5) / (of + 1.0)
    p = hist / np.maximum(1, size)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    per = lambda mask: np.bincount(wdoc[mask], minlength=n)
    c = by_class.T
    ngrams = np.bincount(wdoc[2:][inside], minlength=n)
    cols = [
        np.log1p(size), np.log1p(words),
        *(np.log(part(c[k], size) + 0.002) for k in (2, 3, 4, 5, 6, 7, 8, 10)),
        np.log1p(size / np.maximum(1, words)), part(per(length <= 3), words), part(per(length > 14), words),
        part(_novel(h, wdoc, n), words), part(_novel(mix64(grams[inside]), wdoc[2:][inside], n), ngrams), part(_novel(lh, ldoc, n), lines),
        np.log1p(size / np.maximum(1, lines)), entropy, np.log(part(per(~plain), words) + 0.01), np.log1p(words / (c[4] + c[5] + 1)),
    ]
    return np.column_stack(cols)


@dataclass
class Model:
    mean: np.ndarray  # [class, feature], of standardised features
    inverse: np.ndarray  # [class, feature, feature], inverses of the Cholesky factors
    logdet: np.ndarray
    prior: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        logp = []
        for k in (0, 1):
            w = (z - self.mean[k]) @ self.inverse[k].T
            logp.append(self.prior[k] - 0.5 * (w * w).sum(axis=1) - 0.5 * self.logdet[k])
        return sigmoid(logp[1] - logp[0])


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """A class without rows gets the pooled moments and its smoothed prior."""
    dim = len(FEATURES)
    if not len(x):
        x, y = np.zeros((2, dim)), np.array([0, 1])
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - centre) / scale, -8, 8)
    cov = lambda a: np.cov(a, rowvar=False, bias=True).reshape(dim, dim) if len(a) > 1 else np.zeros((dim, dim))
    groups = [z[y == k] if (y == k).any() else z for k in (0, 1)]
    mean = np.array([g.mean(axis=0) for g in groups])
    pooled = sum(cov(g) * len(g) for g in groups) / sum(map(len, groups))
    inverse, logdet = [], []
    for g in groups:
        # few rows lean more on the pooled moments
        a = max(SHRINK_POOLED, dim / (dim + len(g)))
        s = (1 - a) * cov(g) + a * pooled
        s = (1 - SHRINK_RIDGE) * s + SHRINK_RIDGE * max(np.trace(s) / dim, 1e-3) * np.eye(dim)
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    prior = np.log([((y == k).sum() + 1.0) / (len(y) + 2.0) for k in (0, 1)])
    return Model(mean, np.array(inverse), np.array(logdet), prior, centre, scale)


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in text_slices(batches):
        x = statistics(s)
        yield pa.RecordBatch.from_arrays([s.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, usable=None, rows: int = TRAIN_ROWS) -> Model:
    """Fits on about `rows` labelled documents at most; only their statistics reach the driver."""
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, rows, "quality")
    got = sample.select("label", "text").mapInArrow(_stats_batches, "label int, x array<double>").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = (got["label"].to_numpy() > 0).astype(int)
    order = np.lexsort((*x.T, y))  # the same model however the rows arrive
    return train(x[order], y[order])


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row; only the text is looked at.

    Null text counts as empty, and an empty text has a score like any other.
    Null ids are passed on; repeated rows get equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in text_slices(batches):
            p = model.score(statistics(s))
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: learns labels outside the held-out fold, scores all rows."""
    fold = held_out(F.col("doc_id"), 5, 0)
    return predict(docs, fit(docs, labels, ~fold)).select("doc_id", fold.alias("held_out"), "score", "predicted")
