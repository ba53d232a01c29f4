"""Toxicity by multiple-instance learning.

Only documents are labelled.  Each sentence gets a logistic score from the
words and word beginnings in it, and a document's score is the noisy-or of its
sentences: 1 - prod(1 - p).  Both are trained together from the labels of
documents, so the model can point at the sentences that made it decide.

Length alone decides nothing: a scored sentence counts only with its evidence
beyond one without any known feature, in training clean sentences weigh more,
and trained logits are stretched around the threshold's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextSlice, checkpoint, held_out, mix64, prefix_hash, range_hash, sigmoid, text_slices, word_bounds
from .labelled import labelled_sample

#: Bounds of the training sample: labelled documents, and bytes of all; fewer documents are drawn where these are long.
TRAIN_ROWS, TRAIN_BYTES = 4_000, 24 << 20
#: Features kept, the fewest toxic documents and the least z-score of one.
MAX_FEATURES, MIN_DOCS, MIN_Z = 4_096, 3, 2.5
#: Word beginnings in bytes that are features beside whole words.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
STEPS, RATE, DECAY = 600, 0.1, 1e-3
#: Clean sentences of the sample weigh as if there were so many, at most so many times their number: a document of several megabytes has 100,000.
CLEAN_SENTENCES, CLEAN_WEIGHT = 10_000_000, 30
#: Trained logits are stretched so many times around that of the threshold, so that many weak sentences add up to less.
STRETCH = 2.0

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[97:123] = _GAP[0x80:] = False
_END = np.zeros(256, bool)
_END[[ord(x) for x in ".!?\n"]] = True


def _lower(a: pa.Array) -> pa.Array:
    return pc.utf8_lower(a.fill_null(""))


def features(s: TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """(start byte of the word, hash) of every feature of a lower-cased slice."""
    first, last, _ = word_bounds(s.data, s.starts, _GAP)
    prefix = prefix_hash(s.data)
    at, hashes = [first], [mix64(range_hash(prefix, first, last))]
    for k in BEGINNINGS:
        long = first[last - first >= k]
        at.append(long)
        hashes.append(mix64(range_hash(prefix, long, long + k) + np.uint64(k)))
    return np.concatenate(at), np.concatenate(hashes)


def sentences(s: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the runs between ends of sentences."""
    return word_bounds(s.data, s.starts, _END)


def evidence(z: np.ndarray, bias: float) -> np.ndarray:
    """-log of the chance that a sentence isn't toxic, beyond that of one without any known feature.

    Such a sentence adds nothing, so that no length of them makes a document toxic.
    """
    return np.maximum(np.logaddexp(0, z) - np.logaddexp(0, bias), 0)


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    sieve: np.ndarray  # bits: the upper 22 bits of each hash

    @staticmethod
    def of(hashes: np.ndarray, weights: np.ndarray, bias: float) -> Model:
        order = np.argsort(hashes)
        sieve = np.zeros(1 << 22, bool)
        sieve[(hashes >> np.uint64(42)).astype(np.int64)] = True
        return Model(hashes[order], weights[order], bias, np.packbits(sieve))

    def hits(self, at: np.ndarray, h: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start byte, feature) of the features that the model knows."""
        maybe = np.flatnonzero(sieve[(h >> np.uint64(42)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return at[:0], np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        ok = self.hashes[k] == h[maybe]
        return at[maybe[ok]], k[ok]

    def score(self, s: TextSlice, sieve: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
        """(score of each document, its sentences, logit of each sentence)."""
        first, last, doc = sentences(s)
        at, k = self.hits(*features(s), sieve)
        z = np.full(len(first), self.bias)
        if len(at):
            z += np.bincount(np.searchsorted(first, at, side="right") - 1, weights=self.weights[k], minlength=len(first))
        none = np.bincount(doc, weights=evidence(z, self.bias), minlength=len(s))  # -log of the chance that no sentence is toxic
        return -np.expm1(-none), (first, last, doc), z


@dataclass
class Bags:
    """Training documents as bags of sentences; equal sentences of a document are one row that counts `times`."""

    toxic: np.ndarray  # of each document
    doc: np.ndarray  # of each row of sentences
    times: np.ndarray
    rows: np.ndarray  # (row, feature) of every known feature
    cols: np.ndarray


def train(bags: Bags, hashes: np.ndarray, odds: np.ndarray) -> Model:
    """Noisy-or of logistic sentences by gradient descent.  Without both classes every score is the bias's."""
    docs, y = len(bags.toxic), bags.toxic
    if not y.any() or y.all():
        return Model.of(np.zeros(0, np.uint64), np.zeros(0), -12.0)
    doc, times, rows, cols, base = bags.doc, bags.times, bags.rows, bags.cols, len(bags.doc)
    w, bias = np.clip(odds, 0, 4), -8.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    more = np.clip(CLEAN_SENTENCES / max(1, times[~y[doc]].sum()), 1, CLEAN_WEIGHT)
    for t in range(1, STEPS + 1):
        logit = bias + np.bincount(rows, weights=w[cols], minlength=base)
        p = sigmoid(logit)
        none = np.bincount(doc, weights=times * np.logaddexp(0, logit), minlength=docs)
        pull = np.where(y, -1 / np.maximum(np.expm1(np.minimum(none, 50)), 1e-4), more)  # d loss / d log-chance of none
        g = p * pull[doc] * times
        grad = np.append(np.bincount(cols, weights=g[rows], minlength=len(w)) + DECAY * docs * w / max(1, len(w)), g.sum()) / docs
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], min(-6.0, bias - step[-1])
    middle = np.log(THRESHOLD / (1 - THRESHOLD))
    return Model.of(hashes, STRETCH * w, float(middle + STRETCH * (bias - middle)))


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct feature of each document, with whether that is toxic."""
    for s in text_slices(batches, transform=_lower):
        at, f = features(s)
        doc = np.searchsorted(s.starts, at, side="right") - 1
        order = np.lexsort((doc, f))
        f, doc = f[order], doc[order]
        once = np.ones(len(f), bool)
        once[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
        toxic = s.column("label").to_numpy(zero_copy_only=False) > 0
        yield pa.RecordBatch.from_arrays([pa.array(f[once].view(np.int64)), pa.array(toxic[doc[once]])], names=["h", "toxic"])


def known_features(sample: DataFrame, pos: int, neg: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, log odds) of the features that mark toxic documents best, counted by the executors."""
    counts = sample.mapInArrow(_document_features, "h long, toxic boolean").groupBy("h").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    part = lambda c, n: F.log((F.col(c) + 0.5) / (F.lit(n) - F.col(c) + 0.5))
    odds = counts.where(F.col("a") >= MIN_DOCS).select("h", (part("a", pos) - part("b", neg)).alias("odds"), "a", "b")
    z = F.col("odds") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    got = odds.withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "h").limit(MAX_FEATURES).select("h", "odds").toArrow()
    h = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got["odds"].to_numpy()[order]


def _bags(known: np.ndarray):
    """One row a document: its label, and its distinct sentences as sets of known features with how often each occurs."""
    words = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in text_slices(batches, transform=_lower):
            first, _, doc = sentences(s)
            at, f = features(s)
            k = np.minimum(np.searchsorted(known, f), max(0, len(known) - 1))
            on = known[k] == f if len(known) else np.zeros(len(f), bool)
            sent, k = np.searchsorted(first, at[on], side="right") - 1, k[on]
            order = np.lexsort((k, sent))
            sent, k = sent[order], k[order]
            cuts = np.searchsorted(sent, np.arange(len(first) + 1))
            seen: list[dict[bytes, int]] = [{} for _ in range(len(s))]
            plain = np.bincount(doc[np.diff(cuts) == 0], minlength=len(s))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                bag = seen[doc[i]]
                name = k[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes()
                bag[name] = bag.get(name, 0) + 1
            times, sizes, cols = [], [], []
            for i, bag in enumerate(seen):
                names = sorted(bag)
                times.append([int(plain[i]), *(bag[x] for x in names)])
                sizes.append([0, *(len(x) // 4 for x in names)])
                cols.append(np.frombuffer(b"".join(names), np.int32))
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("label"), pa.array(times, words), pa.array(sizes, words), pa.array(cols, words)], names=["doc_id", "label", "times", "sizes", "cols"])

    return run


def fit(docs: DataFrame, labels: DataFrame, usable=None, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """Fits on about `rows` labelled documents and `size` bytes at most, drawn by hashes of the id whatever their length.

    At least one of 1,024 parts of the drawn ids is taken, even if it is larger.
    No text reaches the driver: features are counted by the executors, and a
    sentence arrives as the known features in it.
    """
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if usable is None else usable, rows, "toxic")
    sample = checkpoint(sample.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", F.lit("size")), F.lit(1024)).alias("part")))
    sizes = sample.groupBy("part").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("part").collect()
    fits = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), size, side="right"))
    if fits < len(sizes):
        sample = sample.where(F.col("part") <= sizes[max(0, fits - 1)]["part"])
    pos, total = sample.agg(F.count_if(F.col("label") > 0), F.count("*")).first()
    h, odds = known_features(sample, pos, total - pos) if 0 < pos < total else (np.zeros(0, np.uint64), np.zeros(0))
    got = sample.mapInArrow(_bags(h), f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, times array<int>, sizes array<int>, cols array<int>").toArrow().sort_by("doc_id").combine_chunks()
    flat = lambda c: np.asarray(got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64) if got.num_rows else np.zeros(0, np.int64)
    lengths = got["times"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0, np.int64)
    times, each = flat("times"), flat("sizes")
    bags = Bags(got["label"].to_numpy() > 0, np.repeat(np.arange(got.num_rows), lengths), times.astype(float), np.repeat(np.arange(len(times)), each), flat("cols"))
    return train(bags, h, odds)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, offending`` for each row; only the text is looked at.

    `offending` lists the sentences whose own chance reaches the threshold as
    (start, end, p), in bytes of the lower-cased UTF-8 text.

    * null and empty texts: no sentence, score 0.
    * very long texts: scored whole, and length alone adds nothing.
    * null ids are passed on; repeated rows get equal scores; ties at the threshold count as toxic.
    * empty table: empty result; other columns are ignored, whatever their names.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.unpackbits(model.sieve).astype(bool)
        for s in text_slices(batches, transform=_lower):
            p, (first, last, doc), z = model.score(s, sieve)
            bad: list[list] = [[] for _ in range(len(s))]
            for i in np.flatnonzero(sigmoid(z) >= threshold):
                o = s.starts[doc[i]]
                bad[doc[i]].append({"start": first[i] - o, "end": last[i] - o, "p": float(sigmoid(z[i]))})
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(bad, span)], names=["doc_id", "score", "predicted", "offending"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, predicted int, offending array<struct<start:bigint,end:bigint,p:double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, whose score is below the threshold.

    * null and empty texts score 0 and stay as they are; so do rows with a null id.
    * equal rows stay or go together; very long texts are scored whole.  Empty table: empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.unpackbits(model.sieve).astype(bool)
        for s in text_slices(batches, text_col, transform=_lower):
            p, _, _ = model.score(s, sieve)
            yield s.batch.slice(s.lo, len(s)).filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: learns labels outside the held-out fold, scores all rows."""
    fold = held_out(F.col("doc_id"), 4, 2)
    out = score(docs, fit(docs, labels, ~fold))
    return out.select("doc_id", fold.alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))
