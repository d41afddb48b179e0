"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams: of words, of word endings and of word shapes. Each is an indicator, scaled by the
log-ratio of how common it is among good and among bad documents, and a linear hinge-loss model over the scaled indicators is
fitted by dual coordinate descent. Both take bounded samples of the labelled rows, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MEMO_WORDS, cut, grams, slices, utf8

#: Indicators share this many places by hash.
BITS = 18
#: Labelled documents that the counts are taken from, about: beyond so many, an even share of them by hash of doc_id.
LABELLED_ROWS = 200_000
#: Of those, rows that the hinge-loss model is fitted on, about: half of each class where there are as many.
FIT_ROWS = 12_000
EPOCHS, COST, SMOOTHING = 6, 0.1, 1.0
FOLDS = 3


def share(doc_id: str, salt: int, part: float) -> Column:
    """Whether a document is in the part, from 0 to 1, of all documents that its hash puts there."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(salt)), F.lit(1 << 30)) < F.lit(int(min(1.0, part) * (1 << 30)))


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


class Features(dict):
    """bytes -> (hash of the word, of its ending, of its shape), memoised."""

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        text = word.decode()
        core = text.rstrip("#*$%&|<>!?.,;:\"')")
        end = text[len(core) :]
        shape = ("U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "d" if core.isdigit() else "l" if core.isalpha() else "m" if core else "-") + end[:4]
        self[word] = found = tuple(xxhash.xxh64_intdigest(x.encode(), seed=s) for s, x in enumerate((text.lower(), text[-3:].lower(), shape), 1))
        return found


def indicators(text: bytes, memo: Features) -> np.ndarray:
    """The places of a text's n-grams, each once: words and pairs, endings, shapes up to three, and whether a word repeats one of the two before it."""
    words = text.split()
    if not words:
        return np.zeros(1, np.int64)
    h = np.array(list(map(memo.__getitem__, words)), np.uint64).reshape(-1, 3)
    word, ending, shape = (np.ascontiguousarray(h[:, k]) for k in range(3))
    same = np.zeros(len(words), np.uint64)
    same[1:] |= word[1:] == word[:-1]
    same[2:] |= (word[2:] == word[:-2]).astype(np.uint64) << np.uint64(1)
    shaped = shape ^ (same * np.uint64(0x5851F42D4C957F2D))
    size = np.array([1000 + min(20, int(np.log2(len(words)) * 2))], np.uint64)
    every = [grams(word, 1), grams(word, 2), grams(ending, 1), grams(shaped, 1), grams(shaped, 2), grams(shaped, 3), grams(size, 1)]
    salted = [x ^ np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i, x in enumerate(every, 1)]
    return np.unique(np.concatenate(salted) >> np.uint64(64 - BITS)).astype(np.int64)


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, weight: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """The weights and bias that minimise |w|^2 / 2 + the weighted hinge losses, over rows scaled by the ratios to unit length."""
    w, bias, n = np.zeros(len(ratio)), 0.0, len(rows)
    scale = np.array([1 / max(np.linalg.norm(ratio[r]), 1e-9) for r in rows])
    alpha, top, order = np.zeros(n), cost * n / 100 * weight, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(n):
            y = labels[i]
            x = ratio[rows[i]] * scale[i]
            g = y * (w[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[rows[i]] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def sets(rows: DataFrame) -> DataFrame:
    """doc_id, label, places of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Features()
        for b in (s for batch in batches for s in slices(batch)):
            places = [indicators(t, memo).astype(np.int32) for t in utf8(b)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(places) if places else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), lists], ["doc_id", "label", "places"])

    return rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, places array<int>")


def tallies(rows: DataFrame) -> np.ndarray:
    """For each class, how many rows have each indicator, and how many rows there are: sums of fixed size, one a task."""
    size = (1 << BITS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = Features(), np.zeros((2, size), np.int64)
        for b in (s for batch in batches for s in slices(batch)):
            for label, text in zip(b.column("label").to_pylist(), utf8(b), strict=True):
                counts[label, indicators(text, memo)] += 1
                counts[label, -1] += 1
        c, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c * size + k), pa.array(counts[c, k])], ["k", "n"])

    out = np.zeros(2 * size, np.int64)
    got = rows.select("label", "text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(2, size)


class Model:
    """Weights of a fixed number of places, and the two numbers that turn a margin into a score."""

    def __init__(self, ratio: np.ndarray, w: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.ratio, self.w, self.bias, self.slope, self.shift = ratio.astype(np.float32), w.astype(np.float32), bias, slope, shift

    def margin(self, places: np.ndarray) -> float:
        x = self.ratio[places]
        return float(self.w[places] @ x) / max(float(np.linalg.norm(x)), 1e-9) + self.bias

    def score(self, margin: float) -> float:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Fits the model to rows (doc_id, text, label 0 or 1); None if a class has no row."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    counts = tallies(rows)
    totals = counts[:, -1]
    if not totals.min():
        return None
    p = counts[:, :-1] + SMOOTHING
    rates = p / (totals[:, None] + 2 * SMOOTHING)
    ratio = np.log(rates[1] / rates[0])
    taken = [min(int(totals[k]), max(fit_rows // 2, fit_rows - int(totals[1 - k]))) for k in (0, 1)]
    part = F.when(F.col("label") == 0, share("doc_id", 1, taken[0] / int(totals[0]))).otherwise(share("doc_id", 1, taken[1] / int(totals[1])))
    got = sets(rows.filter(part)).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()  # about fit_rows rows
    lists = got.column("places").combine_chunks()
    places = np.split(lists.values.to_numpy(), lists.offsets.to_numpy()[1:-1])
    y = np.where(got.column("label").to_numpy() == 1, 1.0, -1.0)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, bias = dual_descent(places, y, ratio, weight)
    model = Model(ratio, w, bias)
    m = np.array([model.margin(x) for x in places])
    # The score is a logistic curve through one half at the cut that separates the sample's classes best.
    order = np.argsort(m)
    good = np.cumsum(np.where(y[order] < 0, weight[order], -weight[order]))
    best = np.flatnonzero(good == good.max())
    cuts = (m[order] + np.append(m[order][1:], m[order][-1:] + 1)) / 2
    middle = float(cuts[best].mean())
    spread = max(float(np.std(m)), 1e-6)
    model.slope, model.shift = 3 / spread, -3 / spread * middle
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted of every row. Without a model every score is one half and all is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = Features(), shared.value
        for b in (s for batch in batches for s in slices(batch)):
            scores = [0.5 if m is None else float(m.score(m.margin(indicators(t, memo)))) for t in utf8(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of about LABELLED_ROWS labelled documents at most, outside the held-out fold.

    Their labels are sent to the tasks, and the documents stay where they are.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(fold() != 1).groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = F.broadcast(marks.filter(share("doc_id", 0, LABELLED_ROWS / max(1, marks.count()))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(fold() != 1).join(marks, "doc_id")


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learnt from the labelled rows that are not held out.

    The ratios are taken from about LABELLED_ROWS of those rows at most, the model is fitted on about fit_rows of them, both even
    shares by hash; every whole text is scored.

    Null and empty texts have one indicator, their length's; rows that repeat score alike; an empty table gives none; labels of
    one document that differ count as good; other columns are ignored.
    """
    model = train(cut(training_rows(docs, labels), "labelled"), fit_rows)
    return score(docs, model).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all their columns, whatever their names, that the model does not reject.

    Null and empty texts are judged by their length's indicator, very long ones whole; repeated rows are judged alike; an empty
    table stays empty. Without a model, as where no row is labelled, all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = Features(), shared.value
        for b in (s for batch in batches for s in slices(batch)):
            yield b if m is None else b.filter(pa.array([bool(m.score(m.margin(indicators(t, memo))) >= 0.5) for t in utf8(b)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
