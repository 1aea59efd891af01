"""Toxicity by a classifier chain of linear models.

Categories of toxicity are predicted one after another. The model of each sees hashed
word presence (of words and of their beginnings), the log of the length and the
probabilities of the categories before it. In training those are out-of-fold: each
row's come from a model that did not see it, so a later model learns to trust them as
far as they hold on new rows. Each category's decision threshold is the one of best F1
on its out-of-fold probabilities; of equally good ones, the highest.

Categories are the columns of the labels, in the order given; the query takes
``low_quality`` (labels' quality 0), then ``toxic``. No words are listed by hand.

Fitting uses at most ``max_rows`` labelled documents, those of least hash of
their id, and of equal hashes the least id. Of several rows of labels with one id the
least counts, of several documents with one id the least text. Features that fewer
than ``least_rows`` of them have are left out. Every document is scored, whole.

A null or empty text has no words and gets the models' intercepts. Rows with a
null label are not learned from. Without any labelled row, or with one class
only, a category's probability is the share of that class. Repeated rows are
scored alike, an empty table gives none. Texts are read in slices; a longer one is a
slice of its own and takes memory in proportion. Other columns are not read, so
clashing names cannot arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import tidy
from .words import U64, Words, mix64, slices

DIMS = 1 << 20
PREFIXES = (4, 5)  # bytes


class Rows:
    """Sparse binary features of texts: distinct hashed words and beginnings of words, and the log of the number of words."""

    def __init__(self, column: pa.Array, dims: int = DIMS):
        words = Words(column, lower=True, punctuation=True)
        owner = words.owner().astype(U64) << U64(32)
        parts = words.hash(prefixes=PREFIXES)
        key = np.unique(np.concatenate([owner | (mix64(h + U64(k)) % U64(dims)) for k, h in enumerate(parts)]))
        self.index = (key & U64(0xFFFFFFFF)).astype(np.int64)
        self.at = np.searchsorted(key >> U64(32), np.arange(len(words.n) + 1, dtype=U64))
        self.length = np.log1p(words.n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[at[1:]] - sums[at[:-1]]


def least(value_and_slope, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimum of a smooth convex function by limited-memory BFGS with halved steps."""
    value, slope = value_and_slope(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, used = slope.copy(), []
        for s, y in reversed(pairs):
            used.append((s @ way) / (y @ s))
            way -= used[-1] * y
        if pairs:
            way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            way += s * (a - (y @ way) / (y @ s))
        step, fall = 1.0 if pairs else 1.0 / max(1.0, np.abs(slope).sum()), slope @ way
        while True:
            nxt = x - step * way
            new_value, new_slope = value_and_slope(nxt)
            if new_value <= value - 1e-4 * step * fall or step < 1e-8:
                break
            step /= 2
        if new_value >= value - 1e-9:
            break
        if (new_slope - slope) @ (nxt - x) > 1e-12:
            pairs = [*pairs, (nxt - x, new_slope - slope)][-memory:]
        x, value, slope = nxt, new_value, new_slope
    return x


class Linear:
    """Logistic regression with an L2 penalty.

    Features are scaled by their log count ratio between the classes; those with
    one below ``least_ratio`` are left out, so words of both classes add no noise.
    """

    least_ratio = 1.0

    def __init__(self, dims: int, n_extra: int):
        self.w, self.extra, self.bias = np.zeros(dims), np.zeros(n_extra), 0.0

    def logits(self, index: np.ndarray, at: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return row_sums(self.w[index], at) + extra @ self.extra + self.bias

    def fit(self, index: np.ndarray, at: np.ndarray, extra: np.ndarray, y: np.ndarray, steps: int, penalty: float) -> Linear:
        share = y.mean() if len(y) else 0.0
        if share in (0.0, 1.0):
            self.bias = -20.0 if share == 0 else 20.0
            return self
        owner = np.repeat(np.arange(len(y)), np.diff(at))
        yes = np.bincount(index, y[owner], len(self.w))
        no = np.bincount(index, minlength=len(self.w)) - yes
        ratio = np.log((yes + 1) / (y.sum() + 2)) - np.log((no + 1) / ((1 - y).sum() + 2))
        used = np.flatnonzero(np.abs(ratio) >= self.least_ratio)
        place = np.full(len(self.w), -1, np.int32)
        place[used] = np.arange(len(used))
        index = place[index]
        owner, index = owner[index >= 0], index[index >= 0]
        ratio, n = ratio[used], len(y)
        dense = np.column_stack([extra, np.ones(n)])
        size = len(used)

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            z = np.bincount(owner, (x[:size] * ratio)[index], n) + dense @ x[size:]
            error = sigmoid(z) - y
            value = float(np.logaddexp(0, np.where(y > 0, -z, z)).mean() + penalty / 2 * (x[:-1] @ x[:-1]))
            slope = np.concatenate([ratio * np.bincount(index, error[owner], size), dense.T @ error]) / n
            slope[:-1] += penalty * x[:-1]
            return value, slope

        start = np.zeros(size + dense.shape[1])
        start[-1] = np.log(share / (1 - share))
        x = least(loss, start, steps)
        self.w[used], self.extra, self.bias = x[:size] * ratio, x[size:-1], float(x[-1])
        return self


def take(index: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(at)[rows]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return index[np.arange(out[-1]) + np.repeat(at[rows] - out[:-1], sizes)], out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of best F1; in the middle between the probabilities on its two sides."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum()) if len(p) and y.sum() else np.zeros(len(p))
    if not len(f1) or not f1.max():
        return 0.5
    k = int(f1.argmax())
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0.0)) / 2)


class Chain:
    def __init__(self, categories: tuple[str, ...], dims: int = DIMS, folds: int = 3, steps: int = 25, penalty: float = 1e-4, least_rows: int = 8):
        self.categories, self.dims, self.folds, self.steps = categories, dims, folds, steps
        self.penalty, self.least_rows = penalty, least_rows
        self.models: list[Linear] = []
        self.thresholds: list[float] = []

    def fit(self, index: np.ndarray, at: np.ndarray, length: np.ndarray, labels: np.ndarray) -> Chain:
        """labels: [row, category]."""
        n = len(length)
        common = np.bincount(index, minlength=self.dims) >= self.least_rows
        keep = common[index]
        at, index = np.concatenate([[0], np.cumsum(keep)])[at], index[keep]
        columns = np.flatnonzero(common)
        place = np.zeros(self.dims, np.int32)
        place[columns] = np.arange(len(columns))
        index = place[index]
        extra = length[:, None]
        fold = np.random.default_rng(0).permutation(n) % self.folds
        for k in range(len(self.categories)):
            y, out = labels[:, k].astype(float), np.zeros(n)
            for f in range(self.folds):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                model = self._new(columns, extra).fit(*take(index, at, train), extra[train], y[train], self.steps, self.penalty)
                out[test] = sigmoid(model.logits(*take(index, at, test), extra[test]))
            model = self._new(columns, extra).fit(index, at, extra, y, self.steps, self.penalty)
            wide = np.zeros(self.dims, np.float32)
            wide[columns] = model.w
            model.w = wide
            self.models.append(model)
            self.thresholds.append(best_threshold(out, y))
            extra = np.column_stack([extra, out])
        self.out_of_fold = extra[:, 1:]
        return self

    @staticmethod
    def _new(columns: np.ndarray, extra: np.ndarray) -> Linear:
        return Linear(len(columns), extra.shape[1])

    def predict(self, rows: Rows) -> np.ndarray:
        extra = rows.length[:, None]
        for model in self.models:
            extra = np.column_stack([extra, sigmoid(model.logits(rows.index, rows.at, extra))])
        return extra[:, 1:]


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"), max_rows: int = 8_000, **parameters) -> Chain:
    """``labels``: doc_id and a 0/1 column for each category."""
    whole = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    whole = whole.groupBy("doc_id").agg(F.min(F.struct(*categories)).alias("y")).select("doc_id", "y.*")
    some = F.broadcast(whole.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))  # the documented bound
    names = ["doc_id", *categories]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = Rows(part.column("text"))
                body = [rows.index[a:b].astype("<i4").tobytes() for a, b in zip(rows.at[:-1], rows.at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(rows.length), pa.array(body, pa.binary())], [*names, "length", "words"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} int' for c in categories)}, length double, words binary"
    known = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(some, "doc_id")
    known = known.groupBy("doc_id", *categories).agg(F.min("text").alias("text"))
    found = known.select("doc_id", "text", *categories).mapInArrow(features, schema).toPandas().sort_values("doc_id")
    parts = [np.frombuffer(b, "<i4") for b in found["words"]]
    index = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return Chain(categories, **parameters).fit(index, at, found["length"].to_numpy(float), found[list(categories)].to_numpy())


def predicted(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> and <category> (boolean) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # DIMS floats a category
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                p = shared.value.predict(Rows(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(names)))], ["doc_id", *names])
        tidy()

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} double' for n in names)}")
    return out.select("*", *[(F.col(n) >= t).alias(c) for n, c, t in zip(names, chain.categories, chain.thresholds, strict=True)])
