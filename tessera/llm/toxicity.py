"""Classifier chains for toxicity categories.

Categories are predicted one after the other: each is a sparse logistic model over binary features (hashed words
and binned shape measures of the text) and over the log-odds of all earlier categories. For training, those earlier
log-odds are out-of-fold predictions, so a later model sees its predecessors as they behave on unseen rows; for
prediction the models refitted on all training rows are used.

The models are fitted on the driver from at most ``max_rows`` labelled rows (those of the smallest hash of doc_id,
so the choice does not depend on partitions); prediction streams every whole text and never shuffles.

Defined results: null and blank texts have only shape features; labels that are null or whose document is missing
are not used; a category whose training labels are all equal gets that constant rate; without training rows all
probabilities are the least that the models give (0.0003); rows that repeat a labelled id are training rows each; rows
of equal text get equal probabilities; very long texts are taken whole, in arrays of a few dozen bytes a word; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import LOWER, NOT_WORD, byte_words, flat_batches

DIMS = 1 << 18
SHAPES = 64  # the last buckets, for shape measures


def _bins(texts: list[str], n_words: np.ndarray) -> np.ndarray:
    """A bin (0 to 7) for each of eight shape measures of each text."""
    out = np.zeros((len(texts), 8), np.int64)
    for i, t in enumerate(texts):
        b = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        n = max(1, len(b))
        upper = np.count_nonzero((b >= 65) & (b <= 90)) / n
        digits = np.count_nonzero((b >= 48) & (b <= 57)) / n
        space = np.count_nonzero(b == 32) / n
        lines = np.count_nonzero(b == 10) / n
        marks = np.count_nonzero((b > 32) & (b < 127) & NOT_WORD[b]) / n
        odd = np.count_nonzero(np.isin(b, np.frombuffer(b"#$%&*|!<>{}@", np.uint8))) / n
        w = max(1, int(n_words[i]))
        measures = (np.log2(n) / 2, upper * 20, digits * 30, space * 20, lines * 200, marks * 25, odd * 40, (n - marks * n - space * n) / w / 1.5)
        out[i] = np.clip(np.array(measures).astype(np.int64), 0, 7)
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the distinct binary features of texts, ordered by owner."""
    hashes, offsets, n_words = byte_words(texts, NOT_WORD, LOWER)
    owner = np.repeat(np.arange(len(texts)), n_words)
    bucket = (hashes >> np.uint64(13)) % np.uint64(DIMS - SHAPES)
    shape = _bins(texts, n_words) + np.arange(8) * 8 + DIMS - SHAPES
    keys = np.concatenate([owner * DIMS + bucket.astype(np.int64), (np.arange(len(texts))[:, None] * DIMS + shape).reshape(-1)])
    keys = np.unique(keys)
    return keys // DIMS, keys % DIMS


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def score(self, owner: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=self.weights[bucket], minlength=len(dense)) + dense @ self.extra + self.bias


def fit_linear(owner: np.ndarray, bucket: np.ndarray, dense: np.ndarray, y: np.ndarray, lasso: float = 2.5e-4, steps: int = 150) -> Linear:
    """L1-penalised logistic regression by accelerated proximal gradient; balanced class weights."""
    n, k = dense.shape
    if n == 0 or y.min() == y.max():
        rate = float(np.clip(y.mean() if n else 0.0, 1e-9, 1 - 1e-9))
        return Linear(np.zeros(DIMS), np.zeros(k), float(np.log(rate / (1 - rate))))
    used, column = np.unique(bucket, return_inverse=True)
    frequent = np.bincount(column) >= 3
    keep = frequent[column]
    number = np.cumsum(frequent) - 1
    used, column, owner = used[frequent], number[column[keep]], owner[keep]
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    step = 1.0 / (0.25 * share.max() * n * 8)
    w, x, b = np.zeros(len(used)), np.zeros(k), 0.0
    vw, vx, vb, t = w.copy(), x.copy(), b, 1.0
    # columns differ much in frequency: each has its own step, from the curvature's diagonal bound
    scale = step / np.maximum(np.bincount(column, weights=share[owner], minlength=len(used)) * 4, 0.02)
    for _ in range(steps):
        z = np.bincount(owner, weights=vw[column], minlength=n) + dense @ vx + vb
        r = (logistic(z) - y) * share
        g = np.bincount(column, weights=r[owner], minlength=len(used))
        nw = vw - scale * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - scale * lasso, 0)
        nx, nb = vx - step * (dense.T @ r), vb - step * r.sum()
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((vw - nw) * (nw - w)).sum() > 0:  # the momentum points uphill: start it anew
            u = t = 1.0
        m = (t - 1) / u
        vw, vx, vb = nw + m * (nw - w), nx + m * (nx - x), nb + m * (nb - b)
        w, x, b, t = nw, nx, nb, u
    full = np.zeros(DIMS)
    full[used] = w
    return Linear(full, x, float(b))


@dataclass
class ToxicityChain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities (texts x categories)."""
        owner, bucket = features(texts)
        out = np.zeros((len(texts), len(self.categories)))
        dense = np.zeros((len(texts), 0))
        for i, m in enumerate(self.models):
            z = np.clip(m.score(owner, bucket, dense), -8, 8)
            out[:, i] = logistic(z)
            dense = np.column_stack([dense, z / 4])
        return out


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_rows: int = 12_000, folds: int = 3) -> ToxicityChain:
    """Fits the chain in the order of ``categories`` (name: SQL for a 0/1 value over ``labels``)."""
    names = [f"_y{i}" for i in range(len(categories))]
    rows = labels.select(F.col("doc_id").alias("_id"), *(F.expr(e).cast("int").alias(n) for n, e in zip(names, categories.values())))
    rows = rows.na.drop().orderBy(F.xxhash64("_id"), "_id", *names).limit(max_rows)
    # at most max_rows ids with their labels: a proven bound for the broadcast
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), F.col("doc_id") == F.col("_id"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in flat_batches(batches):
            owner, bucket = features(texts)
            at = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))), *(batch.column(i) for i in range(2, batch.num_columns))], ["doc_id", "f", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = picked.select("doc_id", "text", *names).mapInArrow(extract, f"doc_id {kind}, f array<int>, {', '.join(f'{n} int' for n in names)}").toArrow().sort_by("doc_id")
    lists = table.column("f").combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(lists)) if len(lists) else np.zeros(0, np.int64)
    owner, bucket = np.repeat(np.arange(len(table)), sizes), np.asarray(pa.compute.list_flatten(lists)).astype(np.int64)
    fold = np.arange(len(table)) % folds
    dense, chain = np.zeros((len(table), 0)), ToxicityChain(list(categories))
    for n in names:
        y = np.asarray(table.column(n)).astype(np.float64)
        out = np.zeros(len(table))
        if n != names[-1]:
            for k in range(folds):
                inside = fold != k
                number = np.cumsum(inside) - 1
                keep = inside[owner]
                m = fit_linear(number[owner[keep]], bucket[keep], dense[inside], y[inside])
                out[~inside] = np.clip(m.score(owner, bucket, dense)[~inside], -8, 8)
        chain.models.append(fit_linear(owner, bucket, dense, y))
        dense = np.column_stack([dense, out / 4])
    return chain


def score(docs: DataFrame, chain: ToxicityChain) -> DataFrame:
    """(doc_id, one probability for each category) of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = chain.categories
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # categories x DIMS weights, a fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in flat_batches(batches):
            p = sent.value.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(p.shape[1]))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'`{c}` double' for c in chain.categories)}")
