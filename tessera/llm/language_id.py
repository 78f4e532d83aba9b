"""Language identification as inference of a mixture of languages.

*Model.* Byte trigrams of the lower-cased text (bytes of ASCII non-letters count as one space, runs of spaces
once) fall into ``BUCKETS`` hashed buckets; each language has smoothed trigram probabilities, counted over all
labelled training documents with one aggregation.

*Inference.* A document is a mixture of languages. Expectation-maximisation estimates the proportions from the
trigram likelihoods. The set of languages is chosen by penalised likelihood: beginning with the best single
language, the language that raises the likelihood most joins the set while the rise exceeds
``penalty * log(number of trigrams)``. Every learned language can join. As the mixture of all of them bounds what any
set can reach, one estimate over all of them settles documents in one language.

Defined results: ``und`` with score 0 for null, blank or letterless texts and without training rows; ties go to
the language first in order; repeated rows get equal results; very long texts are counted whole, in arrays of the
size of a chunk; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import flat_batches, lean

BUCKETS = 1 << 13
_AS = np.arange(256, dtype=np.uint8)
_AS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigram_buckets(text: str) -> np.ndarray:
    """The bucket of each trigram of a text, in order."""
    b = _AS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    space = b == 32
    b = b[~(space & np.roll(space, 1))] if len(b) > 1 else b
    b = np.concatenate([[32], b]).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    h = h * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - 13)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    probabilities: np.ndarray  # BUCKETS x languages
    penalty: float = 3.0
    steps: int = 25

    def mixture(self, p: np.ndarray, c: np.ndarray, n: float, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log likelihood after expectation-maximisation."""
        for _ in range(self.steps):
            q = p @ weights
            new = weights * ((c / q) @ p) / n
            if np.abs(new - weights).max() < 1e-4:
                weights = new
                break
            weights = new
        return weights, float(c @ np.log(p @ weights))

    def infer(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """(language, its proportion, all languages of the set, their proportions)."""
        return self.explain(text)[:4]

    def explain(self, text: str | None) -> tuple[str, float, list[str], list[float], float]:
        """As ``infer``, and how much better than chance the mixture explains a trigram, as a mean logarithm."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, [], [], 0.0
        counts = np.bincount(trigram_buckets(text), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        c, p = counts[at].astype(np.float64), self.probabilities[at]
        n = float(c.sum())
        single = c @ np.log(p)
        order = np.argsort(-single, kind="stable")
        chosen, level, weights = [int(order[0])], float(single[order[0]]), np.ones(1)
        cost = self.penalty * math.log(n + 1)
        if len(order) > 1:
            _, most = self.mixture(p[:, order], c, n, np.full(len(order), 1 / len(order)))
            while most - level > cost and len(chosen) < len(order):
                tried = [(self.mixture(p[:, [*chosen, int(k)]], c, n, np.full(len(chosen) + 1, 1 / (len(chosen) + 1))), int(k)) for k in order if k not in chosen]
                (w, best), k = max(tried, key=lambda x: x[0][1])
                if best - level <= cost:
                    break
                chosen, level, weights = [*chosen, k], best, w
        rank = np.argsort(-weights, kind="stable")
        names = [self.languages[chosen[i]] for i in rank]
        return names[0], float(min(1.0, weights[rank[0]])), names, [float(weights[i]) for i in rank], level / n + math.log(BUCKETS)


def fit(labelled: DataFrame, smoothing: float = 0.5, **options) -> LanguageModel:
    """Counts trigrams of all rows with text and lang; only a table of languages x buckets reaches the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang] += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(lean(count), "lang string, bucket long, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    number = {x: i for i, x in enumerate(languages)}
    counts[found["bucket"].to_numpy(np.int64), found["lang"].map(number).to_numpy(np.int64)] = found["n"].to_numpy()
    counts += smoothing
    return LanguageModel(languages, counts / counts.sum(axis=0), **options)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, languages, proportions) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in flat_batches(batches):
            names, scores, sets, shares = zip(*map(model.infer, texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                ["doc_id", "lang_pred", "score", "languages", "proportions"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, languages array<string>, proportions array<double>")


def held_out(col: str = "doc_id") -> "F.Column":
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the rows whose language cannot be told.

    Those are texts without letters and texts whose trigrams the chosen mixture explains no better than chance (all
    buckets alike). A text in several languages stays. The decision is taken row by row as texts stream by; a missing
    lang is filled in. A model without languages (no labelled rows) can only tell that a text has no letters.
    """
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in flat_batches(batches):
            found = [model.explain(t) for t in texts]
            at = batch.schema.get_field_index("lang")
            lang = [x if x is not None else f[0] for x, f in zip(batch.column(at).to_pylist(), found)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(lang, pa.string()))
            keep = [f[0] != "und" and f[4] > 0 for f in found] if model.languages else [has_letter(t) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), schema)
