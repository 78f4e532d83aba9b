"""Stupid-backoff language-model scores of every document, each against all the others.

Counts of n-grams (orders 1 to ``order``) are taken over the whole corpus, and a document's own occurrences are
taken off before it is scored, so a text is judged by what the rest of the corpus has.

1. *Batches.* Documents are packed, whole, into batches of about ``batch_chars`` characters, a table in the shared
   folder: later steps find the same documents in the same order however often a task runs.
2. *Count tables, partitioned by hash.* Each batch explodes its n-grams, counts the distinct ones, and sends each
   partition of the hash space its slice (sorted hashes and counts, packed). However common an n-gram is, a batch
   sends it once. A partition adds the slices of all batches up. The number of partitions grows with the corpus and
   that of a batch's slices with it, up to one for each of its distinct n-grams and never beyond: in the limit a slice
   is a row (n-gram hash, batch, count).
3. *Join.* Each slice returns to its batch as the corpus counts of its n-grams, in the same order. The batch joins
   them to its exploded n-grams, takes each document's own counts off, and sums per document:
   ``log(c(w1..wk) / c(w1..wk-1))`` where the n-gram occurs elsewhere, else ``log(alpha)`` plus the score of the
   n-gram without its first word, down to ``log(c(w) / N)``; a word that nobody else has counts ``1 / N``'s share of
   one occurrence.

Words are those between ASCII white space, A-Z in lower case. Defined results: null and blank texts have no words,
a sum of 0 and a null mean; a null doc_id is kept; repeated rows count as different documents; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import LOWER, SPACE, byte_words, chunks, doc_of, materialize, mix64, string_list, temporary_tables


#: Fewer integers than this are packed as they are: a frame's head would outweigh what it saves.
_FEW = 32


def pack_integers(values: np.ndarray) -> bytes:
    """Unsigned integers, byte planes apart, compressed."""
    if len(values) < _FEW:
        return values.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes())


def unpack_integers(raw: bytes, dtype: str, n: int) -> np.ndarray:
    if n < _FEW:
        return np.frombuffer(raw, dtype, n)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def make_batches(docs: DataFrame, batch_chars: int) -> DataFrame:
    """(batch, ids, packed, n_words): whole documents packed together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        ids: list = []
        texts: list[str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            sizes = np.array([len(r) for r in raw], np.uint32)
            n = sum(len(r.split()) for r in raw)
            return pa.RecordBatch.from_pydict({"batch": [uuid.uuid4().hex], "ids": [list(ids)], "packed": [sizes.tobytes() + packer.compress(b"".join(raw))], "n_words": [n]}, schema)

        schema = pa.schema([("batch", pa.string()), ("ids", pa.list_(pa.int64())), ("packed", pa.binary()), ("n_words", pa.int64())])
        for b in batches:
            found, known = string_list(b.column(1)), b.column(0).to_pylist()
            for i, j in chunks(found, batch_chars):
                ids += known[i:j]
                texts += found[i:j]
                size += sum(map(len, found[i:j]))
                if size >= batch_chars:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "batch string, ids array<long>, packed binary, n_words long")


def batch_texts(ids: list, packed: bytes) -> list[str]:
    sizes = np.frombuffer(packed, np.uint32, len(ids))
    raw = zstandard.ZstdDecompressor().decompress(packed[4 * len(ids) :])
    ends = np.cumsum(sizes, dtype=np.int64)
    return [raw[e - s : e].decode("utf-8", "surrogatepass") for s, e in zip(sizes.tolist(), ends.tolist())]


def rows_of(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[dict]:
    """The rows of Arrow batches, of which ``size`` at a time become Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield from b.slice(i, size).to_pylist()


def ngrams(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(document of each word, for each order the hashes of the n-grams that end at each word, and whether there is one)."""
    words, n_words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in chunks(texts):  # hashing takes some forty bytes a character
        found, _, counts = byte_words(texts[i:j], SPACE, LOWER)
        words.append(found)
        n_words.append(counts)
    words, offsets = np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(n_words))])
    owner, n = doc_of(offsets), len(words)
    place = np.arange(n) - offsets[:-1][owner]
    hashes, valid = [mix64(words)], [np.ones(n, bool)]
    for k in range(2, order + 1):
        h = np.zeros(n, np.uint64)
        # the n-gram is its first n - 1 words, then its last word
        h[1:] = mix64(hashes[-1][:-1] * np.uint64(3) + words[1:] + np.uint64(k))
        hashes.append(h)
        valid.append(place >= k - 1)
    return owner, hashes, valid


def score_documents(docs: DataFrame, order: int = 2, alpha: float = 0.4, batch_chars: int = 4_000_000, part_ngrams: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log, n_backoff) of every whole text; a stored table."""
    with temporary_tables(docs.sparkSession) as keep:
        return keep(_scores(docs, order, alpha, batch_chars, part_ngrams), "scores")


def _scores(docs: DataFrame, order: int, alpha: float, batch_chars: int, part_ngrams: int) -> DataFrame:
    batches = materialize(make_batches(docs, batch_chars), "batches")
    total = batches.agg(F.sum("n_words")).first()[0] or 0
    bits = min(31, max(4, math.ceil(math.log2(max(1, order * total / part_ngrams)))))

    def explode(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(rows, 1):
            _, hashes, valid = ngrams(batch_texts(row["ids"], row["packed"]), order)
            out: list[tuple] = []
            for k in range(order):
                values, counts = np.unique(hashes[k][valid[k]], return_counts=True)
                part = (values >> np.uint64(64 - bits)).astype(np.int64)
                begin = np.flatnonzero(np.diff(part, prepend=-1))
                # only parts that the batch has n-grams in: no more slices than n-grams, however many parts there are
                for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(values)]):
                    deltas = np.diff(values[i:j], prepend=np.uint64(0))
                    out.append((int(part[i]), k, row["batch"], j - i, pack_integers(deltas), pack_integers(counts[i:j].astype(np.uint32))))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.binary())], ["part", "k", "batch", "n", "hashes", "counts"])

    def add_up(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            values = np.concatenate([np.cumsum(unpack_integers(r["hashes"], "u8", r["n"]), dtype=np.uint64) for r in held])
            counts = np.concatenate([unpack_integers(r["counts"], "u4", r["n"]) for r in held]).astype(np.float64)
            _, where = np.unique(values, return_inverse=True)
            sums = np.bincount(where, weights=counts)[where].astype(np.uint64)
            ends = np.cumsum([r["n"] for r in held])
            blobs = [pack_integers(sums[e - r["n"] : e]) for r, e in zip(held, ends)]
            return pa.RecordBatch.from_pydict({"batch": [r["batch"] for r in held], "k": [r["k"] for r in held], "part": [r["part"] for r in held], "n": [r["n"] for r in held], "sums": blobs}, schema)

        schema = pa.schema([("batch", pa.string()), ("k", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())])
        for r in rows_of(rows, 64):
            if held and (held[0]["part"], held[0]["k"]) != (r["part"], r["k"]):
                yield flush()
                held = []
            held.append(r)
        if held:
            yield flush()

    slices = batches.select("batch", "ids", "packed").mapInArrow(explode, "part int, k int, batch string, n long, hashes binary, counts binary")
    dealt = slices.repartition("part", "k").sortWithinPartitions("part", "k")
    sums = dealt.mapInArrow(add_up, "batch string, k int, part int, n long, sums binary")
    back = sums.groupBy("batch").agg(F.collect_list(F.struct("k", "part", "n", "sums")).alias("sums"))

    def score(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(rows, 1):
            owner, hashes, valid = ngrams(batch_texts(row["ids"], row["packed"]), order)
            n_docs, n = len(row["ids"]), len(owner)
            length = np.bincount(owner, minlength=n_docs)
            others = []  # for each order: occurrences of the n-gram ending here in other documents
            for k in range(order):
                parts = sorted((s for s in row["sums"] or [] if s["k"] == k), key=lambda s: s["part"])
                corpus = np.concatenate([unpack_integers(s["sums"], "u8", s["n"]) for s in parts]) if parts else np.zeros(0, np.uint64)
                at = np.flatnonzero(valid[k])
                values, where = np.unique(hashes[k][at], return_inverse=True)
                _, pair, own = np.unique(owner[at] * max(1, len(values)) + where, return_inverse=True, return_counts=True)
                rest = np.zeros(n)
                rest[at] = corpus[where].astype(np.float64) - own[pair]
                others.append(rest)
            elsewhere = np.maximum(total - length[owner], 1).astype(np.float64)
            logs = np.log(np.where(others[0] > 0, others[0], 1.0 / elsewhere) / elsewhere)
            backed = np.zeros(n, bool)
            for k in range(1, order):
                # the context is the lower n-gram that ends at the word before
                context = np.concatenate([[0.0], others[k - 1][:-1]])
                seen = valid[k] & (others[k] > 0)
                missed = valid[k] & ~seen
                with np.errstate(divide="ignore", invalid="ignore"):
                    logs = np.where(seen, np.log(others[k] / context), np.where(missed, logs + math.log(alpha), logs))
                backed = np.where(valid[k], missed, backed)
            sums = np.bincount(owner, weights=logs, minlength=n_docs).astype(np.float64)
            mean = pa.array(np.divide(sums, length, out=np.zeros(n_docs), where=length > 0), mask=length == 0)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(length.astype(np.int64)), pa.array(sums), mean, pa.array(np.bincount(owner, weights=backed, minlength=n_docs).astype(np.int64))], ["doc_id", "n_words", "log_score", "mean_log", "n_backoff"])

    joined = batches.select("batch", "ids", "packed").join(back.hint("merge"), "batch", "left").select("ids", "packed", "sums")
    return joined.mapInArrow(score, "doc_id long, n_words long, log_score double, mean_log double, n_backoff long")
