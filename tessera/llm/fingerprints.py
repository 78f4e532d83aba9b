"""Context-triggered piecewise hashing of whole texts.

A rolling hash over seven bytes ends a piece wherever its low bits are zero; each piece becomes a twelve-bit
symbol (two letters), and a fingerprint is ``block:signature:signature at twice the block``. The block size is the
power of two at which the text has at most 64 pieces, halved while the signature has fewer than 32. Two
fingerprints are compared where their block sizes agree (equal, or one twice the other): the likeness is
``1 - d / (len a + len b)``, d being the edit distance with insertions and deletions, computed bit-parallel for
many pairs at once. Signatures of incompatible block sizes have likeness 0; equal fingerprints have 1.

Defined results: null text counts as empty, whose fingerprint is ``1::``; equal texts have equal fingerprints; a null
doc_id comes after all others; repeated rows each get their own row, neighbours in the order; very long texts are hashed
whole, a few arrays of a word for each byte; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import materialize, mix64

PIECES = 64
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_CODE = np.zeros(256, dtype=np.uint16)
_CODE[LETTERS] = np.arange(64, dtype=np.uint16)


def _rolling(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the seven bytes that end at each byte (fewer at the start)."""
    c = 0x01000193
    b = data.astype(np.uint32) + np.uint32(1)
    pair = b.copy()
    pair[1:] += b[:-1] * np.uint32(c)
    four = pair.copy()
    four[2:] += pair[:-2] * np.uint32(c**2 & 0xFFFFFFFF)
    out = four
    out[4:] += pair[:-4] * np.uint32(c**4 & 0xFFFFFFFF)
    out[6:] += b[:-6] * np.uint32(c**6 & 0xFFFFFFFF)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def _signature(total: np.ndarray, ends: np.ndarray, n: int) -> str:
    """Two letters for each piece; the last symbol stands for all from the 64th piece on."""
    cuts = ends[: PIECES - 1] + 1
    if n and (len(cuts) == 0 or cuts[-1] < n):
        cuts = np.append(cuts, n)
    if len(cuts) == 0:
        return ""
    sums = np.diff(total[cuts - 1], prepend=np.uint64(0))
    v = (mix64(sums + np.diff(cuts, prepend=0).astype(np.uint64)) >> np.uint64(52)).astype(np.uint16)
    return np.stack([LETTERS[v >> 6], LETTERS[v & 63]], axis=1).tobytes().decode("ascii")


def fingerprint(raw: bytes) -> str:
    """The fingerprint of some bytes."""
    n = len(raw)
    if n == 0:
        return "1::"
    rolled = _rolling(np.frombuffer(raw, dtype=np.uint8))
    block = 1
    while block * PIECES < n:
        block *= 2
    total = np.cumsum(rolled, dtype=np.uint64)
    at = max(1, block // 8)
    triggers = np.flatnonzero((rolled & np.uint32(at - 1)) == 0)
    values = rolled[triggers]
    while True:
        ends = triggers[(values & np.uint32(block - 1)) == 0]
        if len(ends) >= PIECES // 2 or block == 1:
            break
        block //= 2
        if block < at:
            at = max(1, block // 8)
            triggers = np.flatnonzero((rolled & np.uint32(at - 1)) == 0)
            values = rolled[triggers]
    double = triggers[(values & np.uint32(2 * block - 1)) == 0]
    return f"{block}:{_signature(total, ends, n)}:{_signature(total, double, n)}"


def _symbols(signatures: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, signatures), dtype=np.int64, count=len(signatures)) // 2
    flat = _CODE[np.frombuffer("".join(signatures).encode("ascii"), dtype=np.uint8)].reshape(-1, 2)
    out = np.full((len(signatures), PIECES), pad, dtype=np.uint16)
    out[np.arange(PIECES) < lengths[:, None]] = flat[:, 0] * np.uint16(64) + flat[:, 1]
    return out, lengths


def signature_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """``1 - d / (len a + len b)`` of each pair of signatures, d: insertions and deletions."""
    out = np.zeros(len(left))
    for i in range(0, len(left), 4096):
        a, n = _symbols(left[i : i + 4096], 0xFFFF)
        b, m = _symbols(right[i : i + 4096], 0xFFFE)
        rows = np.full(len(a), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for j in range(int(m.max(initial=0))):
            equal = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
            both = rows & equal
            rows = (rows + both) | (rows - both)
        common = np.bitwise_count(~rows).astype(np.float64)
        out[i : i + 4096] = np.where(n + m > 0, 2 * common / np.maximum(n + m, 1), 1.0)
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness (0 to 1) of pairs of fingerprints."""
    out = np.zeros(len(left))
    where: list[int] = []
    one: list[str] = []
    two: list[str] = []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        bx, x1, x2 = x.split(":")
        by, y1, y2 = y.split(":")
        p, q = int(bx), int(by)
        for ok, s, t in ((p == q, x1, y1), (p == q, x2, y2), (p == 2 * q, x1, y2), (q == 2 * p, x2, y1)):
            if ok:
                where.append(i)
                one.append(s)
                two.append(t)
    if where:
        np.maximum.at(out, where, signature_likeness(one, two))
    return out


def edited(text: str, following: str) -> str:
    """``text`` whose last half (rounded down, in code points) is replaced by as many first ones of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(items: list[tuple[int | None, str, str, str, str]]) -> dict[str, list]:
    """items: (doc_id, text, fingerprint, next text, next fingerprint)."""
    out: dict[str, list] = {"doc_id": [], "n_chars": [], "edited_sha256": [], "fingerprint": [], "edited_fingerprint": []}
    following = []
    for doc_id, text, own, next_text, next_own in items:
        raw = edited(text, next_text).encode("utf-8", "surrogatepass")
        for k, v in zip(out, (doc_id, len(text), hashlib.sha256(raw).hexdigest(), own, fingerprint(raw))):
            out[k].append(v)
        following.append(next_own)
    out["near_edited"] = likeness(out["fingerprint"], out["edited_fingerprint"]).tolist()
    out["near_next"] = likeness(out["fingerprint"], following).tolist()
    return out


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Documents are ordered by descending doc_id (ties by text hash, null last); the next of the last is the first.
    They are dealt by ranges of doc_id, and each task compares neighbours as it streams its sorted rows, holding
    one row back. The two rows at the ends of each range meet their neighbours in a second step over a row or two
    a range. One text, one document or an empty table need nothing special: a sole document is its own next.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id"), F.col("_tie"))
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
    )
    # in ascending order, a document's "next" is the row before it; the first row's is the table's last
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()), *_FIELDS])

    def within(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = None
        end = lambda kind, row: pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "doc_id": row[0], "text": row[1], "fingerprint": row[2]}], schema)
        for b in batches:
            items, size = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = (doc_id, text, fingerprint(text.encode("utf-8", "surrogatepass")))
                if before is None:
                    yield end(1, row)
                else:
                    items.append((*row, *before[1:]))
                    size += len(text)
                before = row
                if size >= 2_000_000 or len(items) >= 2000:
                    yield _batch(items, part, schema)
                    items, size = [], 0
            if items:
                yield _batch(items, part, schema)
        if before is not None:
            yield end(2, before)

    done = materialize(ordered.mapInArrow(within, f"kind int, part int, text string, {RESULT}"), "fingerprints")
    columns = [n for n, _ in _FIELDS]
    # a head and a tail for each range that has rows: as few rows as there are partitions
    w = Window.orderBy("part")
    heads = done.where("kind = 1").select("part", "doc_id", "text", "fingerprint")
    tails = done.where("kind = 2").select("part", F.col("text").alias("t"), F.col("fingerprint").alias("f"))
    ends = tails.withColumn("after", F.coalesce(F.lead("part").over(w), F.min("part").over(Window.partitionBy())))

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _rows(list(zip(*(b.column(i).to_pylist() for i in range(5)))))
            yield pa.RecordBatch.from_pydict(rows, pa.schema(_FIELDS))

    edges = heads.join(ends.select(F.col("after").alias("part"), "t", "f"), "part").select("doc_id", "text", "fingerprint", "t", "f").mapInArrow(across, RESULT)
    return done.where("kind = 0").select(*columns).unionByName(edges)


def _batch(items: list, part: int, schema: pa.Schema) -> pa.RecordBatch:
    rows = _rows(items)
    n = len(items)
    return pa.RecordBatch.from_pydict({"kind": [0] * n, "part": [part] * n, "text": [None] * n, **rows}, schema)
