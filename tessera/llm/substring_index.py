"""Exact repeated substrings by run-length indexes of the candidates' contexts.

The question for each byte: is it inside a string of ``length`` bytes that also starts in a document with a smaller
doc_id? Documents are whole texts as UTF-8 bytes.

1. *Anchors.* Every string of ``length`` bytes picks one of its ``GRAM``-byte substrings, the one of least hash
   (leftmost of equals). Equal strings pick the same one, so only contexts (an anchor with all bytes that such a
   string can add on either side) of equal anchors can share a string. Anchors are dealt by hash and streamed in
   order of (anchor, context, doc_id): anchors of one document only are done with, and a context met in a smaller
   document is wholly repeated; the first occurrence of each context remains to be compared with the others.
2. *Index.* Those contexts' bytes meet by anchor; a context that shares neither half of a match's other bytes with
   another document can't match and is left out. A task builds, over blocks of whole anchor groups in doc_id order,
   a Burrows-Wheeler transform of bounded context (suffixes ordered by their first ``length`` bytes, ties by
   document), run-length encodes it with runs cut where that prefix changes, and keeps the suffix at each end of
   each run.
3. *Matching statistics.* Each context is streamed backwards through the transform, all contexts of a block in step:
   from the interval of the last ``length`` bytes the last byte is let go (the interval widens to that of one byte
   less) and the byte before is taken on by an LF step over the runs. The sample at the start of the interval's first
   run is the first document with those ``length`` bytes: the statistic reaches ``length`` where that is a smaller one.
4. *Removal.* Marked stretches meet their documents, are united, and cut out.

Equal contexts of an anchor (exact copies for the most part) are settled in step 1 by a 64-bit hash of all their bytes
together with the anchor's own 64 bits; their bytes aren't compared.

Memory: streams hold an Arrow batch; a block holds about ``block_bytes`` of contexts or one anchor's contexts (84
bytes each), after equal contexts were collapsed.

Defined results: null text counts as empty; a null doc_id counts as larger than any other, as do ids within 2^40 of the
largest; texts under ``length`` bytes lose nothing; rows of equal doc_id never mark each other, nor do those without one;
repeated rows each get their own row; very long texts are so many more anchors; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import _INVERSE, _ODD, _powers, flat_batches, let_go, materialize, mix64

GRAM = 16
_LAST = (1 << 63) - 1
#: Documents from here on have no id: 40 bits of their text's hash tell them apart.
_NO_ID = _LAST - (1 << 40)
#: A byte that no UTF-8 text has: it ends each context.
_END = 0xFF


def tag_of(raw: bytes) -> int:
    """Tells rows of one doc_id apart; the packed position leaves 23 bits."""
    return zlib.crc32(raw) & 0x7FFFFF


def anchors(raws: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, position in it, anchor hash, context hash) of the anchors of some documents."""
    flat = np.frombuffer(b"".join(raws), np.uint8)
    n, w = len(flat), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    ends = np.cumsum(sizes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, n), out=total[1:])
    inverse = _powers(_INVERSE, n + 1)
    grams = mix64((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    best = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < w:
        step = min(span, w - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    whole = np.zeros(len(best), bool)
    for b, e in zip(ends - sizes, ends):
        if e - b >= length:
            whole[b : e - length + 1] = True
    at = np.unique((best[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    owner = np.searchsorted(ends, at, side="right")
    left = np.maximum((ends - sizes)[owner], at - (length - GRAM))
    right = np.minimum(ends[owner], at + length)
    context = mix64((total[right] - total[left]) * inverse[left] + (at - left).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (right - at).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return owner, at - (ends - sizes)[owner], grams[at].view(np.int64), context.view(np.int64)


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in flat_batches(batches):
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            owner, at, gram, context = anchors(raws, length)
            tags = np.fromiter(map(tag_of, raws), np.int64, len(raws))
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(context), pa.array(doc[owner]), pa.array((tags[owner] << 40) | at)], ["h", "c", "doc", "at"])

    return docs.mapInArrow(run, "h long, c long, doc long, at long")


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (h, c, doc): kind 0 where the context is in a smaller document, kind 1 where its bytes are needed."""
    h0 = c0 = d0 = None  # the open anchor, its open context and that context's first document
    many = False  # whether the open anchor has had two contexts
    held: list[np.ndarray] = []  # its rows of kind 1 while it has one context
    for b in batches:
        h, c, doc, at = (b.column(i).to_numpy() for i in range(4))
        place = np.minimum(doc, _NO_ID)
        n = len(h)
        if not n:
            continue
        new_h = np.ones(n, bool)
        new_h[1:] = h[1:] != h[:-1]
        new_h[0] = h0 is None or h[0] != h0
        new_c = new_h.copy()
        new_c[1:] |= c[1:] != c[:-1]
        new_c[0] |= c0 is None or c[0] != c0
        run = np.cumsum(new_c)  # 0: the context that was open before
        firsts = place[new_c]
        first = np.where(run > 0, firsts[np.maximum(run - 1, 0)] if len(firsts) else 0, d0 if d0 is not None else 0)
        inside = place > first
        group = np.cumsum(new_h)
        contexts = np.bincount(group, weights=new_c, minlength=group[-1] + 1)
        several = contexts > 1
        if not new_h[0]:
            several[0] = many or contexts[0] > 0
        elif held:  # the open anchor ended with one context
            held = []
        want = ~inside & several[group]
        out = [np.stack([doc[inside], at[inside], h[inside]]), np.stack([doc[want], at[want], h[want]])]
        if not new_h[0] and several[0] and held:
            out[1] = np.concatenate([*held, out[1]], axis=1)
            held = []
        last = group == group[-1]
        if group[-1] > 0:
            held = []
        many = bool(several[group[-1]])
        if not many:
            keep = last & ~inside
            held.append(np.stack([doc[keep], at[keep], h[keep]]))
        h0, c0, d0 = h[-1], c[-1], first[-1]
        both = np.concatenate(out, axis=1)
        kind = np.zeros(both.shape[1], np.int32)
        kind[out[0].shape[1] :] = 1
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(both[2]), pa.array(kind)], ["doc", "at", "h", "kind"])


class RunLengthIndex:
    """A run-length encoded Burrows-Wheeler transform of bounded context, with the suffixes at run ends.

    Its rows are the suffixes with at least ``length - 1`` bytes left in their context, ordered by their first
    ``length`` bytes (the end of a context is one), then by place in the text. Streaming needs the runs' bytes, starts
    and first samples, where the prefixes of ``length - 1`` bytes change, and each context's entry row.
    """

    def __init__(self, text: np.ndarray, rest: np.ndarray, length: int):
        """``text``: bytes of contexts in document order, each ended by ``_END``; ``rest``: bytes left in the context."""
        n, left = len(text), rest + 1
        padded = np.concatenate([text, np.full(8, _END, np.uint8)])
        have = min(8, length - 1)
        key = np.zeros(n, np.uint64)
        for i in range(have):
            key = (key << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
        at = np.flatnonzero(left >= have)
        rank = np.zeros(n, np.uint64)
        rank[at] = np.unique(key[at], return_inverse=True)[1]
        shorter = rank
        for goal in (length - 1, length):
            shorter = rank.copy()
            while have < goal:
                step = min(have, goal - have)
                at = np.flatnonzero(left >= have + step)
                pairs = (rank[at] << np.uint64(32)) | rank[at + step]
                rank[at] = np.unique(pairs, return_inverse=True)[1]
                have += step
        at = np.flatnonzero(left >= length)
        order = np.argsort(rank[at], kind="stable")
        suffixes = at[order]
        self._encode(text[suffixes - 1], suffixes, rank[suffixes], shorter[suffixes], rest[suffixes] == length - 1)

    def _encode(self, before: np.ndarray, suffixes: np.ndarray, whole: np.ndarray, shorter: np.ndarray, entries: np.ndarray) -> None:
        changes = lambda x: np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])
        cut = changes(whole) | changes(before)
        self.run_starts = np.flatnonzero(cut)
        self.run_bytes = before[self.run_starts]
        self.first_samples = suffixes[self.run_starts]
        self.last_samples = suffixes[np.append(self.run_starts[1:], len(suffixes)) - 1] if len(suffixes) else suffixes
        self.shorter_starts = np.flatnonzero(changes(shorter))
        # rows that no LF step reaches: those where a context enters
        rows = np.flatnonzero(entries)
        self.entry_rows, self.entry_positions = rows, suffixes[rows]
        self._reached_before = rows - np.arange(len(rows))
        # runs by byte, then place: how many rows come before each of them in that order
        sizes = np.diff(np.append(self.run_starts, len(suffixes)))
        by_byte = np.argsort(self.run_bytes, kind="stable")
        self._byte_keys = (self.run_bytes[by_byte].astype(np.int64) << 40) | self.run_starts[by_byte]
        self._byte_sizes = sizes[by_byte]
        self._byte_sums = np.cumsum(self._byte_sizes) - self._byte_sizes

    def step(self, rows: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """From the first rows of intervals, the first row of each interval with ``byte`` put before and the last byte let go."""
        start = self.shorter_starts[np.searchsorted(self.shorter_starts, rows, side="right") - 1]
        run = np.searchsorted(self._byte_keys, (byte.astype(np.int64) << 40) | start, side="right") - 1
        found = np.maximum(run, 0)
        inside = (self._byte_keys[found] >> 40) == byte
        past = np.where(inside, np.minimum(start - (self._byte_keys[found] & ((1 << 40) - 1)), self._byte_sizes[found]), self._byte_sizes[found])
        reached = np.where(run >= 0, self._byte_sums[found] + past, 0)
        return reached + np.searchsorted(self._reached_before, reached, side="right")

    def first_sample(self, rows: np.ndarray) -> np.ndarray:
        """The first position of the text with the ``length`` bytes of an interval that begins at each row."""
        return self.first_samples[np.searchsorted(self.run_starts, rows)]

    def stream(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, the first position with the same ``length`` bytes as each): every context backwards, all in step."""
        rows, at = self.entry_rows, self.entry_positions
        while len(at):
            byte = text[at - 1]
            inside = byte != _END
            rows, at = self.step(rows[inside], byte[inside]), at[inside] - 1
            if len(at):
                yield at, self.first_sample(rows)


def _shared_halves(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, h: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Contexts whose anchor, with half of the other bytes of a match on its left or right, is in another document.

    A match takes at least that half on one side, so no other context can have one.
    """
    half = (length - GRAM + 1) // 2
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(text)), out=total[1:])
    inverse = _powers(_INVERSE, len(text) + 1)
    keep = np.zeros(len(starts), bool)
    for begin, fits in ((starts + left - half, left >= half), (starts + left + GRAM, sizes - left - GRAM >= half)):
        some = np.flatnonzero(fits)
        if not len(some):
            continue
        b = begin[some]
        key = mix64(mix64((total[b + half] - total[b]) * inverse[b]) ^ h[some].view(np.uint64))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        d = np.minimum(docs[some][order], _NO_ID)
        several = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
        keep[some[order]] |= np.repeat(several, np.diff(np.append(first, len(d))))
    return keep


def _mark_block(h: np.ndarray, docs: np.ndarray, at: np.ndarray, left: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, at, size) of the stretches of contexts that smaller documents of the block repeat."""
    none = docs[:0], at[:0], docs[:0]
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    starts = np.cumsum(sizes) - sizes
    keep = _shared_halves(np.frombuffer(b"".join(contexts), np.uint8), starts, sizes, left, h, docs, length)
    order = np.flatnonzero(keep)
    if not len(order):
        return none
    order = order[np.argsort(docs[order], kind="stable")]
    docs, at, contexts, sizes = docs[order], at[order], [contexts[i] for i in order], sizes[order] + 1
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), sizes)
    place = np.arange(len(text)) - starts[owner]
    index, ranks = RunLengthIndex(text, sizes[owner] - 1 - place, length), np.minimum(docs, _NO_ID)
    hits = [at_[ranks[owner[first]] < ranks[owner[at_]]] for at_, first in index.stream(text)]
    hit = np.sort(np.concatenate([place[:0], *hits]))
    p, o = place[hit], owner[hit]
    if not len(p):
        return none
    new = np.ones(len(p), bool)
    new[1:] = (o[1:] != o[:-1]) | (p[1:] > p[:-1] + length)
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(p)) - 1
    return docs[o[begin]], at[o[begin]] + p[begin], p[stop] + length - p[begin]


def _marks(rows: DataFrame, length: int, block_bytes: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(part: list[tuple]) -> pa.RecordBatch:
            h, doc, at, left, ctx = zip(*part)
            marked = _mark_block(*(np.array(x, np.int64) for x in (h, doc, at, left)), list(ctx), length)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in marked], ["doc", "at", "size"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= block_bytes and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush(held)

    return rows.repartition("h").sortWithinPartitions("h", "doc", "at").mapInArrow(run, "doc long, at long, size long")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, tag, packed): texts compressed before they are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch, texts in flat_batches(batches):
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([tag_of(r) for r in raws], pa.int64()), pa.array([pack.compress(r) for r in raws], pa.binary())], ["doc", "doc_id", "tag", "packed"])

    return docs.mapInArrow(run, "doc long, doc_id long, tag long, packed binary")


def _candidates(ids: DataFrame, length: int) -> DataFrame:
    """(doc, at, h, kind, tag) of the anchors that may be repeats, stored."""
    found = _anchor_rows(ids.select("doc", "text"), length).repartition("h").sortWithinPartitions("h", "c", "doc").mapInArrow(_settle, "doc long, at long, h long, kind int")
    return materialize(found.withColumn("tag", F.shiftright("at", 40)), "anchors")


def remove_repeats(docs: DataFrame, length: int = 50, block_bytes: int = 1 << 21) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept): each document without its repeated bytes.

    ``spans``: (start, stop) of the maximal removed runs; ``kept``: the remaining bytes.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = ids.select(F.coalesce("doc_id", F.lit(_LAST) - F.xxhash64("text").bitwiseAND((1 << 40) - 1)).alias("doc"), "doc_id", "text")
    found = _candidates(ids, length)
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    collect = F.collect_set if repeated else F.collect_list
    let_go(docs.sparkSession, now=True)  # the result is read lazily: no later table is written here
    texts = _packed(ids)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, packed, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = unpack.decompress(packed)
                for x in asked:
                    p = x["at"] & ((1 << 40) - 1)
                    begin = max(0, p - (length - GRAM))
                    for col, v in zip(out, (x["h"], doc, x["at"] - p + begin, p - begin, raw[begin : p + length])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], ["h", "doc", "at", "left", "ctx"])

    asked = found.where("kind = 1").groupBy("doc", "tag").agg(collect(F.struct("at", "h")).alias("asked"))
    once = texts.dropDuplicates(["doc", "tag"]) if repeated else texts
    contexts = once.join(asked.hint("merge"), ["doc", "tag"]).select("doc", "packed", "asked").mapInArrow(cut, "h long, doc long, at long, left long, ctx binary")
    marks = _marks(contexts, length, block_bytes)
    # a stretch is packed as its start and, in the low 16 bits, its size; size 0: the whole context of an anchor
    spans = found.where("kind = 0").select("doc", "tag", F.shiftleft(F.col("at").bitwiseAND((1 << 40) - 1), 16).alias("s"))
    spans = spans.union(marks.select("doc", F.shiftright("at", 40).alias("tag"), F.shiftleft(F.col("at").bitwiseAND((1 << 40) - 1), 16).bitwiseOR(F.col("size")).alias("s")))
    spans = spans.groupBy("doc", "tag").agg(collect("s").alias("spans"))

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        for b in batches:
            out = []
            for doc_id, packed, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = unpack.decompress(packed)
                cuts: list[tuple[int, int]] = []
                if spans.is_valid:
                    s = np.asarray(spans.values)
                    start, size = s >> 16, s & 0xFFFF
                    begin = np.where(size == 0, np.maximum(0, start - (length - GRAM)), start)
                    stop = np.where(size == 0, np.minimum(len(raw), start + length), start + size)
                    order = np.argsort(begin, kind="stable")
                    begin, stop = begin[order], np.maximum.accumulate(stop[order])
                    new = np.ones(len(begin), bool)
                    new[1:] = begin[1:] > stop[:-1]
                    at = np.flatnonzero(new)
                    cuts = list(zip(begin[at].tolist(), stop[np.append(at[1:], len(begin)) - 1].tolist()))
                kept, last = [], 0
                for x, y in cuts:
                    kept.append(raw[last:x])
                    last = y
                kept = b"".join([*kept, raw[last:]])
                out.append({"doc_id": doc_id, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "spans": [{"start": x, "stop": y} for x, y in cuts], "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema)

    whole = texts.join(spans.hint("merge"), ["doc", "tag"], "left").select("doc_id", "packed", "spans")
    return whole.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string, kept binary")
