"""Token ids as seekable Zstandard files: one independent frame a document.

File layout (little endian)
---------------------------
1. One Zstandard frame for each ``frame_ids`` ids of a document (documents never share a frame; nearly every
   document is one frame), each with its content checksum.
2. A skippable frame with the document index: width of an id, then for each document
   (has id, doc id, number of ids, first frame, number of frames).
3. The trailing seek table of the seekable Zstandard format: a skippable frame with (compressed size,
   decompressed size, low 32 bits of the XXH64 of the content) for each frame and a nine-byte footer.

A reader opens a file, reads the footer, the seek table and the index, and then decompresses only the frames of
the documents asked for; each frame's checksum is held against its content.

Writing: documents are dealt by ranges of ``doc_id`` (ties by text hash) and each task streams its sorted rows
into one file under a name of its own, so a task that is run again never touches the files of another attempt.
What is dealt are compressed texts, and a row that repeats the one before it only counts as one more copy: the copy
is encoded once, but written as often as it is there. The manifest is a table that Spark commits: only files of
successful attempts are in it.

Defined results: a null text counts as empty (its ids are just the end id); a null doc_id sorts first and is
kept; repeated rows are each written; an empty table gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import flat_batches, materialize, new_path

SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
INDEX_ENTRY = struct.Struct("<BqQQQ")
SEEK_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"


#: The normaliser and the splitter of the tokenizer file under which ``WordCache`` may cut texts.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those for which pieces between white space can be encoded alone."""
    added = settings.get("added_tokens") or []
    return settings.get("normalizer") == _NORMALISER and settings.get("pre_tokenizer") == _SPLITTER and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in added)


class WordCache:
    """Ids of texts, by the tokenizers library, from those of their white-space separated pieces where that is exact.

    That is so for files whose normaliser and splitter are the ones above; with any other, whole texts are encoded.
    The tokenizer drops white space and case before it splits and merges, so the ids of a text are those of its
    pieces one after the other, and a piece met before is not encoded again. ASCII marks between a letter or digit
    and white space are a piece of their own, as the tokenizer's split always makes them one. Texts that hold ``<|``
    may name special tokens, whose case counts, and keep their case. Pieces of lower-case Latin letters alone are one
    part for the merges already: the same model encodes them without normalising and splitting. Beyond ``limit``
    pieces only those of the texts at hand are kept, the common ones among them. One memory serves all tasks of a Python worker.
    """

    _OF_WORKER: dict[tuple[str, int], "WordCache"] = {}
    _MARKS = re.compile(rb"([!-/:-@\[-`{-~](?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-/:-@\[-`{-~]*)(?=[ \t\n\r\x0b\x0c]|$)")
    _LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def __init__(self, tokenizer_path: str, width: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.width, self.limit = Tokenizer.from_file(tokenizer_path), width, limit
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[bytes, bytes] = {}
        with open(tokenizer_path, encoding="utf-8") as f:
            self.by_piece = splits_at_spaces(json.load(f))

    @classmethod
    def of_worker(cls, tokenizer_path: str, end_id: int) -> WordCache:
        """The worker's own, with ids as wide as the vocabulary needs."""
        if (tokenizer_path, end_id) not in cls._OF_WORKER:
            cache = cls._OF_WORKER[tokenizer_path, end_id] = cls(tokenizer_path, "<u4")
            if max(cache.tokenizer.get_vocab_size(True), end_id + 1) <= 1 << 16:
                cache.width = "<u2"
        return cls._OF_WORKER[tokenizer_path, end_id]

    def shrink(self, texts: list[str]) -> None:
        """Keeps the pieces of some texts only: a worker that waits for its next task holds little."""
        pieces = set(chain.from_iterable(self._pieces(t) for t in texts))
        self.known = {p: self.known[p] for p in pieces.intersection(self.known)}

    def _pieces(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass")
        return (raw if b"<|" in raw else self._MARKS.sub(rb" \1", raw.lower())).split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width == "<u2" else "I"  # machines of Spark's Arrow are little endian
        if not self.by_piece:
            return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [self._pieces(t) for t in texts]
        known = self.known
        wanted = set(chain.from_iterable(split))
        if len(known) > self.limit:
            known = self.known = {p: known[p] for p in wanted.intersection(known)}
        new = wanted.difference(known)
        plain = [p for p in new if self._LETTERS.fullmatch(p)]
        for tokenizer, some in ((self.letters, plain), (self.tokenizer, list(new.difference(plain)))):
            for p, e in zip(some, tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)):
                known[p] = array(kind, e.ids).tobytes()
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]


class FrameWriter:
    """Writes documents' ids to one file in the layout above."""

    def __init__(self, sink, width: str, frame_ids: int, level: int):
        self.sink, self.width, self.frame_bytes = sink, np.dtype(width).itemsize, frame_ids * np.dtype(width).itemsize
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index = bytearray()
        self.n_docs = self.n_ids = self.n_bytes = 0

    def put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.n_bytes += len(raw)

    def add(self, doc_id: int | None, ids: bytes, copies: int = 1) -> None:
        parts = [ids[i : i + self.frame_bytes] for i in range(0, len(ids), self.frame_bytes)]
        packed = [self.packer.compress(part) for part in parts]
        frames = [(len(p), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF) for p, part in zip(packed, parts)]
        for _ in range(copies):
            self.index += INDEX_ENTRY.pack(doc_id is not None, doc_id or 0, len(ids) // self.width, len(self.frames), len(frames))
            self.frames += frames
            for p in packed:
                self.put(p)
        self.n_docs += copies
        self.n_ids += copies * (len(ids) // self.width)

    def close(self) -> None:
        body = bytes([self.width]) + bytes(self.index)
        head = struct.pack("<II", SKIPPABLE_INDEX, len(body))
        self.put(head + body)
        self.frames.append((len(head) + len(body), 0, 0))
        table = np.array(self.frames, dtype=SEEK_ENTRY).tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.put(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)


class FrameReader:
    """Random access to the documents of one file; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("not a seekable file with checksums")
        size = n * SEEK_ENTRY.itemsize
        source.seek(end - 9 - size)
        self.frames = np.frombuffer(source.read(size), dtype=SEEK_ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])
        source.seek(int(self.at[-2]) + 8)
        body = source.read(int(self.frames["packed"][-1]) - 8)
        self.width = {2: "<u2", 4: "<u4"}[body[0]]
        self.entries = [INDEX_ENTRY.unpack_from(body, i) for i in range(1, len(body), INDEX_ENTRY.size)]
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def doc_id(self, i: int) -> int | None:
        return self.entries[i][1] if self.entries[i][0] else None

    def ids(self, i: int) -> np.ndarray:
        """The ids of document ``i`` of the file; only its frames are read and decompressed."""
        _, _, _, first, count = self.entries[i]
        parts = []
        self.source.seek(int(self.at[first]))
        for k in range(first, first + count):
            part = self.unpacker.decompress(self.source.read(int(self.frames["packed"][k])))
            if len(part) != self.frames["size"][k] or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.frames["check"][k]:
                raise ValueError(f"frame {k} is damaged")
            parts.append(part)
        return np.frombuffer(b"".join(parts), dtype=self.width)


def pack_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, copies, packed): compressed texts; a row that repeats the one before it is one of its copies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch, texts in flat_batches(batches):
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts))
            first = [k for k, row in enumerate(rows) if not k or row != rows[k - 1]]
            raws = [texts[k].encode("utf-8", "surrogatepass") for k in first]
            cols = [*(batch.column(i).take(pa.array(first)) for i in range(2)), pa.array(np.diff([*first, len(rows)])), pa.array([packer.compress(r) for r in raws], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tie", "copies", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, copies long, packed binary")


def unpacked(batches: Iterable[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[tuple[list[int | None], list[int], list[str]]]:
    """(ids, copies, texts) of the rows (doc_id, copies, packed), about ``limit`` characters at a time, whole texts each."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        ids, copies = (batch.column(i).to_pylist() for i in range(2))
        begin, size, texts = 0, 0, []
        for k, packed in enumerate(batch.column(2)):
            texts.append(unpack.decompress(packed.as_buffer()).decode("utf-8", "surrogatepass"))
            size += len(texts[-1]) + 1
            if size >= limit or k + 1 == batch.num_rows:
                yield ids[begin : k + 1], copies[begin : k + 1], texts
                begin, size, texts = k + 1, 0, []


def write_documents(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, frame_ids: int = 1 << 24, level: int = 3) -> DataFrame:
    """Encodes every whole text and writes the ids in ascending doc_id order; returns the manifest.

    The manifest has one row a file, in order of ``part``; it holds (part, path, n_docs, n_ids, n_bytes) and is a
    table under the shared folder. ``path``: folder of the files (default: a new one in the shared folder).
    """
    path = path or new_path(docs.sparkSession, "token-files")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        writer = sink = name = cache = end = None
        for doc_ids, copies, texts in unpacked(batches):
            if writer is None:
                cache = WordCache.of_worker(tokenizer_path, end_id)
                end = np.array([end_id], dtype=cache.width).tobytes()
                part = TaskContext.get().partitionId()
                fs.create_dir(folder, recursive=True)
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                sink = fs.open_output_stream(name, compression=None)
                writer = FrameWriter(sink, cache.width, frame_ids, level)
            for doc_id, n, ids in zip(doc_ids, copies, cache.encode_all(texts)):
                writer.add(doc_id, ids + end, n)
        if writer is not None:
            cache.shrink(texts)
            writer.close()
            sink.close()
            row = {"part": [part], "path": [f"{path}/{name.rpartition('/')[2]}"], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids], "n_bytes": [writer.n_bytes]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    ordered = pack_rows(docs).repartitionByRange(F.col("doc_id"), F.col("tie")).sortWithinPartitions("doc_id", "tie").select("doc_id", "copies", "packed")
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids in all files before. There is a row a file, so few rows."""
    rows = sorted(manifest.collect(), key=lambda r: r.part)
    at, out = 0, []
    for r in rows:
        out.append((r.part, r.path, r.n_docs, r.n_ids, at))
        at += r.n_ids
    spark = manifest.sparkSession
    return spark.createDataFrame(out, "part int, path string, n_docs long, n_ids long, start long").repartition(max(1, len(out)))


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def read_documents(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) from the files; with ``doc_ids`` only those documents' frames are decompressed."""
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as source:
                    reader, at, out, held = FrameReader(source), row["start"], [], 0
                    for i, entry in enumerate(reader.entries):
                        if wanted is None or reader.doc_id(i) in wanted:
                            out.append({"doc_id": reader.doc_id(i), "start": at, "ids": reader.ids(i).astype(np.int64)})
                            held += entry[2]
                        at += entry[2]
                        if held > 1_000_000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    return with_starts(manifest).mapInArrow(read, "doc_id long, start long, ids array<long>")


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decompressed from the files."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as source:
                    reader, at, out = FrameReader(source), row["start"], []
                    for i, entry in enumerate(reader.entries):
                        ids = reader.ids(i)
                        out.append((reader.doc_id(i), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += entry[2]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_starts(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
