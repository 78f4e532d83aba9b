"""What the operators of this subpackage share: the cluster's common folder, tables, Arrow helpers.

Lineage is cut with tables written under ``spark.checkpoint.dir`` (never with
``localCheckpoint``): every executor can read them back after another one is lost.
"""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the corpus, by a path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a new one only if none is set, on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of ``df`` (ignoring case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        out.append(n)
    return out


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_OPEN = threading.local()


def let_go(spark: SparkSession, now: bool = False) -> None:
    """Asks for the driver's garbage to be collected before the next table is written, or ``now``.

    The last job refers to its plan until another one has run.

    Spark's cleaner removes the files of shuffles that no plan refers to any more, but only learns of them when the
    driver collects its garbage; on a long job they would otherwise stay on the disks for many steps. By the next
    write the functions that built the last plans have returned, and with them their references are gone.
    """
    if now:
        spark._jvm.System.gc()
    else:
        _OPEN.stale = True


def give_back(spark: SparkSession) -> None:
    """Has the driver's garbage collected once its heap has grown to half of its limit.

    Only a full collection gives memory back; between those the heap grows with the garbage of every plan.
    """
    heap = spark._jvm.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        spark._jvm.System.gc()


def _write(df: DataFrame, name: str, level: int) -> DataFrame:
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if getattr(_OPEN, "stale", False):
        _OPEN.stale = False
        spark._jvm.System.gc()
    else:
        give_back(spark)
    scopes = getattr(_OPEN, "scopes", [])
    if len(scopes) >= level:
        scopes[-level].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: a checkpoint that survives executors."""
    return _write(df, name, 1)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Removes the tables that ``materialize`` writes inside when it ends, also by an error.

    Gives a function that stores a result beyond the end: it then belongs to the scope around this one, if any.
    """
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    paths: list[str] = []
    _OPEN.scopes.append(paths)
    try:
        yield lambda df, name: _write(df, name, 2)
    finally:
        _OPEN.scopes.pop()
        for path in paths:
            drop_path(spark, path)
        let_go(spark)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder made by ``new_path`` once no later plan reads it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    if files := df.inputFiles():
        drop_path(df.sparkSession, files[0].rpartition("/")[0])


def ascii_lower(col: str) -> "F.Column":
    """``col`` with A-Z (and nothing else) in lower case, as a JVM expression.

    ``lower`` alone is right for texts without upper-case letters beyond ASCII; only the others take the
    slower character map.
    """
    c = F.col(col)
    mapped = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
        .when(c.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), mapped)
        .otherwise(F.lower(c))
    )


def string_list(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null becomes the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def chunks(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters: bounds the arrays made at once, whole texts each."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def flat_batches(batches: Iterable[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with the column ``text`` as a list of whole texts, about ``limit`` characters each."""
    for batch in batches:
        texts = string_list(batch.column(batch.schema.get_field_index("text")))
        for i, j in chunks(texts, limit):
            yield batch.slice(i, j - i), texts[i:j]


def release() -> None:
    """Gives memory that nothing uses back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; a Python worker that has ended its task holds little while it waits beside other work."""

    def run_and_release(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return run_and_release


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers (multiply-xorshift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def byte_words(texts: list[str], separator: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and each text's first word.

    ``separator``: for each byte whether it separates words; ``table``: the byte that each byte counts as.
    Returns (hashes, offsets, n_words): words of text ``i`` are ``hashes[offsets[i]:offsets[i + 1]]``.
    A word's hash depends on its bytes alone.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = table[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    inside = ~separator[flat]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    text_ends = np.cumsum(sizes)
    offsets = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    total = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(flat)), out=total[1:])
    inverse = _powers(_INVERSE, len(flat))
    hashes = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, offsets, np.diff(offsets)


def _table(upper: bool) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    if upper:
        out[65:91] += 32
    return out


#: A-Z become a-z; other bytes stay.
LOWER = _table(True)
#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: All bytes but digits, ASCII letters and those of characters beyond ASCII.
NOT_WORD = np.array([not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])


def doc_of(offsets: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words within a text, and the text number of each.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    n, counts = len(hashes), np.diff(offsets)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = doc_of(offsets)
    value = hashes.copy()
    for k in range(1, size):
        value[: n - k] = mix64(value[: n - k] * np.uint64(3) + hashes[k:])
    whole = np.arange(n) + size <= offsets[1:][owner]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, t in enumerate(short):
            own = hashes[offsets[t] : offsets[t + 1]]
            h = own[:1].copy()
            for k in range(1, len(own)):
                h = mix64(h * np.uint64(3) + own[k : k + 1])
            extra[i] = mix64(h + np.uint64(len(own)))[0]
        return np.concatenate([value[whole], extra]), np.concatenate([owner[whole], short])
    return value[whole], owner[whole]
