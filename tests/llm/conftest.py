import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOREM = "the quick brown fox jumps over a lazy dog while seven wizards quietly box in the moonlight near an old stone bridge that nobody has crossed since winter came early last year and froze every river from here to the northern sea".split()


def sentence(seed: int, n: int) -> str:
    """Deterministic prose of n words."""
    return " ".join(LOREM[zlib.crc32(f"{seed}.{i}".encode()) % len(LOREM)] for i in range(n))


@pytest.fixture(scope="session")
def texts():
    base = {i: sentence(i, 40 + 17 * i) for i in range(12)}
    base[12] = base[3]  # an exact copy
    words = base[11].split()
    words[5], words[100] = "changed", "twice"
    base[13] = " ".join(words)  # a near copy
    base[14] = base[4] + "\n" + sentence(99, 30) + " " + base[6]  # shared passages
    base[15], base[16], base[17] = "", None, "  \n\t "
    base[18] = "ÉÀ ünï çödé — ДОМ 東京 " * 30
    base[19] = "a"
    base[20] = "spam spam " * 400
    base[21] = sentence(7, 6000)  # very long
    return base


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 2}", len(t) if t else None) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and columns whose names clash with those used inside."""
    rows = [(None, sentence(1, 60)), (1, sentence(1, 60)), (1, sentence(1, 60)), (2, None), (None, None), (3, "")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    for c in ("u", "v", "h", "at", "doc", "part", "kind", "words", "component_id", "bucket", "rep", "_d", "_h", "n", "id", "size", "row_hash", "pos", "term", "item", "rate", "p"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
