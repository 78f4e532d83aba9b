"""Benchmark decontamination over a distributed positional inverted index, with DataFrame operations only.

*Index.* ``build_index`` stores the training tokens' postings (term, doc_id, row_hash, pos), in files sorted by term:
each task inverts its own documents, so building moves nothing between machines, and a look-up by term reads the row
groups that hold it. The empty term closes each document at position ``n_words``.

*Exact phrases.* The terms of each distinct benchmark window are ranked by their frequency in the index. The postings
of the rarest, less its offset in the window, are the candidate starts; these are intersected with the offset-adjusted
list of the next rarest term, and what is left with all other lists at once, by equality joins on (document, position,
term): a key that no single term or document makes hot. Of the lists only the postings near a candidate are shuffled,
told by a bitmap of fixed size. The windows' terms are broadcast while their measured size is under
``BROADCAST_BYTES``, and joined by term beyond it.

*Proximity.* ``proximity_matches`` takes an item's rarest terms and returns the places where all of them lie
within ``span`` words, by equality joins on blocks of ``span`` positions.

Words: A-Z in lower case, runs of digits, letters and all characters beyond ASCII. Defined results: null and blank
texts have no words and hit nothing; a null doc_id is kept; repeated rows each get their own row; very long texts are
so many more postings; an empty benchmark leaves everything clean; a null item_id marks words but is not listed; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import ascii_lower, materialize, temporary_tables

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Tables are broadcast only while their measured size is below this.
BROADCAST_BYTES = 64 << 20


def words_of(col: str) -> Column:
    return F.array_remove(F.split(ascii_lower(col), SEPARATOR), "")


def build_index(docs: DataFrame) -> DataFrame:
    """The stored postings: (term, doc_id, row_hash, pos), each document closed by the empty term."""
    words = F.array_append(F.coalesce(words_of("text"), F.array().cast("array<string>")), "")
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), words.alias("words"))
    rows = rows.select(F.posexplode("words").alias("pos", "term"), "doc_id", "row_hash")
    return materialize(rows.select("term", "doc_id", "row_hash", "pos").sortWithinPartitions("term"), "postings")


def documents_of(index: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n_words) of every row of the table that was indexed."""
    return index.where("term = ''").select("doc_id", "row_hash", F.col("pos").cast("long").alias("n_words"))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(words, len, items) of each distinct window of ``size`` words; an item of fewer, but not none, is one."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("w")).where("size(w) > 0")
    w = w.select("item", F.explode(F.expr(f"if(size(w) < {size}, array(w), transform(sequence(1, size(w) - {size - 1}), i -> slice(w, i, {size})))")).alias("window"))
    return w.groupBy("window").agg(F.collect_set("item").alias("items")).select("window", F.size("window").alias("len"), "items")


def _small(df: DataFrame, size: Column) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _with_small(big: DataFrame, small: DataFrame, condition, fits: bool, how: str = "inner") -> DataFrame:
    return big.join(F.broadcast(small) if fits else small, condition, how)


def term_frequencies(index: DataFrame, terms: DataFrame, fits: bool) -> DataFrame:
    """(term, freq) over all documents, for the given terms (those that never occur have 0)."""
    seen = _with_small(index.select("term"), terms, "term", fits).groupBy("term").agg(F.count("*").alias("freq"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("freq", F.lit(0)).alias("freq"))


def ranked_terms(index: DataFrame, windows: DataFrame) -> tuple[DataFrame, bool]:
    """(window, rank, offset, term), the rarest first, of windows whose terms all occur; whether it may be broadcast."""
    terms = windows.select("id", F.posexplode("window").alias("offset", "term"))
    fits = _small(terms, F.octet_length("term") + 64)
    freq = materialize(term_frequencies(index, terms.select("term").distinct(), fits), "term-frequencies")
    lists = terms.join(freq, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("freq", "term", "offset"))).alias("t")).where("t[0].freq > 0")
    lists = lists.select("id", F.posexplode("t").alias("rank", "e")).select("id", "rank", F.col("e.offset").alias("offset"), F.col("e.term").alias("term"))
    return materialize(lists, "ranked-terms"), fits


def _near(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """``postings`` in the neighbourhoods (document, block of positions) of ``asked``, with few others.

    A map of 2^26 bits by hash of the neighbourhood goes to every task: 2^20 rows of 64 bits at most, whatever the
    data. It only thins out what is shuffled; the join behind it is exact.
    """
    key = F.pmod(F.xxhash64("doc_id", "row_hash", F.floor(F.col("pos") / 16)), F.lit(1 << 26))
    bits = asked.select(key.alias("k")).select(F.shiftright("k", 6).alias("word"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("bit"))
    bits = materialize(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "neighbourhoods")
    return postings.withColumn("k", key).withColumn("word", F.shiftright("k", 6)).join(F.broadcast(bits), "word").where("(shiftright(bits, cast(k & 63 as int)) & 1) = 1").drop("k", "word", "bits")


def _intersect(index: DataFrame, found: DataFrame, lists: DataFrame, fits: bool) -> DataFrame:
    """The candidate starts (id, doc_id, row_hash, start) whose document has every one of ``lists`` at its offset."""
    asked = _with_small(found, lists, "id", fits).select("id", "doc_id", "row_hash", "start", (F.col("start") + F.col("offset")).alias("pos"), "term")
    part = _near(_with_small(index, lists.select("term").distinct(), "term", fits, "left_semi"), asked)
    d, r, p, t = (F.col(f"x.{c}") for c in ("doc_id", "row_hash", "pos", "term"))
    same = F.col("a.doc_id").eqNullSafe(d) & (F.col("a.row_hash") == r) & (F.col("a.pos") == p) & (F.col("a.term") == t)
    met = asked.alias("a").join(part.alias("x").hint("merge"), same)
    met = met.groupBy("a.id", "a.doc_id", "a.row_hash", "a.start").agg(F.size(F.collect_set("a.pos")).alias("n"))
    whole = lists.groupBy("id").agg(F.count("*").alias("n"))
    return _with_small(met, whole, ["id", "n"], fits).select("id", "doc_id", "row_hash", "start")


def phrase_matches(index: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, row_hash, start, len, items) of every occurrence of a window in a document."""
    windows = materialize(item_windows(items, size).withColumn("id", F.monotonically_increasing_id()), "windows")
    lists, fits = ranked_terms(index, windows)
    rarest = lists.where("rank = 0").select("id", "term", "offset")
    found = _with_small(index, rarest, "term", fits).select("id", "doc_id", "row_hash", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    found = materialize(found.distinct(), "candidates")
    last = lists.groupBy("id").agg(F.max("rank").alias("last"))
    ended = lambda found, rank: _with_small(found, last.where(f"last = {rank}").select("id"), "id", fits, "left_semi")
    whole = ended(found, 0)  # windows of one word
    found = materialize(_intersect(index, found, lists.where("rank = 1"), fits), "candidates")
    whole = whole.union(ended(found, 1)).union(_intersect(index, found, lists.where("rank > 1"), fits))
    return _with_small(whole, windows.select("id", "len", "items"), "id", fits).select("doc_id", "row_hash", "start", "len", "items")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, row_hash, n_words, n_hit, item_ids, spans): words of each document inside benchmark windows; stored."""
    with temporary_tables(docs.sparkSession) as keep:
        index = build_index(docs)
        return keep(hits_by_document(index, items, size), "contamination")


def hits_by_document(index: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """As ``contamination``, from a stored index."""
    hits = phrase_matches(index, items, size).groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.collect_set("items").alias("found"))
    hits = hits.select(
        F.col("doc_id").alias("d"),
        F.col("row_hash").alias("r"),
        "spans",
        F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.len - 1)))))").cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("found"))).alias("item_ids"),
    )
    out = documents_of(index).join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("r")), "left")
    return out.select("doc_id", "row_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans")


def proximity_matches(index: DataFrame, items: DataFrame, terms: int = 3, span: int = 20) -> DataFrame:
    """(doc_id, row_hash, item, start, stop): stretches of at most ``span`` words that hold an item's rarest terms.

    An item takes part with its ``terms`` rarest distinct words that occur in the corpus at all (all, if it has
    fewer). Each place of the rarest word gives one row at most: the narrowest stretch around it, the first of equals.
    Every position from which a stretch can reach the place is tried as its start, with each word's first position
    from there on.
    """
    words = items.select(F.col("item_id").cast("string").alias("item"), F.explode(words_of("text")).alias("term")).where("item is not null").distinct()
    words = materialize(words, "item-terms")
    fits = _small(words, F.octet_length("term") + 64)
    freq = term_frequencies(index, words.select("term").distinct(), fits)
    ranked = words.join(freq.where("freq > 0"), "term").groupBy("item").agg(F.slice(F.array_sort(F.collect_set(F.struct("freq", "term"))), 1, terms).alias("t"))
    ranked = materialize(ranked.select("item", F.size("t").alias("k"), F.posexplode("t").alias("rank", "e")).select("item", "k", "rank", F.col("e.term").alias("term")), "rare-terms")
    # documents as structs: a null id equals itself there
    posted = _with_small(index, ranked, "term", fits).withColumn("doc", F.struct("doc_id", "row_hash")).withColumn("block", F.floor(F.col("pos") / span))
    first = posted.where("rank = 0").select("doc", "item", "k", F.col("pos").alias("at"), F.explode(F.expr("array(block - 1, block, block + 1)")).alias("block"))
    near = first.join(posted.select("doc", "item", "block", "pos", "rank"), ["doc", "item", "block"])
    near = near.where(f"abs(pos - at) < {span}")
    whole = near.where("rank > 0 or pos = at").groupBy("doc", "item", "k", "at").agg(F.collect_set(F.struct("pos", "rank")).alias("near"))
    firsts = "transform(filter(near, x -> x.pos <= at), y -> transform(sequence(0, k - 1), r -> array_min(transform(filter(near, x -> x.rank = r and x.pos >= y.pos), x -> x.pos))))"
    whole = whole.withColumn("firsts", F.expr(f"filter({firsts}, f -> forall(f, z -> z is not null))"))
    whole = whole.withColumn("best", F.expr("array_min(transform(firsts, f -> named_struct('width', array_max(f) - array_min(f), 'start', array_min(f), 'stop', array_max(f))))"))
    return whole.where(f"best.width < {span}").select("doc.doc_id", "doc.row_hash", "item", "best.start", "best.stop")
