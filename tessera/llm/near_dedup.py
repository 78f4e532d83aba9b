"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union of links.

1. *Signatures.* Each distinct word shingle of a document draws a permutation of the signature's slots; in round
   ``j`` it offers ``j + u`` (``u`` uniform in [0, 1)) to the ``j``-th slot of its permutation, and each slot keeps
   the least. A document stops as soon as no later round can lower a slot, which long documents reach in one
   round. All elements of a chunk of documents take a round together.
2. *Classes.* Rows of equal text (64 bits of its hash, and size and 128 bits of digest of its set) become one class,
   represented by the smallest id: thousands of copies cost one row from here on. Different texts of equal sets are
   different classes, which share all their buckets, so they are confirmed on full sets like any others.
3. *Banding.* A bucket is a band of equal slots. In each bucket every class is tried against one hub: the class
   that meets most others over all bands, which in a group of near copies is one close to their origin. Classes
   that are now connected need no more tests. For buckets that still hold several components, each class gets a
   bitmap of its shingles: those whose bit another class lacks are surely not shared, which bounds the intersection
   from above, so a pair far below the similarity is settled exactly inside the join. What is left is tried against
   hubs drawn for each bucket. A bucket's hub is settled there and leaves it. The classes of buckets that still hold
   several components are searched together, each listed once: the pairs of different components are tried that share
   one of their rarest shingles. Of a set of n, similar ones must share one of the n - ceil(0.8 n) + 1 rarest, with
   enough shingles behind it on both sides, so what many have (boilerplate) makes few pairs. No bucket is capped and no
   pair that could join two components is left out.
4. *Verification.* Exact similarity of the full shingle sets from whole texts, streamed by hub; a hub with many
   members is dealt over several tasks.
5. *Components* of the verified links (``components.py``).

Defined results: null and blank texts have an empty set, link with nothing and form a component of their own; a
null doc_id has a null component and is kept; rows that repeat a doc_id are one node, linked by each of their texts; an
empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import LOWER, SPACE, byte_words, flat_batches, free_names, lean, materialize, mix64, shingles, temporary_tables
from tessera.llm.components import connected_components

_FRACTION = np.uint64((1 << 48) - 1)
#: What makes a class.
_KEY = ["row_hash", "set_a", "set_b", "n_shingles"]


def distinct_sets(values: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct elements of each document, ordered by document: (52-bit values, owners). At most 4096 documents."""
    keys = np.unique((owner.astype(np.uint64) << np.uint64(52)) | (values >> np.uint64(12)))
    return keys & np.uint64((1 << 52) - 1), (keys >> np.uint64(52)).astype(np.int64)


def superminhash(values: np.ndarray, owner: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Signatures (n_docs x slots, unsigned 64-bit: round in the high bits, 48 bits of fraction)."""
    out = np.full((n_docs, slots), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = out.reshape(-1)

    def draw(v: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        r = mix64(v * np.uint64(0x9E3779B97F4A7C15) + np.uint64((j + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        k = j + (((r >> np.uint64(48)) * np.uint64(slots - j)) >> np.uint64(16)).astype(np.int64)
        return k, (np.uint64(j) << np.uint64(48)) | (mix64(r) & _FRACTION)

    k, offer = draw(values, 0)
    np.minimum.at(flat, owner * slots + k, offer)
    open_docs = out.max(axis=1) >> np.uint64(48) > 0
    keep = open_docs[owner]
    values, owner, k = values[keep], owner[keep], k[keep]
    # the permutations of the elements still in play, made step by step by swaps
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots < 256 else np.uint16), (len(values), 1))
    rows = np.arange(len(values))
    order[rows, k], order[rows, 0] = order[rows, 0], order[rows, k]
    for j in range(1, slots):
        if not len(values):
            break
        k, offer = draw(values, j)
        p = order[rows, k]
        order[rows, k] = order[:, j]
        order[:, j] = p
        np.minimum.at(flat, owner * slots + p, offer)
        done = (out.max(axis=1) >> np.uint64(48)) <= np.uint64(j)
        keep = ~done[owner]
        if not keep.all():
            values, owner, order = values[keep], owner[keep], order[keep]
            rows = np.arange(len(values))
    return out


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    n, slots = signatures.shape
    bands = signatures.reshape(n, slots // rows, rows)
    h = np.broadcast_to(np.arange(slots // rows, dtype=np.uint64), bands.shape[:2]).copy()
    for i in range(rows):
        h = mix64(h * np.uint64(5) + bands[:, :, i])
    return h


def signature_table(docs: DataFrame, shingle: int = 5, slots: int = 96, rows: int = 4) -> DataFrame:
    """(doc_id, row_hash, n_shingles, set_a, set_b, bands) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in flat_batches(batches):
            for i in range(0, len(texts), 4096):
                part = texts[i : i + 4096]
                hashes, offsets, _ = byte_words(part, SPACE, LOWER)
                v, owner = distinct_sets(*shingles(hashes, offsets, shingle), len(part))
                n = np.bincount(owner, minlength=len(part))
                digest = []
                for seed in (0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D):
                    total = np.zeros(len(v) + 1, np.uint64)
                    np.cumsum(mix64(v ^ np.uint64(seed)), out=total[1:])
                    at = np.concatenate([[0], np.cumsum(n)])
                    digest.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                bands = band_hashes(superminhash(v, owner, len(part), slots), rows).view(np.int64)
                bands_col = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * bands.shape[1], pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(part)), batch.column(1).slice(i, len(part)), pa.array(n.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), bands_col],
                    ["doc_id", "row_hash", "n_shingles", "set_a", "set_b", "bands"],
                )

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    return rows_in.mapInArrow(lean(run), "doc_id long, row_hash long, n_shingles long, set_a long, set_b long, bands array<long>")


def verify_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, per_task: int = 256) -> DataFrame:
    """Of the pairs (u, v), those whose full shingle sets have ``100 * intersection >= percent * union``.

    ``texts``: (id, text). Each u is a hub; its members are dealt over as many salts as it takes to have about
    ``per_task`` in each, and a task streams a hub and its members in order.
    """
    sizes = pairs.groupBy("u").agg(F.ceil(F.count("*") / per_task).alias("salts"))
    dealt = pairs.join(sizes, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("salts")).alias("salt"))
    asked = dealt.select("u", "salt", F.lit(1).alias("member"), F.col("v").alias("id")).union(
        dealt.select("u", "salt", F.lit(0).alias("member"), F.col("u").alias("id")).distinct()
    )
    rows = texts.join(asked.hint("merge"), "id").repartition("u", "salt").sortWithinPartitions("u", "salt", "member")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, set()
        for b in batches:
            left, right = [], []
            for u, salt, member, i, text in zip(*(c.to_pylist() for c in b.columns)):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                if len(words) < shingle:
                    found = {tuple(words)} if words else set()
                else:
                    found = set(zip(*(words[k:] for k in range(shingle))))
                if not member:
                    hub, own = (u, salt), found
                elif hub == (u, salt):
                    both = len(own & found)
                    if both and 100 * both >= percent * (len(own) + len(found) - both):
                        left.append(u)
                        right.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return rows.select("u", "salt", "member", "id", "text").mapInArrow(lean(run), "u long, v long")


def shingle_bits(texts: DataFrame, shingle: int, bits: int = 4096) -> DataFrame:
    """(rep, bits): a bitmap of the shingles of each class of ``texts`` (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, all_texts in flat_batches(batches):
            for i in range(0, len(all_texts), 1024):
                part = all_texts[i : i + 1024]
                hashes, offsets, _ = byte_words(part, SPACE, LOWER)
                values, owner = shingles(hashes, offsets, shingle)
                marks = np.zeros((len(part), bits), np.uint8)
                marks[owner, (values >> np.uint64(20)).astype(np.int64) % bits] = 1
                longs = np.packbits(marks, axis=1, bitorder="little").view(np.int64)
                rows = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * longs.shape[1], pa.array(longs.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), rows], ["rep", "bits"])

    return texts.select("id", "text").mapInArrow(lean(run), "rep long, bits array<long>")


def class_elements(texts: DataFrame, shingle: int) -> DataFrame:
    """(rep, element): the distinct shingles, by hash, of each class of ``texts`` (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, all_texts in flat_batches(batches):
            ids = batch.column(0).to_numpy()
            for i in range(0, len(all_texts), 4096):
                part = all_texts[i : i + 4096]
                hashes, offsets, _ = byte_words(part, SPACE, LOWER)
                v, owner = distinct_sets(*shingles(hashes, offsets, shingle), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + owner]), pa.array(v.view(np.int64))], ["rep", "element"])

    return texts.select("id", "text").mapInArrow(lean(run), "rep long, element long")


def rare_pairs(pool: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(u, v): the pairs of classes of different components that share a rare enough shingle and may be similar.

    ``pool``: (rep, n, part, bits), a row a class. A class's shingles are ordered by how many classes have them, over
    the whole pool. Those that no other component has come first and can't be shared by a pair; of the others only
    as many are looked up as it takes.
    """
    elements = class_elements(texts.join(pool.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi"), shingle)
    rows = materialize(elements.join(pool.select("rep", "n", "part"), "rep"), "class-elements")
    shared = rows.groupBy("element").agg(F.count("*").alias("df"), F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("element", "df")
    own = Window.partitionBy("rep")
    rows = rows.join(shared, "element")
    rows = rows.withColumns({"k": F.count("*").over(own), "place": F.row_number().over(own.orderBy("df", "element"))})
    rows = rows.where(f"place <= k - ceil({percent} * n / 100) + 1").select("element", "rep", "n", "part", F.expr("k - place").alias("after"))
    rows = materialize(rows, "rare-elements")
    other = rows.select("element", *(F.col(c).alias(f"o_{c}") for c in ("rep", "n", "part", "after")))
    # of a pair's shared shingles the first in order has all others behind it on both sides
    enough = f"(100 + {percent}) * (least(after, o_after) + 1) >= {percent} * (n + o_n)"
    found = rows.join(other, "element").where(f"part <> o_part and rep > o_rep and 100 * least(n, o_n) >= {percent} * greatest(n, o_n) and {enough}")
    found = materialize(found.select(F.col("o_rep").alias("u"), F.col("rep").alias("v")), "rare-pairs").distinct()
    side = pool.select("rep", "n", "bits")
    found = found.join(side.withColumnRenamed("rep", "v"), "v").join(side.select(F.col("rep").alias("u"), F.struct("n", "bits").alias("hub")), "u")
    return found.where(_may_reach(percent)).select("u", "v")


def _may_reach(percent: int) -> str:
    """SQL: whether bitmaps leave it open that a class and its hub have the similarity."""
    lost = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x & ~y)), 0, (s, v) -> s + v)"
    both = f"least(n - {lost('bits', 'hub.bits')}, hub.n - {lost('hub.bits', 'bits')})"
    return f"(100 + {percent}) * {both} >= {percent} * (n + hub.n)"


def _classes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes with a number of their own, ids on rows of several classes).

    The number is the smallest id of the class, or a negative hash where that id is on rows of several classes.
    """
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(_KEY).agg(F.min("doc_id").alias("first"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialize(classes, "classes")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(_KEY)).alias("a"), F.max(F.struct(_KEY)).alias("b")).where("a <> b")
    several = materialize(several.select("doc_id"), "ids-of-several-texts")
    if several.isEmpty():
        return classes.withColumn("rep", F.col("first")), several
    some = several.select(F.col("doc_id").alias("first"), F.lit(True).alias("shared"))
    number = -F.pmod(F.xxhash64(*_KEY), F.lit(1 << 62)) - 2
    return materialize(classes.join(some, "first", "left").withColumn("rep", F.when(F.col("shared"), number).otherwise(F.col("first"))).drop("shared"), "classes"), several


def _linked(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """(node, component) of the classes that link with any other, or None."""
    members = classes.select(F.explode("bands").alias("bucket"), "rep", F.col("n_shingles").alias("n"))
    full = members.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    members = materialize(members.join(full, "bucket"), "buckets")
    meets = members.groupBy("rep").agg(F.sum("k").alias("weight"))
    members = materialize(members.join(meets, "rep").select("bucket", "rep", "n", "weight"), "weighted-buckets")
    # whole texts of the classes that meet any other, taken out of the documents once
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select(F.col("first").alias("doc_id"), "row_hash", F.col("rep").alias("id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text").where("doc_id is not null")
    texts = texts.join(wanted.hint("merge"), ["doc_id", "row_hash"]).select("id", "text")
    if not repeated_rows(docs).isEmpty():
        texts = texts.dropDuplicates(["id"])
    texts = materialize(texts, "class-texts")

    labels = tested = None
    low = lambda a, b: f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"
    pool = members.select("bucket", "rep", "n", F.col("rep").alias("part"), "weight")
    for step in ("central", "drawn", "rest"):
        if labels is not None:
            parts = labels.select(F.col("node").alias("rep"), F.col("component").alias("p"))
            pool = pool.join(parts, "rep", "left").withColumn("part", F.coalesce("p", "rep")).drop("p")
            open_ = pool.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("bucket")
            pool = materialize(pool.join(open_, "bucket").select(*pool.columns), "open-buckets")
        if step == "drawn":
            inside = pool.select(F.col("rep").alias("id")).distinct()
            bits = materialize(shingle_bits(texts.join(inside.hint("merge"), "id", "left_semi"), shingle), "shingle-bits")
            pool = pool.join(bits, "rep")
        near = low("n", "hub.n") if step == "central" else f"{low('n', 'hub.n')} and {_may_reach(percent)}"
        fields = [c for c in pool.columns if c not in ("bucket", "weight")]
        if step == "rest":
            pairs = rare_pairs(materialize(pool.select(*fields).distinct(), "open-classes"), texts, shingle, percent)
        else:
            by = F.struct("weight", -F.col("rep")) if step == "central" else F.xxhash64("rep", "bucket")
            hub = pool.groupBy("bucket").agg(F.max_by(F.struct(*fields), by).alias("hub"))
            pool = pool.join(hub, "bucket")
            found = pool.where(f"part <> hub.part and {near}")
            pool = pool.where("rep <> hub.rep").drop("hub")  # a bucket's hub is settled there
            pairs = found.select(F.col("hub.rep").alias("u"), F.col("rep").alias("v")).distinct()
        if tested is not None:
            both = tested.union(tested.select(F.col("v").alias("u"), F.col("u").alias("v")))
            pairs = pairs.join(both, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if not pairs.isEmpty():
            tested = pairs if tested is None else tested.union(pairs)
            new = verify_pairs(pairs, texts, shingle, percent)
            labels = connected_components(new if labels is None else new.union(labels.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    return labels


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, slots: int = 96, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document, a stored table; see the module's text.

    ``kept`` is true for the smallest id of a component. With 24 bands of four slots, a pair at similarity 0.8 is
    missed with a probability of 3e-6.
    """
    with temporary_tables(docs.sparkSession) as keep:
        signed = materialize(signature_table(docs, shingle, slots, rows), "signatures")
        classes, several = _classes(signed)
        labels = _linked(docs, classes, shingle, percent)
        of_class = classes.select(*_KEY, "rep")
        if labels is not None:
            of_class = of_class.join(labels, of_class.rep == labels.node, "left").select(*_KEY, F.coalesce("component", "rep").alias("rep"))
        out = signed.select("doc_id", *_KEY).join(of_class, _KEY, "left")
        if not several.isEmpty():  # an id on rows of several classes links them, and is what numbers them
            both = connected_components(out.where("rep is not null").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
            real = signed.select(F.col("doc_id").alias("node")).distinct()
            least = both.join(real, "node", "left_semi").groupBy("component").agg(F.min("node").alias("least"))
            by_id = both.join(least, "component").select(F.col("node").alias("doc_id"), "least")
            out = out.join(by_id, "doc_id", "left").withColumn("rep", F.coalesce("least", "rep"))
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("component_id"))
        return keep(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicate-groups")


def repeated_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash) on several rows."""
    return docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash")).count().where("count > 1 and doc_id is not null").select("doc_id", "row_hash")


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, slots: int = 96, rows: int = 4) -> DataFrame:
    """``docs`` without near duplicates: of each group the row of the smallest id (then text hash) stays, once.

    Rows of one id are judged by their own texts: different ones stay. Of rows that also repeat the text, the one
    whose other columns have the smallest hash stays. Rows without an id or without words stay.
    """
    spark = docs.sparkSession
    d, h, n, k, word, bits = free_names(docs, "_d", "_h", "_n", "_k", "_word", "_bits")
    with temporary_tables(spark) as keep:
        signed = materialize(signature_table(docs, shingle, slots, rows), "signatures")
        classes, _ = _classes(signed)
        labels = _linked(docs, classes, shingle, percent)
        if labels is None:
            labels = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
        first = classes.join(labels, classes.rep == labels.node, "left").groupBy(F.coalesce("component", "rep").alias("rep")).agg(F.min(F.struct("first", "row_hash")).alias("stays"))
        stays = first.select(F.col("stays.first").alias("doc_id"), F.col("stays.row_hash").alias("row_hash"))
        gone = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", "row_hash").distinct().join(stays, ["doc_id", "row_hash"], "left_anti")
        gone = keep(gone.select(F.col("doc_id").alias(d), F.col("row_hash").alias(h)), "near-duplicates")
    same = (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64("text") == F.col(h))
    # a map of 2^24 bits of the rows that may go, whatever the data: other texts need no exact join and no shuffle
    place = lambda i, t: F.pmod(F.xxhash64(i, t), F.lit(1 << 24))
    marks = gone.select(place(F.col(d), F.col(h)).alias(k)).groupBy(F.shiftright(k, 6).alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({k} & 63 as int)))").alias(bits))
    flagged = docs.withColumn(k, place(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(F.broadcast(marks), F.shiftright(k, 6) == F.col(word), "left")
    marked = F.coalesce(F.expr(f"(shiftright({bits}, cast({k} & 63 as int)) & 1) = 1"), F.lit(False))
    kept = flagged.where(~marked).select(docs.columns).union(flagged.where(marked).select(docs.columns).join(gone, same, "left_anti"))
    twice = materialize(repeated_rows(docs).select(F.col("doc_id").alias(d), F.col("row_hash").alias(h)), "repeated-rows")
    if twice.isEmpty():
        return kept
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))
    once = kept.join(twice, same, "left_semi").withColumn(n, F.row_number().over(order)).where(F.col(n) == 1)
    return kept.join(twice, same, "left_anti").union(once.select(docs.columns))
