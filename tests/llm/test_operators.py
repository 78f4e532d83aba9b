"""Each operator against brute force on small tables, and on nulls, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import io
import math
import re
import struct
import time
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import _shared, components, decontamination, fingerprints, language_id, lm_scoring, mixing, near_dedup, passages, queries, substring_index, token_output, toxicity

from .conftest import SCHEMA, sentence


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- op1 ------------------------------------------------------------------------------------------------------------

GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den tiefen wald bis zum alten haus".split()


@pytest.fixture(scope="module")
def two_languages(spark):
    rows = []
    for i in range(60):
        words = (sentence(i, 40) if i % 2 else " ".join(GERMAN[zlib.crc32(f"{i}.{k}".encode()) % len(GERMAN)] for k in range(40)))
        rows.append((i, words, "en" if i % 2 else "de", "s", 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_language(spark, two_languages, odd, empty):
    model = language_id.fit(two_languages.where("doc_id < 40"))
    assert model.languages == ["de", "en"]
    got = table(language_id.identify(two_languages, model))
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and got[i].score > 0.8 for i in range(60))
    both = model.infer(" ".join(GERMAN * 4) + ". " + sentence(5, 60))
    assert set(both[2]) == {"de", "en"} and 0.2 < both[3][1] and abs(sum(both[3]) - 1) < 1e-6
    for t in (None, "", "123 !?", "—"):
        assert model.infer(t)[:2] == ("und", 0.0)
    assert language_id.identify(odd, model).count() == 6 and language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert nothing.infer("some text")[0] == "und"
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == 3 and kept.where("lang = 'en'").count() == 3
    held = two_languages.select("doc_id", language_id.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def test_every_language_can_join():
    """Two languages that are never among the best eight alone, in a text of many; the set against all subsets."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.full(60, 0.05), 10).T + 1e-9
    full = np.full((language_id.BUCKETS, 10), 1e-9)
    full[:60] = p / p.sum(axis=0)
    model = language_id.LanguageModel([f"l{i}" for i in range(10)], full)
    for parts in ((0.5, 0.3, 0.2), (1.0,), (0.15,) * 6 + (0.1,)):
        counts = np.round(2000 * sum(w * full[:60, i] for i, w in enumerate(parts))).astype(int)
        draw, language_id.trigram_buckets = language_id.trigram_buckets, lambda t: np.repeat(np.arange(60), counts)
        try:
            name, score, names, shares = model.infer("x")
        finally:
            language_id.trigram_buckets = draw
        assert set(names) == {f"l{i}" for i in range(len(parts))} and np.allclose(sorted(shares), sorted(parts), atol=0.05)
        assert score == shares[0] and name == names[0]


def test_texts_of_several_languages_stay(spark, two_languages):
    model = language_id.fit(two_languages)
    rows = [(1, sentence(5, 60) + " " + " ".join(GERMAN * 3), None, "s", 0), (2, "qxzzkq vvwjq zxqj kqxv jjqzx wqqk", None, "s", 0), (3, "1 2 3", None, "s", 0)]
    kept = table(language_id.keep_identified(spark.createDataFrame(rows, SCHEMA), model))
    assert set(kept) == {1} and kept[1].lang in ("de", "en")


# -- op2 ------------------------------------------------------------------------------------------------------------


def test_mixing(spark, two_languages, odd, empty):
    labels = two_languages.where("doc_id < 50").select("doc_id", (F.col("lang") == "en").cast("int").alias("quality"))
    domains = {"de": "quality = 0", "en": "quality = 1"}
    members = mixing.posteriors(two_languages, labels, domains)
    p = table(members)
    assert all((p[i].p[1] > 0.5) == (i % 2 == 1) and p[i].n_tokens == 40 and abs(sum(p[i].p) - 1) < 1e-9 for i in range(60))
    for least in (0.0, 1.0):
        rated, goal, reached = mixing.fit_rates(members, [0.8, 0.2], least=least)
        r = table(rated)
        sums = [sum(x.rate * x.n_tokens * x.p[k] for x in r.values()) for k in (0, 1)]
        assert np.allclose(sums, goal, rtol=1e-4) and np.allclose(sums, reached, rtol=1e-9) and min(x.rate for x in r.values()) >= least
    # projected gradient by NumPy
    a = np.array([[x.n_tokens * v for v in x.p] for x in sorted(r.values(), key=lambda x: x.doc_id)])
    x, g = np.ones(len(a)), np.linalg.inv(a.T @ a)
    for _ in range(30):
        x = np.maximum(1.0, x - a @ (g @ (a.T @ x - goal)))
    assert np.allclose(x, [r[i].rate for i in sorted(r)], atol=1e-3)
    mixed = mixing.mix(two_languages, rated)
    assert mixed.columns == two_languages.columns and mixed.select("doc_id").distinct().count() == 60 and mixed.count() > 60
    for df in (odd, empty):
        m, _, _ = mixing.fit_rates(mixing.posteriors(df, labels, domains), [0.5, 0.5])
        assert mixing.mix(df, m).columns == df.columns
        assert m.where("isnan(rate) or rate is null").isEmpty()


def test_posteriors_by_force(two_languages):
    labels = two_languages.where("doc_id < 50").select("doc_id", (F.col("lang") == "en").cast("int").alias("quality"))
    got = table(mixing.posteriors(two_languages, labels, {"de": "quality = 0", "en": "quality = 1"}, buckets=1 << 20, evidence=50.0))
    rows = {r.doc_id: WORD.findall((r.text or "").translate(LOW)) for r in two_languages.collect()}
    counts = [collections.Counter(w for i in range(50) if i % 2 == k for w in rows[i]) for k in (0, 1)]
    for i, w in rows.items():
        logs = [min(1.0, 50 / len(w)) * sum(math.log((c[x] + 0.5) / (sum(c.values()) + 0.5 * (1 << 20))) for x in w) for c in counts]
        want = 1 / (1 + math.exp(logs[0] - logs[1]))
        assert math.isclose(got[i].p[1], want, abs_tol=1e-9)


def test_repeated_rows_count_in_the_mixture(spark):
    rows = [(i, " ".join(f"g{(i * 7 + k) % 11}" for k in range(20))) for i in range(100)] + [(1000, " ".join(f"b{k % 5}" for k in range(20)))] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(1000, 0)], "doc_id long, quality int")
    members = mixing.posteriors(docs, labels, {"bad": "quality = 0", "good": "quality = 1"})
    rated, goal, reached = mixing.fit_rates(members, [0.5, 0.5])
    assert np.allclose(goal, reached, rtol=1e-3)
    n = table(mixing.mix(docs, rated).groupBy((F.col("doc_id") == 1000).alias("bad")).count(), "bad")
    assert abs(n[True]["count"] - n[False]["count"]) <= 0.1 * n[False]["count"]


# -- op3 ------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, texts, odd, empty):
    got = table(fingerprints.fingerprint_neighbours(docs))
    ids = sorted(texts)
    for i in ids:
        t, n = texts[i] or "", texts[ids[ids.index(i) - 1]] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[3].fingerprint == got[12].fingerprint and got[15].fingerprint == "1::"
    assert fingerprints.likeness([got[11].fingerprint], [got[13].fingerprint])[0] > 0.5 > fingerprints.likeness([got[11].fingerprint], [got[10].fingerprint])[0]
    assert fingerprints.fingerprint_neighbours(odd).count() == 6 and fingerprints.fingerprint_neighbours(empty).count() == 0
    one = fingerprints.fingerprint_neighbours(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0


def slow_fingerprint(raw):
    """The definition, a byte at a time."""
    n, c, word = len(raw), 0x01000193, 0xFFFFFFFF
    if not n:
        return "1::"
    rolled = []
    for i in range(n):
        h = sum((raw[i - k] + 1) * pow(c, k, 1 << 32) for k in range(min(i + 1, 7))) & word
        h ^= h >> 15
        h = h * 0x2C1B3C6D & word
        rolled.append(h ^ (h >> 12))

    def signature(block):
        cuts = [i + 1 for i in range(n) if rolled[i] % block == 0][: fingerprints.PIECES - 1]
        if not cuts or cuts[-1] < n:
            cuts.append(n)
        out, last = "", 0
        for cut in cuts:
            v = int(fingerprints.mix64(np.array([sum(rolled[last:cut]) + cut - last], np.uint64))[0]) >> 52
            out += chr(fingerprints.LETTERS[v >> 6]) + chr(fingerprints.LETTERS[v & 63])
            last = cut
        return out

    block = 1
    while block * 64 < n:
        block *= 2
    while block > 1 and sum(r % block == 0 for r in rolled) < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def test_fingerprint_by_definition(texts):
    for t in [*texts.values(), "a" * 999, "ab" * 700, "x", sentence(3, 900)]:
        raw = (t or "").encode()[:20_000]
        assert fingerprints.fingerprint(raw) == slow_fingerprint(raw)


def test_edit_distance():
    def indel(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(d[j - 1] if x == y else 1 + min(d[j], e[-1]))
            d = e
        return d[-1]

    rng = np.random.default_rng(0)
    pairs = [tuple("".join(rng.choice(["AA", "AB", "BA", "BB"], rng.integers(0, 65))) for _ in range(2)) for _ in range(200)]
    got = fingerprints.signature_likeness(*map(list, zip(*pairs)))
    for (a, b), g in zip(pairs, got):
        x, y = re.findall("..", a), re.findall("..", b)
        want = 1 - indel(x, y) / (len(x) + len(y)) if x or y else 1.0
        assert math.isclose(g, want, abs_tol=1e-12)


# -- op4 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(docs, texts, order):
    got = table(lm_scoring.score_documents(docs, order=order, batch_chars=3000, part_ngrams=100))
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    all_ = [collections.Counter(g for w in words.values() for g in grams(w, k)) for k in range(1, order + 1)]
    n = sum(map(len, words.values()))
    for i, w in words.items():
        own = [collections.Counter(grams(w, k)) for k in range(1, order + 1)]
        rest = max(n - len(w), 1)
        count = lambda g: all_[len(g) - 1][g] - own[len(g) - 1][g]
        total = 0.0
        for j in range(len(w)):
            s = math.log((count((w[j],)) or 1 / rest) / rest)
            for k in range(2, min(order, j + 1) + 1):
                g = tuple(w[j - k + 1 : j + 1])
                s = math.log(count(g) / count(g[:-1])) if count(g) else s + math.log(0.4)
            total += s
        assert math.isclose(got[i].log_score, total, abs_tol=1e-6) and got[i].n_words == len(w)
    assert got[15].mean_log is None


def test_words_of_a_batch_take_little_memory():
    """Words are hashed by chunks of a batch, with the same hashes."""
    texts = [sentence(i, 2000) for i in range(300)]
    whole = lm_scoring.byte_words(texts, lm_scoring.SPACE, lm_scoring.LOWER)
    tracemalloc.start()
    owner, hashes, _ = lm_scoring.ngrams(texts, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (hashes[0] == lm_scoring.mix64(whole[0])).all() and (np.bincount(owner) == whole[2]).all()
    assert peak < 20 * sum(map(len, texts))
    assert [a.tolist() for a in lm_scoring.ngrams([], 2)[1]] == [[], []]


def test_backoff_of_odd_tables(odd, empty):
    assert lm_scoring.score_documents(odd).count() == 6 and lm_scoring.score_documents(empty).count() == 0


# -- op5 ------------------------------------------------------------------------------------------------------------


def test_compact_windows():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, 300).astype(np.uint64)
    at, width = np.array([0, 120, 120, 300]), 9
    doc, h, left, c, right = passages.compact_windows(values, at, width, 77)
    f = passages.mix64(values ^ np.uint64(77)) | np.uint64(1)
    seen = {(d, p, q) for d, p, q in ((int(a), int(b), int(e)) for a, b, e in zip(doc, left, right))}
    for d in range(3):
        own = f[at[d] : at[d + 1]] >> np.uint64(32)
        for b in range(len(own) - width + 1):
            low = own[b : b + width].min()
            hits = [k for k in range(len(c)) if doc[k] == d and left[k] <= b and right[k] >= b + width - 1 and b <= c[k] < b + width and (np.uint64(h[k]) >> np.uint64(32) if h[k] >= 0 else h[k : k + 1].view(np.uint64)[0] >> np.uint64(32)) == low]
            assert hits, (d, b)
    assert len(seen) and all(q - p + 1 >= width for _, p, q in seen)


def test_passages(docs, texts, odd, empty):
    got = table(passages.near_duplicate_passages(docs))
    first, spans = {}, {}
    for i, t in sorted(texts.items()):
        w = (t or "").encode().lower().split()
        hit = np.zeros(len(w), bool)
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), i) < i:
                hit[p : p + 50] = True
        have = np.zeros(len(w), bool)
        for s in got[i].spans:
            have[s.start : s.stop] = True
        assert not (hit & ~have).any() and got[i].n_words == len(w) and got[i].n_dup == have.sum()
    assert got[12].sources == [3] and got[12].class_id == 3 and got[13].class_id == 11 and got[13].n_dup > 0.9 * got[13].n_words
    assert set(got[14].sources) == {4, 6} and got[14].class_id == 4 and got[6].class_id == 4
    assert got[9].n_dup == 0 and got[9].class_id == 9 and got[16].n_words == 0
    assert passages.near_duplicate_passages(odd).count() == 6 and passages.near_duplicate_passages(empty).count() == 0


@pytest.mark.parametrize("n_words", [49, 50, 51, 64, 79, 80])
def test_windows_of_a_lone_document(n_words):
    values, at, _ = passages.tokens([sentence(31, n_words)])
    alone = passages.compact_windows(values, at, 46, 77)
    values, at, _ = passages.tokens([sentence(31, n_words), sentence(32, 500)])
    beside = passages.compact_windows(values, at, 46, 77)
    assert (len(alone[0]) > 0) == (n_words >= 50)
    # positions: a chunk numbers its entries, which only decides between equal hashes
    assert [x.tolist() for x in alone] == [x[beside[0] == 0].tolist() for x in beside]


def test_passages_of_lone_documents(spark):
    rows = [(i, sentence(31, 50), None, None, None) for i in range(3)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), SCHEMA)
    got = table(passages.near_duplicate_passages(docs))
    assert [got[i].n_dup for i in range(3)] == [0, 50, 50] and all(r.class_id == 0 for r in got.values())


def test_passages_of_an_id_with_several_texts(spark):
    rows = [(1, sentence(31, 60)), (1, sentence(33, 200)), (2, sentence(31, 60)), (2, "short"), (3, sentence(34, 20) + " " + sentence(33, 200))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(2)
    got = passages.near_duplicate_passages(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_dup) for r in got) == [(1, 60, 0), (1, 200, 0), (2, 1, 0), (2, 60, 60), (3, 220, 200)]


def families(n_families, n_variants, changes, near):
    """Families of variants of a 60-word passage in surroundings of their own, and a copy of the middle one (with a word changed, if near)."""
    rows, asked, k = [], {}, 0
    fresh = lambda n: " ".join(f"s{k}_{j}" for j in range(n))
    for f in range(n_families):
        base = [f"f{f}_{j}" for j in range(60)]
        variants = []
        for v in range(n_variants):
            w = list(base)
            for c in range(changes):
                w[zlib.crc32(f"{f}.{v}.{c}".encode()) % 60] = f"x{f}_{v}_{c}"
            variants.append(w)
        for w in variants:
            rows.append((k, fresh(40) + " " + " ".join(w) + " " + fresh(40)))
            k += 1
        copy = list(variants[n_variants // 2])
        if near:
            copy[30] = f"changed{f}"
        asked[k] = k - n_variants + n_variants // 2
        rows.append((k, fresh(25) + " " + " ".join(copy) + " " + fresh(60)))
        k += 1
    return rows, asked


@pytest.mark.parametrize("n_variants, changes, near", [(1, 2, False), (9, 2, False), (25, 2, False), (25, 3, False), (25, 2, True), (150, 2, True)])
def test_passages_of_families(spark, n_variants, changes, near):
    rows, asked = families(40 if n_variants < 100 else 10, n_variants, changes, near)
    got = table(passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    found = sum(got[i].n_dup >= 50 and got[i].class_id == got[j].class_id for i, j in asked.items())
    print("recall", n_variants, changes, near, found, len(asked))
    # beyond ALL_PAIRS variants a near copy is tried against some of them only
    assert found >= (0.6 if near and n_variants > passages.ALL_PAIRS else 0.95) * len(asked)
    assert all(r.n_dup <= 60 for r in got.values())


def test_large_families_hide_nothing(spark):
    """A near copy found beside its source alone is found among 149 other variants too."""
    rows, asked = families(10, 150, 2, True)
    only = {*asked, *asked.values()}
    counts = []
    for some in (rows, [r for r in rows if r[0] in only]):
        got = table(passages.near_duplicate_passages(spark.createDataFrame(some, "doc_id long, text string").repartition(4)))
        counts.append({i for i, j in asked.items() if got[i].n_dup >= 50 and got[i].class_id == got[j].class_id})
    assert counts[1] <= counts[0] and len(counts[1]) >= 9


def test_tries_are_on_disk_by_slices(spark, monkeypatch):
    """However large the groups, few tries are stored at a time, and the result is that of one slice."""
    docs = spark.createDataFrame(families(2, 150, 2, True)[0], "doc_id long, text string").repartition(4)
    whole, tried, store = table(passages.near_duplicate_passages(docs)), [], passages.materialize

    def materialize(df, name):
        out = store(df, name)
        if name == "tries":
            tried.append(out.count())
        return out

    monkeypatch.setattr(passages, "materialize", materialize)
    monkeypatch.setattr(passages, "_TRIES", 40000, raising=False)
    monkeypatch.setattr(passages, "_TRIES_A_ROW", 0, raising=False)
    assert table(passages.near_duplicate_passages(docs)) == whole
    assert sum(tried) > 100000 and max(tried) < 60000


def test_texts_are_shipped_once_for_many_pairs(spark):
    """Pairs of a clique, of a hub with many copies and lone ones: all are dealt, with far fewer texts than pairs."""
    pairs = {(u, v) for v in range(300) for u in range(v)} | {(1000, v) for v in range(1001, 3000)} | {(u, u + 1) for u in range(5000, 5100, 2)}
    df = spark.createDataFrame([(u, v, [1, 2]) for u, v in pairs], "u long, v long, w array<long>")
    got = passages._dealt(df).collect()
    assert len(got) == len(pairs) and {(r.u, r.v) for r in got} == pairs
    cells = {}
    for r in got:
        cells.setdefault(r.cell, []).append(r)
    assert sum(len({r.u for r in c}) + len({r.v for r in c}) for c in cells.values()) < len(pairs) / 5
    assert max(len(c) for c in cells.values()) < 20000 and max(len({r.v for r in c}) for c in cells.values() if c[0].u == 1000) < 400


def test_passages_do_not_depend_on_the_order_of_windows():
    rng = np.random.default_rng(8)
    for _ in range(40):
        a = rng.integers(0, 400, 300).astype(np.uint64)
        b = a[20:].copy()
        b[rng.integers(0, len(b), 25)] = 999
        c = np.flatnonzero(np.isin(a, b))[:60]
        c2 = np.array([rng.choice(np.flatnonzero(b == a[i])) for i in c])
        mine = {"i": rng.integers(0, 5, len(c)), "l": np.maximum(c - 60, 0), "c": c, "r": c + 60, "l2": np.maximum(c2 - 60, 0), "c2": c2, "r2": c2 + 60}
        got = []
        for order in (np.arange(len(c)), rng.permutation(len(c)), np.arange(len(c))[::-1]):
            got.append(passages._confirm(a, b, np.unique(b), {f: x[order] for f, x in mine.items()}, 2, 46, 0.8))
        assert got[0] == got[1] == got[2]


def test_pairs_of_classes_by_force():
    rng = np.random.default_rng(6)
    key, label, known = np.sort(rng.integers(0, 9, 300)), rng.integers(0, 4, 300), rng.integers(0, 3, 300) > 0
    order = np.lexsort((label, ~known, key))
    key, label, known = key[order], label[order], known[order]
    want = {(i, j) for i in range(300) for j in range(i) if key[i] == key[j] and not (known[i] and known[j] and label[i] == label[j])}
    got = [p for x, y in passages._pairs_of_classes(key, label, known, 100) for p in zip(x.tolist(), y.tolist())]
    assert len(got) == len(want) and set(got) == want
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(300)), pa.array(np.arange(300)), pa.array(label, mask=~known)], ["key", "doc", "place", "label"])
    for size in (300, 7):
        given = [p for b in passages._rest(rows.slice(i, size) for i in range(0, 300, size)) for p in zip(*(c.to_pylist() for c in b.columns[:2]))]
        assert len(given) == len(want) and set(given) == want


def test_tries_of_windows_by_force():
    """Small groups: every pair of classes; whatever the sizes of the chunks."""
    rng = np.random.default_rng(5)
    rows = np.stack([rng.integers(0, 40, 900), rng.integers(0, 60, 900), np.arange(900) << 33, rng.integers(0, 9, 900)])
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    want = set()
    firsts = {}
    for k, d, p, w in rows.T.tolist():
        if (k, w) in firsts:
            want.add((d, firsts[k, w][0], p, firsts[k, w][1]))
        else:
            want |= {(d, e, p, q) for (k2, _), (e, q) in firsts.items() if k2 == k}
            firsts[k, w] = (d, p)
    want = {x for x in want if x[1] < x[0]}
    for size in (1000, 70, 13):
        meeting, got = passages._Meeting(), set()
        for i in range(0, 900, size):
            got |= set(zip(*(c.to_pylist() for c in meeting.take(rows[:, i : i + size], i + size >= 900).columns[:4])))
        assert got == want


# -- op6 ------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def test_contamination(spark, docs, texts, odd, empty):
    items = [(1, texts[2][20:140].upper()), (2, "jumps over a lazy"), (3, None), (4, "éàünï çödé ДОМ"), (10, texts[2][20:140]), (5, "!?"), (6, sentence(500, 30)), (None, sentence(5, 11))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = table(decontamination.contamination(docs, bench))
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for k, x in items:
            v = WORD.findall((x or "").translate(LOW))
            wins = [v] if 0 < len(v) < 10 else [v[j : j + 10] for j in range(len(v) - 9)]
            for win in wins:
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit.update(range(j, j + len(win)))
                        if k is not None:
                            found.add(str(k))
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (len(w), len(hit), sorted(found)), i
    assert any(r.n_hit for r in got.values())
    assert decontamination.contamination(odd, bench).count() == 6 and decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.where("false")).where("n_hit > 0").isEmpty()
    null = decontamination.contamination(odd, spark.createDataFrame([(1, sentence(1, 12))], "item_id long, text string")).where("n_hit > 0")
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in null.collect()) == [(0, 60, 12, ["1"]), (1, 60, 12, ["1"]), (1, 60, 12, ["1"])]


def test_contamination_without_broadcasts(monkeypatch, spark, docs, texts):
    bench = spark.createDataFrame([(i, texts[i][9:200]) for i in range(12)] + [(99, "jumps over a lazy"), (98, "moonlight"), (97, "near an")], "item_id long, text string")
    plain = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in df.collect())
    want = plain(decontamination.contamination(docs, bench))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    assert plain(decontamination.contamination(docs, bench)) == want and sum(r[2] for r in want)


def test_index_is_kept_by_term(docs):
    index = decontamination.build_index(docs)
    assert index.columns == ["term", "doc_id", "row_hash", "pos"]
    plan = index.where("term = 'fox'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,fox)" in plan and "ArrowEval" not in plan
    files = {}
    for r in index.select(F.input_file_name().alias("f"), "term").collect():
        files.setdefault(r.f, []).append(r.term)
    assert all(t == sorted(t) for t in files.values())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (None, "gamma beta alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "alpha beta gamma x"), ("r", None)], "item_id string, text string")
    got = decontamination.proximity_matches(decontamination.build_index(docs), bench, terms=3, span=8).collect()
    assert {(r.doc_id, r.item, r.start, r.stop) for r in got} == {(1, "q", 0, 5), (None, "q", 0, 2)}


def test_proximity_by_force(spark):
    words = {1: ["x"] * 130, **{i: [("alpha", "beta", "gamma", "x", "x", "x", "x", "x")[zlib.crc32(f"{i}.{k}".encode()) % 8] for k in range(120)] for i in range(2, 6)}}
    for at, w in ((100, "alpha"), (85, "beta"), (116, "beta"), (115, "gamma")):
        words[1][at] = w
    for span in (20, 5):
        index = decontamination.build_index(spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string"))
        bench = spark.createDataFrame([("q", "alpha beta gamma")], "item_id string, text string")
        freq = {t: sum(w.count(t) for w in words.values()) for t in ("alpha", "beta", "gamma")}
        rarest, want = min(freq, key=lambda t: (freq[t], t)), []
        for i, w in words.items():
            for at in (k for k, t in enumerate(w) if t == rarest):
                fits = [(e - b, b, e) for b in range(max(0, at - span + 1), at + 1) for e in range(at, min(len(w), b + span)) if {"alpha", "beta", "gamma"} <= set(w[b : e + 1])]
                want += [(i, *min(fits)[1:])] if fits else []
        got = decontamination.proximity_matches(index, bench, terms=3, span=span).collect()
        assert sorted((r.doc_id, r.start, r.stop) for r in got) == sorted(want)
        assert span < 20 or (1, 100, 116) in want


# -- op7 ------------------------------------------------------------------------------------------------------------


def remove_by_force(texts, length=50):
    first, out = {}, {}
    for i, t in sorted(texts.items()):
        raw = (t or "").encode()
        hit = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first.setdefault(raw[p : p + length], i) < i:
                hit[p : p + length] = True
        edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~hit])
        out[i] = (len(raw), int(hit.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(docs, texts, odd, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in substring_index.remove_repeats(docs, block_bytes=4000).collect()}
    assert got == remove_by_force(texts)
    found = substring_index.remove_repeats(odd)
    assert found.count() == 6 and found.where("doc_id is null and n_bytes > 0 and n_removed = n_bytes").count() == 1
    assert found.where("doc_id = 1 and n_removed = 0").count() == 2 and substring_index.remove_repeats(empty).count() == 0


def test_repeats_of_periods(spark):
    rows = {1: "ab" * 60, 2: "x" + "ab" * 60 + "y", 3: "b" * 200, 4: "b" * 49, 5: "b" * 51, 6: "é" * 40, 7: "zz" + "é" * 26}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in substring_index.remove_repeats(df).collect()}
    assert got == remove_by_force(rows)


@pytest.mark.parametrize("length", [2, 4, 9, 20])
def test_index(length):
    rng = np.random.default_rng(length)
    texts = [b"abracadabra", b"abracadabra", b"cadabrax", b"aaaaaaaaaaaaaaaaaaaaaaaaaaa", b""] + [bytes(rng.choice([97, 98], rng.integers(1, 60)).astype(np.uint8)) for _ in range(60)]
    text = b"".join(t + b"\xff" for t in texts)
    arr = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(arr == 255)
    rest = ends[np.searchsorted(ends, np.arange(len(arr)))] - np.arange(len(arr))
    index = substring_index.RunLengthIndex(arr, rest, length)
    got = {int(p): int(f) for at, first in index.stream(arr) for p, f in zip(at, first)}
    want, seen = {}, {}
    for p in np.flatnonzero(rest >= length).tolist():
        want[p] = seen.setdefault(text[p : p + length], p)
    assert got == want
    assert len(index.run_starts) == len(index.first_samples) == len(index.last_samples) == len(index.run_bytes)
    # the transform's bytes decide: with one byte for all of them the steps lead elsewhere
    index._byte_keys = np.sort(index.run_starts | (97 << 40))
    try:
        again = {int(p): int(f) for at, first in index.stream(arr) for p, f in zip(at, first)}
    except IndexError:
        again = None
    assert again != want


def test_shuffled_anchors_do_not_stay(spark):
    """The shuffle of all anchors is off the disks before the contexts are read."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    size = lambda: sum(f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()))
    spark._jvm.System.gc()
    time.sleep(3)
    df = spark.createDataFrame([(i, sentence(i, 3000)) for i in range(100)], "doc_id long, text string")
    before = size()
    found = substring_index.remove_repeats(df)
    for _ in range(20):
        if (left := size() - before) < 200_000:
            break
        time.sleep(0.5)
    assert left < 200_000 and found.count() == 100


def test_repeats_of_rows_without_ids(spark):
    """Rows that share an id, or have none, never mark each other, however many there are."""
    rows = [(None, sentence(i % 40, 30)) for i in range(80)] + [(1, sentence(3, 30)), (1, sentence(4, 30)), (1, sentence(4, 30)), (2, sentence(4, 30))]
    got = substring_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    marked = collections.Counter((r.doc_id, r.n_removed == r.n_bytes, r.n_removed == 0) for r in got)
    assert marked == {(None, True, False): 4, (None, False, True): 76, (1, False, True): 3, (2, True, False): 1}


# -- op8 ------------------------------------------------------------------------------------------------------------


def groups_by_force(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("shingle", [2, 5])
def test_groups(docs, texts, shingle):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(docs, shingle=shingle).collect()}
    assert got == groups_by_force(texts, shingle, 80)


def test_groups_of_many_variants(spark):
    """A large group of near copies with outliers, where not every pair is similar."""
    base = sentence(3, 150).split()
    rows = {}
    for i in range(120):
        w = list(base)
        for k in range(zlib.crc32(f"k{i}".encode()) % 16):
            w[zlib.crc32(f"{i}:{k}".encode()) % 150] = f"w{i}_{k}"
        rows[i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(df, shingle=2).collect()}
    want = groups_by_force(rows, 2, 80)
    assert got == want and len({c for _, c in want.values()}) > 1


def test_groups_in_a_bucket_of_boilerplate(spark, monkeypatch):
    """Large open buckets, searched by rare shingles, against brute force."""
    rows = {i: sentence(3, 60) + " " + " ".join(f"a{i}_{k}" for k in range(25)) for i in range(60)}
    for i in range(60, 75):  # near copies of some, whose shingles are few beside the boilerplate
        rows[i] = rows[i - 60].replace(f"a{i - 60}_3 ", "other ")
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = groups_by_force(rows, 2, 80)
    seen = []
    found = near_dedup.rare_pairs
    monkeypatch.setattr(near_dedup, "rare_pairs", lambda *a: seen.append(1) or found(*a))
    # many short bands: all texts meet in the boilerplate
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(df, shingle=2, slots=96, rows=1).collect()}
    assert got == want and len({c for _, c in want.values()}) == 60 and seen


def test_rare_shingles_of_a_class_are_listed_once(spark, monkeypatch):
    """However many open buckets a class is in, its shingles are a row each; a bucket of two needs no second step."""
    rows = {i: sentence(3, 60) + " " + " ".join(f"a{i}_{k}" for k in range(25)) for i in range(40)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    made, write = {}, near_dedup.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(df, shingle=2, slots=96, rows=1).collect()}
    assert got == groups_by_force(rows, 2, 80)
    assert 0 < sum(n for name, n in made.items() if name.endswith("-elements")) <= 2 * sum(n for n, _ in got.values())
    made.clear()
    got = near_dedup.near_duplicate_groups(df.where("doc_id < 2"), shingle=2, slots=96, rows=1)
    assert got.count() == 2 and made["open-buckets"] == 0


def test_groups_of_an_id_with_several_texts(spark):
    changed = sentence(40, 80).split()
    changed[3] = "changed"
    rows = [(5, sentence(1, 80)), (5, sentence(40, 80)), (9, " ".join(changed)), (11, sentence(40, 80)), (3, sentence(1, 80).upper() + "\n"), (7, ""), (7, sentence(60, 80)), (8, sentence(60, 80))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicate_groups(df, shingle=2).collect()}
    assert got == {(5, 3, False), (9, 3, False), (11, 3, False), (3, 3, True), (7, 7, True), (8, 7, False)}
    kept = sorted((r.doc_id, r.text) for r in near_dedup.keep_one_of_each(df, shingle=2).collect())
    assert kept == sorted([(3, rows[4][1]), (5, rows[1][1]), (7, ""), (7, rows[6][1])])


def test_texts_that_stay_are_not_shuffled(spark, docs, texts):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for tables of any size
    try:
        kept = near_dedup.keep_one_of_each(docs)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        rows = kept.collect()
    finally:
        spark.conf.set(key, before)
    assert "LeftOuter, BuildRight" in plan and plan.count("LeftAnti") == 1  # the exact join is behind the map of what may go
    groups = groups_by_force(texts, 5, 80)
    assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in groups.items() if c == i)


def test_groups_of_odd_tables(odd, empty, docs):
    got = near_dedup.near_duplicate_groups(odd, shingle=2)
    assert got.count() == 6 and got.where("doc_id is null and component_id is null and kept").count() == 2
    assert near_dedup.near_duplicate_groups(empty).count() == 0
    once = near_dedup.keep_one_of_each(odd)
    assert once.columns == odd.columns and once.where("doc_id = 1").count() == 1 and once.count() == 5
    kept = {r.doc_id for r in near_dedup.keep_one_of_each(docs).collect()}
    assert 3 in kept and 12 not in kept and 13 not in kept and 11 in kept


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for j in (0.2, 0.5, 0.8):
        for _ in range(20):
            n = 300
            both = int(2 * n * j / (1 + j))
            pool = rng.integers(1, 1 << 52, 2 * n).astype(np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            v, o = np.concatenate([a, b]), np.repeat([0, 1], n)
            s = near_dedup.superminhash(v, o, 2, 96)
            errors.append((s[0] == s[1]).mean() - j)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    for n in (1, 3):
        s = near_dedup.superminhash(np.arange(1, n + 1, dtype=np.uint64), np.zeros(n, np.int64), 1, 96)
        assert (s >> np.uint64(48)).max() < 96


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {x: x for p in pairs for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: find(n) for n in up if n in got} and all(n in got for n in up if any(n in p and p[0] != p[1] for p in pairs))
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- op9 ------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, odd, empty):
    rows = []
    for i in range(400):
        t = sentence(i, 50)
        if i % 5 == 0:
            t += " you utter scoundrel"
        if i % 4 == 0:
            t = t.replace(" ", " ### ")
        rows.append((i, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 4 != 0).cast("int").alias("quality"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    chain = toxicity.fit_chain(docs, labels, {"low_quality": "quality = 0", "toxicity": "toxic = 1"}, max_rows=250)
    assert chain.models[1].extra.shape == (1,)
    got = table(toxicity.score(docs, chain))
    held = range(300, 400)
    assert sum((got[i].toxicity >= 0.5) == (i % 5 == 0) for i in held) >= 97
    assert sum((got[i].low_quality >= 0.5) == (i % 4 == 0) for i in held) >= 97
    assert toxicity.score(odd, chain).count() == 6 and toxicity.score(empty, chain).count() == 0
    none = toxicity.fit_chain(docs, labels.where("false"), {"a": "toxic = 1"})
    assert table(toxicity.score(docs.where("doc_id < 3"), none))[0].a < 1e-3


def test_linear_fit_against_a_slow_one():
    """The penalised loss that the fit reaches, beside plain proximal gradient on the dense matrix; and its scores."""
    rng = np.random.default_rng(8)
    n, k, lasso = 300, 25, 2.5e-3
    x = rng.random((n, k)) < 0.3
    y = (x[:, 0] | x[:, 3] & x[:, 5] | (rng.random(n) < 0.05)).astype(float)
    dense = rng.normal(0, 1, (n, 1)) + 2 * y[:, None]
    owner, bucket = np.nonzero(x)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n

    def loss(w, u, b):
        z = x @ w + dense @ u + b
        return float((share * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + lasso * np.abs(w).sum())

    w, u, b, step = np.zeros(k), np.zeros(1), 0.0, 0.2
    for _ in range(20_000):
        r = (1 / (1 + np.exp(-(x @ w + dense @ u + b))) - y) * share
        w = w - step * (x.T @ r)
        w, u, b = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0), u - step * (dense.T @ r), b - step * r.sum()
    m = toxicity.fit_linear(owner, bucket, dense, y, lasso=lasso, steps=600)
    assert loss(m.weights[:k], m.extra, m.bias) <= 1.02 * loss(w, u, b) and not m.weights[k:].any()
    assert np.allclose(m.score(owner, bucket, dense), x @ m.weights[:k] + dense @ m.extra + m.bias)


# -- op10 -----------------------------------------------------------------------------------------------------------


def test_token_files(spark, docs, texts, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    manifest = token_output.write_documents(docs, path, 2, frame_ids=1000)
    got = {r.doc_id: r for r in token_output.read_digests(manifest).collect()}
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in texts.items()}
    at = 0
    for i in sorted(texts):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    some = {r.doc_id: r.ids for r in token_output.read_documents(manifest, [3, 21]).collect()}
    assert set(some) == {3, 21} and all(some[i] == ids[i].tolist() for i in some)
    assert token_output.read_digests(token_output.write_documents(odd, path, 2)).where("doc_id is null").count() == 2
    assert token_output.read_digests(token_output.write_documents(empty, path, 2)).count() == 0


def test_copies_are_dealt_once_and_written_each(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    rows = [(5, sentence(5, 4000))] * 3 + [(5, sentence(6, 9)), (None, None), (None, ""), (5, sentence(5, 4000)), (1, "a"), (1, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    packed = token_output.pack_rows(docs).collect()
    assert [(r.doc_id, r.copies) for r in packed] == [(5, 3), (5, 1), (None, 1), (None, 1), (5, 1), (1, 2)]
    assert len(packed[0].packed) < len(rows[0][1]) / 2
    got = token_output.read_documents(token_output.write_documents(docs, path, 2)).orderBy("start").collect()
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    assert sorted(((r.doc_id or 0, r.ids) for r in got)) == sorted((i or 0, ids) for i, ids in want)
    assert [r.doc_id for r in got] == [None, None, 1, 1, 5, 5, 5, 5, 5]
    assert [r.start for r in got] == [sum(len(x.ids) for x in got[:k]) for k in range(len(got))]


def test_other_tokenizers_get_whole_texts(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok, texts = Tokenizer.from_file(path), ["Hello World, it's fine.", "", "  two  spaces\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in token_output.read_documents(token_output.write_documents(docs, path, 2)).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


def test_pieces_are_those_of_the_tokenizer():
    cache = token_output.WordCache(queries.tokenizer_path(), "<u2")
    for s in ["a<|startoftext|>b c", "x<|ENDOFTEXT|> é, É,", "é́ x\u0085y z\x1cw\x0bq\x0cr", "ΑΣ ΣΑΣ. İx", "don't we'll go 123 १२", "  ", "x's. y' l'été, … é…, ß. ÷. aé÷, ×!! été!!! ÉTÉ. don't! a'' z<b>", "Hi, there. A.B, c.. d, 9. 東京, 東。"]:
        want = cache.tokenizer.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(cache.encode_all([s])[0], "<u2").tolist() == want, s


def test_frames():
    sink = io.BytesIO()
    w = token_output.FrameWriter(sink, "<u2", 4, 3)
    for d, n in ((5, 3), (None, 9), (7, 1)):
        w.add(d, np.arange(n, dtype="<u2").tobytes())
    w.close()
    raw = sink.getvalue()
    r = token_output.FrameReader(io.BytesIO(raw))
    assert [r.doc_id(i) for i in range(3)] == [5, None, 7] and r.ids(1).tolist() == list(range(9)) and len(r.frames) == 6
    assert struct.unpack("<I", raw[-4:])[0] == token_output.SEEKABLE
    # the frames alone are a plain Zstandard stream
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == np.concatenate([np.arange(n, dtype="<u2") for n in (3, 9, 1)]).tobytes()
    bad = bytearray(raw)
    bad[6] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_output.FrameReader(io.BytesIO(bytes(bad))).ids(0)


def test_the_driver_gives_memory_back_and_needs_no_tokenizer(spark, monkeypatch):
    calls = []
    heap = lambda total: SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 100)
    for total in (50, 51, 99):
        jvm = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap(total)), System=SimpleNamespace(gc=lambda: calls.append(total)))
        _shared.give_back(SimpleNamespace(_jvm=jvm))
    assert calls == [51, 99]
    import tokenizers

    docs, path = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), queries.tokenizer_path()
    monkeypatch.setattr(tokenizers, "Tokenizer", None)  # here, not in the workers
    assert token_output.write_documents(docs, path, 2).count() == 1


def test_a_worker_gives_memory_back_after_its_task(monkeypatch):
    at = []
    monkeypatch.setattr(_shared, "release", lambda: at.append("released"))
    for x in _shared.lean(lambda batches: (2 * b for b in batches))([1, 2]):
        at.append(x)
    assert at == [2, 4, "released"]
    monkeypatch.undo()
    held = [b"x" * (100_000 + i) for i in range(1000)]  # too small to be mapped alone: only trimming frees them
    size = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1])
    before, last = size(), held.pop()
    del held
    _shared.release()
    assert size() < before - 80_000 and last


# -- streams that carry state from one Arrow batch to the next --------------------------------------------------------


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


def test_carried_state(small_batches, docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in substring_index.remove_repeats(docs, block_bytes=500).collect()}
    assert got == remove_by_force(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(docs, shingle=2).collect()}
    assert got == groups_by_force(texts, 2, 80)
    got = table(passages.near_duplicate_passages(docs))
    assert got[12].sources == [3] and set(got[14].sources) == {4, 6} and got[13].class_id == 11
    got = table(fingerprints.fingerprint_neighbours(docs))
    assert len(got) == len(texts) and got[3].fingerprint == got[12].fingerprint
