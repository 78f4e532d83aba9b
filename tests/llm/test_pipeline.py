"""The pipeline: each stage on its own input against a brute-force version."""

import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing
from tessera.llm._shared import read_table
from tessera.llm.queries import DOMAINS, TARGETS, tokenizer_path

from .test_operators import LOW, WORD, groups_by_force


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/t"
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[r.asDict() for r in d.collect()] for d in out], [d.columns for d in out], read_table(spark, sf, "benchmark").collect()


def test_columns(stages):
    _, columns, _ = stages
    assert all(c == columns[0] for c in columns[:-1])


def test_language_stage(stages):
    rows, _, _ = stages
    gone = {r["doc_id"] for r in rows[0]} - {r["doc_id"] for r in rows[1]}
    letters = lambda t: any(map(str.isalpha, t or ""))
    assert all(r["doc_id"] in gone for r in rows[0] if not letters(r["text"]))
    assert len(gone) <= 0.02 * len(rows[0])  # prose in one language stays


def test_dedup_stage(stages):
    rows, _, _ = stages
    groups = groups_by_force({r["doc_id"]: r["text"] for r in rows[1]}, 5, 80)
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(i for i, (_, c) in groups.items() if c == i)


def test_decontamination_stage(stages):
    rows, _, bench = stages
    windows = set()
    for b in bench:
        v = WORD.findall((b.text or "").translate(LOW))
        windows |= {tuple(v)} if 0 < len(v) < 10 else {tuple(v[j : j + 10]) for j in range(len(v) - 9)}
    sizes = {len(w) for w in windows}
    dirty = set()
    for r in rows[2]:
        w = WORD.findall((r["text"] or "").translate(LOW))
        if any(tuple(w[j : j + k]) in windows for k in sizes for j in range(len(w) - k + 1)):
            dirty.add(r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(r["doc_id"] for r in rows[2] if r["doc_id"] not in dirty)


def test_mixing_stage(spark, stages):
    rows, _, _ = stages
    before, after = collections.Counter(r["doc_id"] for r in rows[3]), collections.Counter(r["doc_id"] for r in rows[4])
    assert before.keys() == after.keys() and all(after[i] >= before[i] for i in before) and sum(after.values()) > sum(before.values())
    # the expected tokens of each domain have the target weights
    members = mixing.posteriors(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows[3]], "doc_id long, text string"), read_table(spark, "/root/testdata/sf0.001", "labels"), DOMAINS)
    total = [0.0] * len(TARGETS)
    for m in members.collect():
        for k in range(len(total)):
            total[k] += after[m.doc_id] * m.n_tokens * m.p[k]
    assert all(abs(t / sum(total) - w) < 0.03 for t, w in zip(total, TARGETS.values())), total


def test_token_stage(stages):
    rows, _, _ = stages
    tok = Tokenizer.from_file(tokenizer_path())
    ids = {r["doc_id"]: np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4") for r in rows[4]}
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows[5]) == sorted((r["doc_id"], len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]].tobytes())) for r in rows[4])
    at = 0
    for r in sorted(rows[5], key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_run(spark, stages):
    rows, _, _ = stages
    got = [r.asDict() for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()]
    plain = lambda rows: sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert plain(got) == plain(rows[5])
