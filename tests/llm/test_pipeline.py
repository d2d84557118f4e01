"""The whole pipeline on the small tables: every stage takes effect and keeps clean documents."""
import pytest

import corpus_pipeline
from peakgrid.llm.simhash import shingle_hashes

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.store(stage(spark, docs, FOLDER), name)
        out.append((name, before, docs))
    return out


def test_filters_follow_labels(spark, stages):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for name, before, after in stages[:2]:
        assert sorted(after.columns) == sorted(before.columns)
        b, a = ({r.doc_id for r in x.select("doc_id").collect()} for x in (before, after))
        assert a <= b
        short = {r.doc_id for r in before.collect() if len((r.text or "").split()) < 50}
        good = {i for i in b - short if quality.get(i) == 1}
        assert len(good - a) <= 0.01 * len(good), name
    assert not [i for i in a if quality.get(i) == 0]


def test_near_copies_go_and_others_stay(stages):
    _, before, after = stages[2]
    texts = {r.doc_id: set(shingle_hashes(r.text, 5).tolist()) for r in before.collect()}
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    alike = {}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(texts[a] & texts[b])
            j = n / (len(texts[a] | texts[b]) or 1) if n else 0.0
            if j > 0.75:
                alike.setdefault(a, {})[b] = alike.setdefault(b, {})[a] = j
    sure = [(a, b) for a in alike for b, j in alike[a].items() if a < b and j >= 0.85]
    assert sure and not [p for p in sure if p[0] in kept and p[1] in kept]
    assert all(i in kept for i in ids if i not in alike)


def test_packing_takes_all(spark, stages):
    _, before, after = stages[3]
    assert {r.doc_id for r in before.select("doc_id").collect()} == {r.doc_id for r in after.select("doc_id").collect()}
    rows = after.collect()
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_odd_tables(spark):
    kind = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    empty = spark.createDataFrame([], kind)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, "s", None), (2, "a " * 80, None, None, 160), (None, "b c d " * 30, "en", "s", 180)],
                                kind)
    for docs in (empty, odd):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.store(stage(spark, docs, FOLDER), name)
        docs.collect()


def test_dedup_tells_rows_apart(spark):
    """Repeated and null ids: one row of each text stays, and a clean text with a repeated id stays as well."""
    a, b, c, d = ("".join(f"{x}{i} " for i in range(60)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, d), (None, d + "end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], spark.read.parquet(f"{FOLDER}/documents.parquet").schema)
    got = sorted(((r.doc_id, r.text[0]) for r in corpus_pipeline.simhash_dedup(spark, docs, FOLDER).collect()), key=str)
    assert got == [(1, "a"), (5, "b"), (7, "c"), (None, "d")]
