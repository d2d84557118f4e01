"""Language model: exact base scores, normalised probabilities, better than the base on held-out texts."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from peakgrid.llm import lm

KIND = "doc_id long, text string, score double"


def brute(rows):
    def toks(t):
        return [*lm.words_of(t or ""), None]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    seen = Counter(w for i, t in rows if not held[i] for w in toks(t))
    n, v = sum(seen.values()), len(seen)
    return {i: (held[i], len(toks(t)), sum(seen[w] > 0 for w in toks(t)), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in toks(t))) for i, t in rows}


def texts():
    rng = np.random.default_rng(3)
    kinds = [[f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]]
    out = [(i, " ".join(rng.choice(kinds[i % 2], int(rng.integers(5, 60))))) for i in range(1500)]
    return out + [(1500, None), (1501, ""), (1502, "A0 a0\x0bÉ é rare1 rare1"), (1503, "rare2 " * 30_000), (None, "a1 unseen")]


@pytest.mark.parametrize("dictionary, symbols", [(50_000, 4096), (60, 40)])
def test_base_and_model(spark, monkeypatch, dictionary, symbols):
    monkeypatch.setattr(lm, "DICTIONARY", dictionary)
    monkeypatch.setattr(lm, "SYMBOLS", symbols)
    monkeypatch.setattr(lm, "BATCH", 128)
    rows = texts()
    want = brute(rows)
    got = {r.id: r for r in lm.score_texts(spark.createDataFrame([(i, t, 0.0) for i, t in rows], KIND)).collect()}
    assert len(got) == len(rows)
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9), i
    held = [r for r in got.values() if r.held_out and r.id is not None and r.id < 1500]
    assert len(held) > 100
    model, base = (sum(x) / sum(r.n_tokens for r in held) for x in ([r.score for r in held], [r.base_score for r in held]))
    assert model > base + (0.05 if symbols > 100 else -0.02)


def test_probabilities_sum_to_one():
    share = np.random.default_rng(0).random(2 * lm.CLASSES)
    lay = lm.Layout({}, {b"x": 3}, share / share.sum(), 2 * lm.CLASSES, 10, 5, 1)
    par = lm.Parameters(lay)
    every = np.arange(lay.size)
    p = np.exp(par.log_probabilities(np.full(lay.size, 3), np.full(lay.size, 7), every))
    assert math.isclose(p.sum(), 1, rel_tol=1e-5)


def test_empty_and_repeated(spark):
    assert lm.score_texts(spark.createDataFrame([], KIND)).collect() == []
    rows = lm.score_texts(spark.createDataFrame([(1, "a b", 0.0), (1, "a b", 0.0), (1, None, 0.0)], KIND)).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 3]


def test_a_batch_is_not_made_python_objects_as_a_whole():
    import tracemalloc

    import pyarrow as pa
    texts = [f"{i} é " + "word " * 400 for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    found = sum(len(lm.words_of(t)) for _, t in lm.texts_of([batch, batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2 * 4000 * 402 and most < 2_000_000  # the batch has 8 MB of text
    assert [(i, t.decode()) for i, t in lm.texts_of([batch])] == list(enumerate(texts))
