"""Packing: nothing lost, no sequence too long, no gaps, and few sequences."""
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peakgrid.llm import packing
from peakgrid.llm.queries import tokenizer_path

PATH = tokenizer_path()


def one_by_one(counts, size):
    """The same choices without repeats."""
    left, bins = Counter(counts), []
    while +left:
        got, room = [], size
        while fit := [n for n in +left if n <= room]:
            n = max(fit)
            got.append(n)
            left[n] -= 1
            room -= n
        while room and got:
            least = min(got)
            pairs = [(a + b, a, b) for a in +left for b in +left if b <= a and a + b <= room + least and (a != b or left[a] > 1)]
            total, a, b = max(pairs, default=(0, 0, 0))
            if total <= least:
                break
            got.remove(least)
            got += [a, b]
            left[least] += 1
            left[a] -= 1
            left[b] -= 1
            room += least - total
        bins.append(tuple(sorted(got)))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=8), st.integers(20, 40))
def test_repeats_equal_single_steps(counts, size):
    plan = packing.plan_bins(counts, size)
    got = Counter({tuple(sorted(n for n, k in b.items() for _ in range(k))): 0 for _, b in plan})
    for times, b in plan:
        got[tuple(sorted(n for n, k in b.items() for _ in range(k)))] += times
    assert got == Counter(one_by_one(counts, size))
    used = Counter()
    for times, b in plan:
        assert sum(n * k for n, k in b.items()) <= size
        used.update({n: k * times for n, k in b.items()})
    assert used == Counter(counts)


def test_two_small_pieces_beat_one():
    assert packing.plan_bins({10: 1, 5: 1, 3: 1, 4: 1}, 17) == [(1, {10: 1, 4: 1, 3: 1}), (1, {5: 1})]


def test_plan_is_small_for_many_pieces():
    rng = np.random.default_rng(0)
    counts = Counter(np.minimum(4096, rng.lognormal(6, 1.2, 300_000).astype(int) + 1).tolist())
    plan = packing.plan_bins({n: c * 1_000_000 for n, c in counts.items()})
    total = sum(n * c for n, c in counts.items()) * 1_000_000
    bins = sum(t for t, _ in plan)
    assert len(plan) < 20_000 and bins <= 1.0005 * -(-total // 4096)


def check(rows, texts, size):
    library = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // size)))
        for r in parts:
            assert r.start == r.piece * size and r.length == min(size, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size


def test_tables(spark):
    rng = np.random.default_rng(1)
    texts = {i: " ".join(rng.choice(["alpha", "beta,", "Gamma"], int(rng.integers(0, 60)))) for i in range(300)}
    texts |= {300: None, 301: "", 302: "long " * 9000, 303: "x" * 200, **{i: "same text" for i in range(400, 900)}}
    df = spark.createDataFrame([(i, t, i, 0) for i, t in texts.items()], "doc_id long, text string, length long, offset int")
    for size in (64, 4096):
        rows = packing.pack(df, PATH, size).collect()
        check(rows, texts, size)
        total = sum(r.length for r in rows)
        assert len({r.sequence_id for r in rows}) <= -(-total // size) + 2
    whole = {r.sequence_id: r.ids for r in packing.packed_sequences(df, PATH, 64).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in packing.pack(df, PATH, 64).collect()) and max(map(len, whole.values())) <= 64


def test_null_ids_repeats_and_empty(spark):
    kind = "doc_id long, text string"
    rows = packing.pack(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)], kind), PATH).collect()
    assert sorted(r.offset for r in rows) == sorted([0, 3, 6, 9]) and len({r.sequence_id for r in rows}) == 1
    assert packing.pack(spark.createDataFrame([], kind), PATH).collect() == []
