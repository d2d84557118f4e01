"""SimHash against brute force."""
import itertools

import numpy as np
import pytest
import xxhash

from peakgrid.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """id -> smallest id reachable; fps: id -> fingerprint."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in fps}


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"W{i}É" for i in range(300)]
    texts = []
    for _ in range(30):
        base = list(rng.choice(words, 200))
        for _ in range(5):
            copy = list(base)
            copy[int(rng.integers(200))] = "zz"
            texts.append(" ".join(copy))
    texts += ["", None, "  \t\n", "One", "one", "Two Words", "a b c", " x y\x0bz", "long " * 30_000]
    df = spark.createDataFrame([(i, t, "x", "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string, component string")
    got = {r.id: r for r in simhash.near_groups(df).collect()}
    want = {i: slow_fingerprint(t or "") for i, t in enumerate(texts)}
    roots = slow_components(want)
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == want
    assert {i: r.component for i, r in got.items()} == roots
    assert len(set(roots.values())) < len(texts) - 20


@pytest.mark.parametrize("limit", [2, 4, 256])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, limit):
    """Values that crowd a few buckets are split by finer masks, down to groups of three free bits."""
    monkeypatch.setattr(simhash, "PAIRWISE", limit)
    rng = np.random.default_rng(limit)
    fps = {int(x) for x in rng.integers(0, 1 << 7, 60)} | {(int(x) << 50) - (1 << 60) for x in rng.integers(0, 1 << 9, 60)}
    pairs = {(r.a, r.b) for r in simhash.linked_pairs(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert all(0 < bin((a ^ b) % (1 << 64)).count("1") <= 3 for a, b in pairs)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    keep = sorted(fps)
    want = slow_components({i: x % (1 << 64) for i, x in enumerate(keep)})
    assert {x: find(x) for x in fps} == {keep[i]: keep[j] for i, j in want.items()}


def test_finer_masks_keep_every_close_pair():
    rng = np.random.default_rng(3)
    masks = {0}
    for _ in range(6):
        for m in list(masks)[:20]:
            finer = simhash.finer_masks(m)
            free = [i for i in range(64) if not m >> i & 1]
            assert bool(finer) == (len(free) > 3)
            for _ in range(10 if finer else 0):
                flip = sum(1 << int(b) for b in rng.choice(free, 3, replace=False))
                assert any(flip & f == 0 for f in finer)
        masks = {f for m in list(masks)[:20] for f in simhash.finer_masks(m)} or masks


def test_empty_null_ids_and_repeats(spark):
    kind = "doc_id long, text string"
    assert simhash.near_groups(spark.createDataFrame([], kind)).collect() == []
    rows = simhash.near_groups(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (3, "c d")], kind)).collect()
    assert sorted((r.id is None, r.component or -1) for r in rows) == [(False, 3), (False, 7), (False, 7), (True, -1)]
    assert simhash.near_duplicates(spark.createDataFrame([], kind)).collect() == []


def test_near_duplicates_by_similarity(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(2000)]
    rows, want = [], {}
    for g in range(40):
        base = list(rng.choice(words, 400))
        for c in range(4):
            copy = list(base)
            for _ in range(c * 2):  # each change touches five shingles: 0.9 alike or more
                copy[int(rng.integers(400))] = f"n{rng.integers(10**6)}"
            want[len(rows)] = g * 5
            rows.append((len(rows), " ".join(copy)))
        far = list(base)
        for i in range(0, 400, 12):
            far[i] = f"n{rng.integers(10**6)}"
        want[len(rows)] = len(rows)
        rows.append((len(rows), " ".join(far)))
    want[len(rows)] = len(rows)
    rows += [(len(rows), None), (len(rows) + 1, "")]
    want[len(rows) - 1] = len(rows) - 2
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_equal_texts_in_a_large_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same words again and again' ELSE 'text ' || id || ' of ' || id * 7 END AS text")
    got = {r.id: r.component for r in simhash.near_duplicates(df).collect()}
    assert all(got[i] == 0 for i in range(0, 3000, 3))
    assert len({got[i] for i in range(3000) if i % 3}) == 2000


def changed(rng, words, own):
    """``words`` with one run of words replaced, so that ``own`` five-word shingles are new."""
    at = int(rng.integers(4, len(words) - own - 4))
    return words[:at] + [f"n{x}" for x in rng.integers(10**9, size=own - 4)] + words[at + own - 4:]


def alike(words, own):
    return (len(words) - 4 - own) / (len(words) - 4 + own)


def test_pairs_about_the_limit(spark):
    """Pairs from 0.80 to 0.85 are found (all but 0.01), pairs from 0.75 to 0.79 never."""
    rng = np.random.default_rng(9)
    rows, above, below = [], [], []
    for g in range(400):
        words = [f"w{x}" for x in rng.integers(10**9, size=202)]
        own = (22, 24, 18 + g % 5, 25 + g % 4)[g % 4]
        assert alike(words, own) >= 0.8 or 0.75 <= alike(words, own) <= 0.79
        (above if own <= 22 else below).append((2 * g, 2 * g + 1))
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(changed(rng, words, own)))]
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(above) > 150 and sum(got[a] != got[b] for a, b in above) <= 2
    assert all(got[a] != got[b] for a, b in below)


def test_pairs_in_a_template_family(spark):
    """4,000 texts about 0.7 alike by their template, with pairs of 0.85 among them: all are found and nothing else is linked."""
    rng = np.random.default_rng(4)
    template, rows, pairs = [f"t{x}" for x in range(404)], [], []
    for g in range(2000):
        one, other = (list(template) for _ in range(2))
        for words in (one, other):
            for i in rng.choice(np.arange(2, 404, 5), 14, replace=False):
                words[i] = f"o{rng.integers(10**9)}"
        if g % 20 == 0:
            other = changed(rng, one, 32)
            pairs.append((2 * g, 2 * g + 1))
        rows += [(2 * g, " ".join(one)), (2 * g + 1, " ".join(other))]
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert all(got[a] == got[b] == a for a, b in pairs)
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    others = [(i, c) for i, c in got.items() if i != c and (c, i) not in set(pairs)]
    assert all(any(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in sets.items() if j != i) for i, _ in others[:20])


@pytest.mark.parametrize("dense, bucket", [(8, 1 << 14), (0, 1 << 14), (8, 70)])
def test_buckets_as_a_stream_lose_no_pair(monkeypatch, dense, bucket):
    """Buckets cut by batches, crowded, dense or too large to hold: every pair of other roots, fitting sizes and close first bits is listed, or its bucket handed on whole."""
    import pyarrow as pa
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bucket + dense)
    rows, reach = [], int(np.ceil(simhash.SIZE_STEPS * np.log(1.25))) + 1
    for key, n in enumerate([1, 2, 3, 200, 64, 65, 90, 1, 2]):
        looks = rng.integers(-(1 << 63), (1 << 63) - 1, 3)
        for _ in range(n):
            i = len(rows)
            rows.append(((key << simhash.SIZE_BITS) + int(rng.integers(0, 2000)), i, int(rng.choice([0, i])), int(looks[rng.integers(3)]) ^ (1 << int(rng.integers(60)))))
    rows.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at:at + 50]], pa.int64()) for c in range(4)], ["k", "id", "root", "look"]) for at in range(0, len(rows), 50)]
    out = [r for b in simhash._buckets(0.8, 24)(batches) for r in b.to_pylist()]
    pairs = [(r["a"], r["b"]) for r in out if r["key"] is None]
    handed = {}
    for r in out:
        if r["key"] is not None:
            handed.setdefault(r["key"], []).append((r["a"], r["b"]))
    want = {tuple(sorted((x[1], y[1]))): x[0] >> simhash.SIZE_BITS for x, y in itertools.combinations(rows, 2)
            if x[0] >> simhash.SIZE_BITS == y[0] >> simhash.SIZE_BITS and abs(x[0] - y[0]) <= reach and x[2] != y[2] and bin((x[3] ^ y[3]) % (1 << 64)).count("1") <= 24}
    assert len(pairs) == len(set(pairs)) and set(pairs) == {p for p, key in want.items() if key not in handed}
    for key, members in handed.items():
        assert sorted(members) == sorted((r[1], r[2]) for r in rows if r[0] >> simhash.SIZE_BITS == key)


def test_blocks_grow_with_the_texts():
    """Blocks get a bit with each doubling beyond 2^22 texts, and as many more as keep the chance of a missed pair."""
    share = simhash.differing_share(0.8)
    for count, width in [(0, 22), (200, 22), ((1 << 22) - 1, 22), (1 << 22, 23), (1 << 30, 31)]:
        blocks = simhash.draw_blocks(count, share)
        assert blocks.shape[1] == width and all(len(set(b)) >= width - 1 for b in blocks.tolist())
        assert (1 - (1 - share) ** width) ** len(blocks) <= simhash.MISS
        assert len(blocks).bit_length() + width + simhash.SIZE_BITS < 64
    packed = np.random.default_rng(1).integers(0, 256, (3, simhash.WIDTH // 8), dtype=np.uint8)
    bits = np.unpackbits(packed, axis=1)
    got = simhash.block_keys([x.tobytes() for x in packed], blocks)
    assert got.tolist() == [[sum(int(row[b]) << i for i, b in enumerate(block)) for block in blocks.tolist()] for row in bits]


def test_rows_meet_a_group_without_pairs(spark, monkeypatch):
    """500 near copies, most of them linked through others: the groups of brute force, and far fewer pairs than the square of the family."""
    rng, made, close = np.random.default_rng(6), [], simhash._close
    monkeypatch.setattr(simhash, "_close", lambda pairs, *more: made.append(pairs.count()) or close(pairs, *more))
    base = [f"t{i}" for i in range(150)]
    texts = []
    for g in range(500):
        words = list(base)
        for i in rng.choice(150, int(rng.integers(1, 8)), replace=False):
            words[i] = f"o{rng.integers(10**9)}"
        texts.append(" ".join(words))
    sets, root = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts], list(range(500))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(500), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}
    assert got == {i: find(i) for i in range(500)}
    assert len(set(got.values())) > 5 and sum(made) < 25_000, made


@pytest.mark.parametrize("dense, bucket", [(8, 1 << 14), (0, 1 << 14), (8, 70)])
def test_buckets_with_groups_lose_no_pair(monkeypatch, dense, bucket):
    """Every close pair is listed, or one of its rows is given as one that meets the other's group, or both are handed on in their bucket."""
    import pyarrow as pa
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bucket + dense)
    rows, reach = [], int(np.ceil(simhash.SIZE_STEPS * np.log(1.25))) + 1
    for key, n in enumerate([1, 2, 3, 200, 64, 65, 90, 1, 2]):
        looks = rng.integers(-(1 << 63), (1 << 63) - 1, 2)
        for _ in range(n):
            i = len(rows)
            rows.append(((key << simhash.SIZE_BITS) + int(rng.integers(0, 2000)), i, int(rng.choice([0, 1, i, i])), int(looks[rng.integers(2)]) ^ (1 << int(rng.integers(60)))))
    rows.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at:at + 50]], pa.int64()) for c in range(4)], ["k", "id", "root", "look"]) for at in range(0, len(rows), 50)]
    out = [r for b in simhash._buckets(0.8, 24, 2)(batches) for r in b.to_pylist()]
    root_of = {r[1]: r[2] for r in rows}
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in out if r["key"] is None}
    assert all(r["root"] == root_of[r["b"]] for r in out if r["key"] is None)
    met = {(r["a"], r["root"]) for r in out if r["key"] == -1}
    handed = {(r["key"], r["a"]) for r in out if r["key"] is not None and r["key"] >= 0}
    assert met and pairs
    for x, y in itertools.combinations(rows, 2):
        key = x[0] >> simhash.SIZE_BITS
        if key == y[0] >> simhash.SIZE_BITS and abs(x[0] - y[0]) <= reach and x[2] != y[2] and bin((x[3] ^ y[3]) % (1 << 64)).count("1") <= 24:
            assert (x[1], y[1]) in pairs or (y[1], x[1]) in pairs or (x[1], y[2]) in met or (y[1], x[2]) in met or {(key, x[1]), (key, y[1])} <= handed
