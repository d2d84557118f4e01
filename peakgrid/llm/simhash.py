"""SimHash near-duplicates: blocks that close fingerprints must share, then a Hamming check.

``fingerprints``/``linked_pairs``/``near_groups`` work on the 64-bit fingerprint and
find *every* pair within three bits. ``near_duplicates`` searches candidates by the same
idea on a longer fingerprint, because texts whose shingle sets are only 0.8 alike differ
in far more than three of 64 bits; what it links is decided by the shingle sets themselves.

Defined results: a null text counts as empty; an empty text has fingerprint 0 and
links like any other; rows with a null id keep their fingerprint and get a null
component; repeated rows stay, and each row belongs to the component of its own
fingerprint; an empty table gives an empty result. Columns besides the named
ones are not read.
"""
from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_arrow, store, text_or_empty

RADIUS = 3
PARTS = 6
#: Buckets up to this size are checked pair by pair; larger ones are split on further bits.
PAIRWISE = 256
STEP = 1 << 16


def shingle_hashes(text: str, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``size``-word shingle (the whole word sequence if shorter), repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), runs), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if more than half of the hashes have it; signed, as Spark stores it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        part = hashes[i:i + STEP].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, fp)`` for every row of ``docs``."""
    def make():
        def step(batch):
            fps = [fingerprint(shingle_hashes(t or "", size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])
        return step
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")), make, "id long, fp long")


def finer_masks(mask: int) -> list[int]:
    """Masks that fix more bits: of two values equal under ``mask`` and within the radius,
    at least one finer mask also sees them equal. Empty when at most RADIUS bits are free."""
    free = [i for i in range(64) if not mask >> i & 1]
    if len(free) <= RADIUS:
        return []
    parts = [p.tolist() for p in np.array_split(free, min(PARTS, len(free)))]
    return [mask | sum(1 << b for part in chosen for b in part) for chosen in combinations(parts, len(parts) - RADIUS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.mask", "k.key")


def linked_pairs(fps: DataFrame) -> DataFrame:
    """All pairs ``(a, b)`` of distinct values ``fp`` that differ in 1 to 3 bits, up to pairs
    implied by others: in a bucket whose members can only differ in three bits, each is linked to the smallest.

    The 64 bits fall into six parts; a close pair agrees in three of them, so it
    shares one of 20 keys of about 32 bits. Buckets of two need no join. A bucket
    too large for a pairwise check is split again by the same rule on its free
    bits, so no bucket is ever emitted as all its pairs.
    """
    near = "bit_count(a ^ b) <= %d" % RADIUS
    found, keys = [], _keys(fps, finer_masks(0))
    while True:
        size = store(keys.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets")
        found.append(size.filter("n = 2").select("a", "b").filter(near))
        middle = keys.join(size.filter(f"n > 2 AND n <= {PAIRWISE}").select("mask", "key"), ["mask", "key"])
        left, right = middle.withColumnRenamed("fp", "a").alias("l"), middle.withColumnRenamed("fp", "b").alias("r")
        found.append(left.join(right, F.expr("l.mask = r.mask AND l.key = r.key AND a < b AND " + near)).select("a", "b"))
        large = size.filter(f"n > {PAIRWISE}")
        masks = [r.mask for r in large.select("mask").distinct().collect()]  # at most as many as masks in use
        if not masks:
            break
        split = [(m, [_signed(x) for x in finer_masks(m % (1 << 64))]) for m in masks]
        members = keys.join(large.select("mask", "key", "a"), ["mask", "key"])
        whole = [m for m, finer in split if not finer]
        if whole:
            found.append(members.filter(F.col("mask").isin(whole) & (F.col("fp") != F.col("a"))).select("a", F.col("fp").alias("b")))
        split = [(m, finer) for m, finer in split if finer]
        if not split:
            break
        finer = fps.sparkSession.createDataFrame(split, "mask long, finer array<long>")
        keys = store(members.join(finer, "mask").select("fp", F.explode("finer").alias("mask"))
                     .select("fp", "mask", F.expr("fp & mask").alias("key")).distinct(), "keys")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)``: rows linked through fingerprints at three or fewer differing bits."""
    rows = store(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = store(rows.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    links = linked_pairs(classes.select("fp"))
    reps = classes.filter("rep IS NOT NULL")
    edges = (links.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a")
             .join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
             .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    roots = components(edges).withColumnRenamed("node", "rep")
    named = classes.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component"))
    return rows.join(named, "fp").select("id", "fp", F.expr("CASE WHEN id IS NOT NULL THEN component END").alias("component"))


# A longer fingerprint for similarity 0.8 -----------------------------------------------------------------------

WIDTH = 4096
#: Least bits of a block; from 2^22 texts on a block has log2 of their number, so that chance pairs grow with the texts and not with their square.
BITS = 22
#: Probability, by the model, that a pair at the least similarity shares no block. The number of blocks follows from it.
MISS = 0.001
PIECES = np.arange(4, dtype=np.uint64) * np.uint64(16)
#: Standard deviation of the distance of a pair, in bits (measured 19 to 24 for sets of 5 to 3,000 shingles), and how many of them the prefilters allow.
SPREAD, MARGIN = 25, 5
#: Steps to a natural logarithm in the size of a shingle set, and the bits that hold it.
SIZE_STEPS, SIZE_BITS = 2048, 16
#: Buckets up to SMALL are compared at once, up to BUCKET row by row against the bucket; larger ones are compared in cells of about TILE rows a side.
SMALL, BUCKET, TILE = 64, 1 << 14, 512
#: Pairs a row from which a bucket is decided in cells by all bits instead of pair by pair.
DENSE = 8
#: Rounds of the first look for groups, and blocks of a round.
ROUNDS, FIRST = 5, 4
#: Close rows of one group that a row may meet as pairs, in a bucket and in all; if there are more, the row is held against the whole group.
FEW, IN_ALL = 2, 8
#: Bytes of shingle sets on a side of a cell where rows meet a group.
SIDE = 1 << 23


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (width a power of two)."""
    n, width = rows.shape
    h = 1
    while h < width:
        v = rows.reshape(n, width // (2 * h), 2, h)
        rows = np.stack((v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return rows


def long_bits(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """WIDTH sign bits of random projections of the set of word shingles, and the size of that set."""
    order = np.random.default_rng(7).permutation(WIDTH)
    bits, sizes = np.empty((len(texts), WIDTH), bool), np.zeros(len(texts), np.int64)
    for i in range(0, len(texts), 64):
        sums = np.zeros((len(texts[i:i + 64]), WIDTH), np.float32)
        for j, text in enumerate(texts[i:i + 64]):
            h = np.unique(shingle_hashes(text, size))
            sizes[i + j] = len(h)
            part = (h[None, :] >> PIECES[:, None]).ravel()  # four places for each shingle, so that two rarely share all
            sums[j] = np.bincount((part & np.uint64(WIDTH - 1)).astype(np.int64), 1.0 - 2.0 * ((part >> np.uint64(12)) & np.uint64(1)), WIDTH)
        bits[i:i + 64] = hadamard(sums)[:, order] > 0
    return bits, sizes


def draw_blocks(count: int, share: float) -> np.ndarray:
    """Places of the bits of each block, for ``count`` texts; bits are dealt from shuffles of all, so none is used more than once oftener than another."""
    width = max(BITS, int(count).bit_length())
    tables = int(np.ceil(np.log(MISS) / np.log1p(-(1 - share) ** width)))
    deals = -(-tables * width // WIDTH)
    return np.concatenate([np.random.default_rng(7 + i).permutation(WIDTH) for i in range(deals)])[:tables * width].reshape(tables, width)


def block_keys(packed: list[bytes], blocks: np.ndarray) -> np.ndarray:
    """The number that each block of the packed bits spells; sums are exact in double precision."""
    bits = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)
    kind = np.float32 if blocks.shape[1] <= 24 else np.float64
    return (bits[:, blocks].astype(kind) @ (1 << np.arange(blocks.shape[1])).astype(kind)).astype(np.int64)


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two sets at this Jaccard; equal sizes, where it is largest."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _signatures(texts: DataFrame, size: int) -> DataFrame:
    """``(id, bits, look, code)``: all bits, the first 64 of them, and the logarithm of the size of the shingle set (0 for none)."""
    def make():
        def step(batch):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bits, sizes = long_bits(part.column(1).to_pylist(), size)
                packed = np.packbits(bits, axis=1)
                codes = np.where(sizes > 0, 1 + SIZE_STEPS * np.log(np.maximum(sizes, 1)), 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(packed[:, :8].copy().view("<i8")[:, 0].copy()), pa.array(codes)],
                    ["id", "bits", "look", "code"])
        return step
    return map_arrow(texts, make, "id long, bits binary, look long, code long")


def _seeds(sig: DataFrame, blocks: np.ndarray, limit: int) -> DataFrame:
    """Links of rows to the smallest row of a bucket: groups known early spare comparisons, no more.

    Each round looks at a few blocks; rows that an earlier round has linked well within ``similarity`` only serve as smallest rows,
    the others try again, as a pair that is merely close may fail on its shingle sets. So a row has at most one link for each block looked at, however large its group.
    """
    sure = limit - 2 * MARGIN * SPREAD
    def keys(some):
        def make():
            def step(batch):
                if batch.num_rows:
                    found = block_keys(batch.column(1).to_pylist(), some) + (np.arange(len(some)) << some.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), len(some)))], ["key", "id"])
            return step
        return make
    links = None
    for r in range(ROUNDS):
        rows = store(map_arrow(sig.select("id", "bits"), keys(blocks[FIRST * r:FIRST * (r + 1)]), "key long, id long"), "seeds")
        hubs = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a")).filter("n > 1")
        left = rows if links is None else rows.join(links.filter(F.col("far") <= sure).select(F.col("b").alias("id")), "id", "left_anti")
        pairs = left.join(hubs, "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
        found = store(_close(pairs, sig, limit), "links")
        links = found if links is None else links.unionByName(found)
    return links.select("a", "b").distinct()


def _exploded(sig: DataFrame, roots: DataFrame, blocks: np.ndarray) -> DataFrame:
    """``(k, id, root, look)`` for every row and block; ``k`` is block, its bits and the size of the shingle set, from the top."""
    rows = sig.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "look", "code", "bits")

    def make():
        tables, width = blocks.shape

        def step(batch):
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = block_keys(part.column(4).to_pylist(), blocks) + (np.arange(tables) << width)
                k = (found << SIZE_BITS) + part.column(3).to_numpy()[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), *(pa.array(np.repeat(part.column(c).to_numpy(), tables)) for c in range(3))], ["k", "id", "root", "look"])
        return step
    return map_arrow(rows, make, "k long, id long, root long, look long")


def _near_in_small(k, root, look, reach, most):
    """Places of pairs of one bucket, of different roots, sizes within reach and close first bits; rows are ordered by bucket and size."""
    left, out, d = np.arange(len(k)), [], 0
    key = k >> SIZE_BITS
    while len(left):
        d += 1
        left = left[left + d < len(k)]
        other = left + d
        # ordered by size: a row whose partner at distance d is too far has none beyond
        left = left[(key[left] == key[other]) & (k[other] - k[left] <= reach)]
        other = left + d
        near = (root[left] != root[other]) & (np.bitwise_count(look[left] ^ look[other]) <= most)
        out.append(np.stack((left[near], other[near])))
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)


def _near_in_large(k, root, look, reach, most):
    """As above for one crowded bucket: rows outside its largest group are compared with all; None if a bucket is too dense to list."""
    names, place, sizes = np.unique(root, return_inverse=True, return_counts=True)
    out, total = [np.empty((2, 0), np.int64)], 0
    main = place == np.argmax(sizes)
    for x in np.flatnonzero(~main):
        near = (np.abs(k - k[x]) <= reach) & (root != root[x]) & (np.bitwise_count(look ^ look[x]) <= most)
        near[:x] &= main[:x]  # of two rows outside, the earlier one finds the pair
        near = np.flatnonzero(near)
        total += len(near)
        if total > DENSE * len(k):
            return None
        out.append(np.stack((np.full(len(near), x), near)))
    return np.concatenate(out, axis=1)


def _met_groups(a, b, root_a, root_b, few):
    """Turns close pairs of a bucket round, so that the group of ``b`` is that with more rows; ``(a, b, root of b)`` of pairs that stay, and ``(a, root)`` of rows that meet more than ``few`` rows of one group."""
    names, place = np.unique(np.concatenate((root_a, root_b)), return_inverse=True)
    ids, owner = np.unique(np.concatenate((a, b)), return_index=True)
    sizes = np.bincount(place[owner], minlength=len(names))
    of_a, of_b = place[:len(a)], place[len(a):]
    to_b = (sizes[of_b] > sizes[of_a]) | ((sizes[of_b] == sizes[of_a]) & (of_b < of_a))  # of equal groups the first is met
    row, other, group = np.where(to_b, a, b), np.where(to_b, b, a), np.where(to_b, of_b, of_a)
    _, which, times = np.unique(np.searchsorted(ids, row) * len(names) + group, return_inverse=True, return_counts=True)
    many = times[which] > few
    met = np.unique(np.stack((row[many], names[group[many]])), axis=1)
    return (row[~many], other[~many], names[group[~many]]), (met[0], met[1])


def _main_apart(k, ids, root, look, reach, most, few):
    """A crowded bucket with a group of more than ``few`` rows: as ``_met_groups`` for all other rows against its largest group, and the places of these others."""
    names, place, sizes = np.unique(root, return_inverse=True, return_counts=True)
    main = place == np.argmax(sizes)
    at, pairs, met = np.flatnonzero(main), [], []
    if len(at) <= few:
        return None
    for x in np.flatnonzero(~main):
        near = at[(np.abs(k[at] - k[x]) <= reach) & (np.bitwise_count(look[at] ^ look[x]) <= most)]
        if len(near) > few:
            met.append(ids[x])
        else:
            pairs += [(ids[x], ids[y]) for y in near]
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    name = names[np.argmax(sizes)]
    return (a, b, np.full(len(a), name)), (np.array(met, np.int64), np.full(len(met), name)), np.flatnonzero(~main)


def _buckets(similarity: float, most: int, few: int | None = None):
    """Reads rows ordered by ``k``; gives pairs ``(key null, a, b)``, and of crowded buckets the rows as ``(key, id, root)``.

    With ``few``, ``root`` is the group of ``b``, and a row with more close rows of one group in a bucket is given as ``(key -1, id, null, root)`` instead of those pairs.
    """
    reach, bucket, small = int(np.ceil(SIZE_STEPS * np.log(1 / similarity))) + 1, BUCKET, SMALL

    def pairs(key, a, b, root_a, root_b):
        if few is None:
            yield None, np.minimum(a, b), np.maximum(a, b), None
        elif len(a):
            order = np.argsort(key, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                (a_, b_, root), met = _met_groups(a[at], b[at], root_a[at], root_b[at], few)
                yield None, a_, b_, root
                yield -1, met[0], None, met[1]

    def whole(rows):
        k, ids, root, look = rows = [*rows[:3], rows[3].view(np.uint64)]  # unsigned: numpy counts the bits of absolute values
        edges = np.flatnonzero(np.diff(k >> SIZE_BITS, prepend=-1, append=-1))
        sizes = np.diff(edges)
        few_rows = np.repeat(sizes <= small, sizes)
        part = [c[few_rows] for c in rows]
        x, y = _near_in_small(part[0], part[2], part[3], reach, most)
        yield from pairs(part[0][x] >> SIZE_BITS, part[1][x], part[1][y], part[2][x], part[2][y])
        for i in np.flatnonzero(sizes > small):
            at = np.arange(edges[i], edges[i + 1])
            if few is not None and (apart := _main_apart(k[at], ids[at], root[at], look[at], reach, most, few)) is not None:
                yield None, *apart[0]
                yield -1, apart[1][0], None, apart[1][1]
                at = at[apart[2]]
            if not len(at):
                continue
            found = _near_in_large(k[at], root[at], look[at], reach, most)
            if found is None:
                yield int(k[edges[i]] >> SIZE_BITS), ids[at], root[at], None
            else:
                x, y = found
                yield from pairs(np.zeros(len(x), np.int64), ids[at][x], ids[at][y], root[at][x], root[at][y])

    def batch_of(found):
        columns = [np.concatenate([np.full(len(f[1]), -2 if f[0] is None else f[0]) for f in found])]
        columns += [pa.concat_arrays([pa.nulls(len(f[1]), pa.int64()) if f[c] is None else pa.array(f[c], pa.int64()) for f in found]) for c in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64(), mask=columns[0] == -2), *columns[1:]], ["key", "a", "b", "root"])

    def batches_of(found):
        """Many small results in one batch."""
        held, rows = [], 0
        for f in found:
            held.append(f)
            rows += len(f[1])
            if rows > STEP:
                yield batch_of(held)
                held, rows = [], 0
        if held:
            yield batch_of(held)

    def run(batches):
        held, crowded = [np.empty(0, np.int64)] * 4, None
        for batch in batches:
            rows = [np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("k", "id", "root", "look"))]
            key = rows[0] >> SIZE_BITS
            if crowded is not None:  # the rest of a bucket that was too large to hold
                end = int(np.searchsorted(key, crowded, "right"))
                yield batch_of([(crowded, rows[1][:end], rows[2][:end], None)])
                rows, key = [c[end:] for c in rows], key[end:]
            if not len(key):
                held = rows
                continue
            crowded = None
            cut = int(np.searchsorted(key, key[-1], "left"))
            yield from batches_of(whole([c[:cut] for c in rows]))
            held = [c[cut:] for c in rows]
            if len(held[0]) > bucket:
                crowded = int(key[-1])
                yield batch_of([(crowded, held[1], held[2], None)])
                held = [c[:0] for c in held]
        yield from batches_of(whole(held))
    return run


def _compare(limit: int):
    """All pairs of a cell's two sides that are not connected and differ in at most ``limit`` bits."""
    def pairs(key, table):
        i, j = (k.as_py() for k in key[-2:])
        ids, roots, side = (table.column(c).to_numpy() for c in ("id", "root", "side"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(len(ids), -1)
        right = np.flatnonzero(side == j)
        a, b = [], []
        for x in np.flatnonzero(side == i):
            other = right[roots[right] != roots[x]]
            if i == j:
                other = other[ids[other] > ids[x]]
            near = other[np.bitwise_count(bits[other] ^ bits[x]).sum(axis=1, dtype=np.int64) <= limit]
            a.append(np.minimum(ids[near], ids[x]))
            b.append(np.maximum(ids[near], ids[x]))
        return pa.table({"a": np.concatenate(a) if a else np.empty(0, np.int64), "b": np.concatenate(b) if b else np.empty(0, np.int64)})
    return pairs


def _candidates(sig: DataFrame, roots: DataFrame, blocks: np.ndarray, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Every pair that shares a block, is not connected by ``roots(node, root)``, has sizes that allow ``similarity`` and is close by Hamming distance.

    A row that meets more than FEW close rows of one group in a bucket, or more than IN_ALL in all, is not paired with them but listed
    as ``(id, root)`` in the second table, to be held against that whole group.

    One shuffle by block brings a bucket together, ordered by size; tasks read it as a stream and hold at most BUCKET rows of one. In larger
    and dense buckets the rest is held against the largest connected group likewise; the rest falls into parts of about TILE rows, and each
    part meets every part, so no pair is left out and no task takes a whole bucket.
    """
    share = differing_share(similarity)
    most = int(share * 64 + MARGIN * (share * (1 - share) * 64) ** 0.5)
    limit = int(share * WIDTH + MARGIN * SPREAD)
    dealt = _exploded(sig, roots, blocks).repartition(F.expr(f"shiftright(k, {SIZE_BITS})")).sortWithinPartitions("k")
    found = store(dealt.mapInArrow(_buckets(similarity, most, FEW), "key long, a long, b long, root long"), "found")
    # at most FEW rows of a group from each block come together here
    listed = store(found.filter("key IS NULL OR key = -1").groupBy("a", "root").agg(F.collect_set("b").alias("bs"), F.count("key").alias("whole"))
                   .withColumn("whole", F.expr(f"whole > 0 OR size(bs) > {IN_ALL}")), "listed")
    pairs = listed.filter("NOT whole").select("a", F.explode("bs").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    many = found.filter("key >= 0").select("key", F.col("a").alias("id"), F.col("b").alias("root"))
    groups = many.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.sum("n").alias("n"), F.max("n").alias("m"), F.max_by("root", F.struct("n", "root")).alias("main")).filter("n > m")
    apart = F.col("m") > FEW
    groups = groups.select("key", F.when(apart, F.col("main")).alias("main"), F.ceil((F.col("n") - F.when(apart, F.col("m")).otherwise(0)) / TILE).cast("int").alias("kr"))
    sided = many.join(groups, "key").filter("NOT root <=> main").withColumn("side", F.expr("cast(pmod(xxhash64(id), kr) AS int)"))
    met = listed.filter("whole").select(F.col("a").alias("id"), "root").union(sided.filter("main IS NOT NULL").select("id", F.col("main").alias("root"))).distinct()
    cells = (sided.select("key", "id", "root", "side", F.explode(F.expr("sequence(0, kr - 1)")).alias("other"))
             .select("key", "id", "root", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
             .join(sig.select("id", "bits"), "id"))
    crowded = cells.groupBy("key", "i", "j").applyInArrow(_compare(limit), "a long, b long").distinct()
    return _close(pairs, sig, limit).select("a", "b").unionByName(crowded).distinct(), met


def _close(pairs: DataFrame, sig: DataFrame, limit: int) -> DataFrame:
    """Pairs that differ in at most ``limit`` bits, as ``(a, b, far)`` with the number of them."""
    both = (pairs.join(sig.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a")
            .join(sig.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b").select("a", "b", "x", "y"))

    def make():
        def step(batch):
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                far = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], ["a", "b", "far"]).filter(pa.array(far <= limit))
        return step
    return map_arrow(both, make, "a long, b long, far long")


def _sets(ids: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``(id, s)``: the shingle sets of the texts with these ids, as sorted hashes."""
    def make():
        def step(batch):
            found = [np.unique(shingle_hashes(t, size)).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "s"])
        return step
    return store(map_arrow(texts.join(ids, "id", "left_semi").select("id", "text"), make, "id long, s binary"), "sets")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose shingle sets have a Jaccard of ``similarity`` or more, counted on the sets; two empty sets are equal."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")

    def make():
        def step(batch):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                # 1e-9 for the rounding of ``similarity`` itself
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        return step
    return map_arrow(both, make, "a long, b long")


def _find_alike(similarity: float, limit: int):
    """For each row of a cell that meets a group, the first row of the group's part that is alike, if any: close by all bits, then by the shingle sets."""
    def links(table):
        ids, member = (table.column(c).to_numpy() for c in ("id", "member"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(len(ids), -1)
        sets = [np.frombuffer(x, "<u8") for x in table.column("s").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        ends = np.cumsum(sizes)
        names, codes = np.unique(np.concatenate(sets), return_inverse=True)
        codes = np.split(codes, ends[:-1])
        group, marked, a, b = np.flatnonzero(member), np.zeros(len(names), np.int64), [], []
        for x in np.flatnonzero(~member):
            near = group[np.bitwise_count(bits[group] ^ bits[x]).sum(axis=1, dtype=np.int64) <= limit]
            near = near[np.minimum(sizes[near], sizes[x]) >= similarity * np.maximum(sizes[near], sizes[x]) - 1e-9]
            if not len(near):
                continue
            marked[codes[x]] = 1
            common = np.array([marked[codes[y]].sum() for y in near])
            marked[codes[x]] = 0
            alike = near[common >= similarity * (sizes[near] + sizes[x] - common) - 1e-9]
            if len(alike):
                a.append(min(ids[x], ids[alike[0]]))
                b.append(max(ids[x], ids[alike[0]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return links


def _into_groups(met: DataFrame, members: DataFrame, sig: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of rows ``met(id, root)`` into the groups they meet, ``members(id, root)``: one for each part of a group that has an alike row.

    Both sides are dealt into parts by rows and by bytes; each part of the rows meets each part of the group in a cell of its own.
    """
    limit = int(differing_share(similarity) * WIDTH + MARGIN * SPREAD)
    sides = met.withColumn("member", F.lit(False)).unionByName(members.withColumn("member", F.lit(True))).join(sets.select("id", F.octet_length("s").alias("n")), "id")
    parts = "cast(greatest(ceil(count(1) / {0}), ceil(sum(n) / {1})) AS int)".format(TILE, SIDE)
    parts = sides.groupBy("root", "member").agg(F.expr(parts).alias("parts"))
    parts = parts.groupBy("root").agg(F.max(F.when(F.col("member"), F.col("parts"))).alias("km"), F.max(F.when(~F.col("member"), F.col("parts"))).alias("kr")).filter("km IS NOT NULL AND kr IS NOT NULL")
    cells = sides.join(parts, "root").withColumn("own", F.expr("cast(pmod(xxhash64(id, 3), if(member, km, kr)) AS int)"))
    cells = cells.withColumn("other", F.explode(F.expr("sequence(0, if(member, kr, km) - 1)")))
    cells = cells.select("root", "id", "member", F.expr("if(member, own, other)").alias("i"), F.expr("if(member, other, own)").alias("j"))
    cells = cells.join(sig.select("id", "bits"), "id").join(sets, "id")
    return cells.groupBy("root", "i", "j").applyInArrow(_find_alike(similarity, limit), "a long, b long").distinct()


def near_rows(rows: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(row, id, same, root)`` of stored ``rows(row, id, text)``, ``row`` being unique: rows of one root are alike, directly or through others."""
    same = store(rows.select("row", "id", F.sha2("text", 256).alias("same")), "texts")
    classes = store(same.groupBy("same").agg(F.min("row").alias("node")), "classes")
    texts = rows.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi").select(F.col("node").alias("id"), "text")
    sig = store(_signatures(texts, size), "signatures")
    share = differing_share(similarity)
    blocks = draw_blocks(sig.count(), share)
    ends = F.explode(F.array("a", "b")).alias("id")
    seeds = store(_seeds(sig, blocks, int(share * WIDTH + MARGIN * SPREAD)), "pairs")
    first = _alike(seeds, _sets(seeds.select(ends).distinct(), texts, size), similarity)
    first = store(components(first), "roots")
    pairs, met = (store(x, "pairs") for x in _candidates(sig, first, blocks, similarity))
    members = first.select(F.col("node").alias("id"), "root").join(met.select("root").distinct(), "root", "left_semi").select("id", "root")
    sets = _sets(pairs.select(ends).union(met.select("id")).union(members.select("id")).distinct(), texts, size)
    rest = _alike(pairs, sets, similarity).union(_into_groups(met, members, sig, sets, similarity))
    roots = components(rest.union(first.select("node", "root")))
    named = classes.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    return same.join(named, "same").select("row", "id", "same", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(id, component)`` of texts whose ``size``-word shingle sets are alike by ``similarity`` (Jaccard) or more.

    Equal texts are one class from the start. Each class gets 4,096 sign bits and blocks of 22 of them (254 at 0.8; beyond 2^22 texts blocks
    are longer and more). Pairs that share a block are candidates, however crowded it is, where the sizes of their shingle sets allow
    ``similarity``; those within five standard deviations of the Hamming distance expected at ``similarity`` are decided by the
    Jaccard of their shingle sets. So no pair below ``similarity`` is linked, and a pair at or above it
    is missed only if it shares no block: by the model with probability 0.001 at 0.8, less above (sets of equal size; others are closer).
    Rows are linked to the smallest row of a bucket in rounds before, and pairs of one group are not compared again.
    Rows with a null id are left out; repeated ids take the smallest id of the component of each of their texts.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = near_rows(store(rows.filter("id IS NOT NULL"), "rows"), size, similarity)
    lowest = found.groupBy("root").agg(F.min("id").alias("component"))
    return found.join(lowest, "root").select("id", "component")
