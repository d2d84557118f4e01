"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Only the number of pieces of each length decides the packing, and there are no more lengths than tokens in a
sequence. So the choice is made on that bounded histogram: a bin is filled greedily with the longest piece that fits;
then its smallest piece is exchanged for two unpacked pieces that fill the wider gap more tightly. The same
bin is repeated as often as the counts allow, hence the plan stays small however many pieces there are.
Pieces get their places from their rank within their length, in parallel.

Defined results: a null or empty text is one piece of one token; repeated rows are packed each; a null id passes through;
an empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import library_encoder
from .common import map_arrow, store, text_or_empty

SIZE, END = 4096, 1
SALT = 128


class _Stock:
    """Unpacked pieces by length."""

    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.sorted = sorted(self.count)

    def take(self, n: int, k: int = 1):
        self.count[n] = self.count.get(n, 0) - k
        if not self.count[n]:
            del self.count[n]
            self.sorted.pop(bisect_right(self.sorted, n) - 1)

    def put(self, n: int, k: int = 1):
        if n not in self.count:
            self.sorted.insert(bisect_right(self.sorted, n), n)
        self.count[n] = self.count.get(n, 0) + k

    def fitting(self, room: int) -> int:
        """Longest length that fits, or 0."""
        i = bisect_right(self.sorted, room)
        return self.sorted[i - 1] if i else 0

    def two_fitting(self, room: int) -> tuple[int, int]:
        """The two pieces with the largest sum that fits (the longer first), or (0, 0)."""
        a = np.array(self.sorted[:bisect_right(self.sorted, room - 1)], dtype=np.int64)
        if not len(a):
            return 0, 0
        alone = np.array([self.count[x] == 1 for x in a.tolist()])
        i = np.searchsorted(a, np.minimum(a, room - a), "right") - 1
        i = np.where((i >= 0) & (a[i] == a) & alone, i - 1, i)
        total = np.where(i >= 0, a + a[i], 0)
        best = len(total) - 1 - int(total[::-1].argmax())
        return (int(a[best]), int(a[i[best]])) if total[best] else (0, 0)


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """``(repeats, {length: pieces in the bin})`` that packs all pieces."""
    stock, plan = _Stock(counts), []
    while stock.sorted:
        filled, most, room = Counter(), Counter(), size

        def add(n: int, k: int = 1):
            filled[n] += k
            most[n] = max(most[n], filled[n])
            stock.take(n, k)
        while room and (n := stock.fitting(room)):
            k = min(stock.count[n], room // n)
            add(n, k)
            room -= n * k
        while room and len(+filled):
            least = min(+filled)
            a, b = stock.two_fitting(room + least)
            if a + b <= least:
                break
            add(a)
            add(b)
            filled[least] -= 1
            stock.put(least)
            room += least - a - b
        filled = +filled
        # a further bin makes the same choices as long as every length it tried is there
        again = min((stock.count.get(n, 0) - (most[n] - filled[n])) // filled[n] if filled[n] else (stock.count.get(n, 0) >= most[n]) * (1 << 60) for n in most)
        again = max(0, again)
        for n, k in filled.items():
            if again:
                stock.take(n, k * again)
        plan.append((again + 1, dict(filled)))
    return plan


def _places(plan) -> dict[str, np.ndarray]:
    """Rank ranges per length: the pieces ranked [low, ...) of a length go ``each`` to a bin, from bin ``base`` on, at ``offset``."""
    used, rows, base = Counter(), [], 0
    for repeats, filled in plan:
        offset = 0
        for n, k in sorted(filled.items(), reverse=True):
            rows.append((n, used[n], k, base, offset))
            used[n] += k * repeats
            offset += n * k
        base += repeats
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return {"key": (cols[0] << 44) + cols[1], "low": cols[1], "each": cols[2], "base": cols[3], "offset": cols[4]}


def assign(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length`` (1 to ``size``), ``doc_id`` and ``piece``."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALT)).cast("int"))
    sizes = store(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")  # at most size x SALT rows
    plan = plan_bins({r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, size)
    where = _places(plan)
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = (salted.join(before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_salt"])
              .withColumn("_rank", F.row_number().over(order) - 1 + F.col("_before")))
    names = pieces.columns
    rows = ranked.select(*names, "_rank")

    def make():
        def step(batch):
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(where["key"], (length << 44) + rank, "right") - 1
            j = rank - where["low"][i]
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(where["base"][i] + j // where["each"][i]), pa.array(where["offset"][i] + j % where["each"][i] * length)],
                                             [*names, "sequence_id", "offset"])
        return step
    return map_arrow(rows, make, f"{', '.join(f'`{n}` {t}' for n, t in pieces.dtypes)}, sequence_id long, offset long")


def pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as id pieces: ``(doc_id, piece, start, length, ids_crc32[, ids])``; only documents longer than ``size`` are cut."""
    def make():
        encoder = library_encoder(path)

        def step(batch):
            ids, out = batch.column(0).to_pylist(), ([], [], [], [], [], [])
            for doc, text in zip(ids, batch.column(1).to_pylist()):
                raw = encoder.encode(text) + END.to_bytes(4, "little")
                for k in range(0, len(raw), 4 * size):
                    part = raw[k:k + 4 * size]
                    for col, x in zip(out, (doc, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        col.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array(c, k) for c, k in zip(out, kinds)]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])
        return step
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), make, kind)


def pack(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    return assign(store(pieces(docs, path, size), "pieces"), size)


def packed_sequences(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """The sequences themselves: ``(sequence_id, ids)``, at most ``size`` ids each."""
    placed = assign(store(pieces(docs, path, size, with_ids=True), "pieces"), size)
    return (placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.flatten("parts.ids").alias("ids")))
