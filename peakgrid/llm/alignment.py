"""Alignment of two tokenizers' tokens over the bytes of the same text.

Tokens of both sides end at byte offsets; offsets where both end cut a text into groups. They are found by divide and conquer: a common
end near the middle of an interval is located by bisection, both halves go on, and an interval without one is a group.
Side A is a byte-level BPE file of the ``tokenizers`` library, side B a ``sentencepiece`` model that puts a space in front; A gets the same space.

A text is first split before single spaces that a printable letter or sign follows: no token of either side crosses such a place (side A's
words begin there, and no piece of side B holds a space after another sign, which is verified when the model is loaded). So a unit between two places is
encoded and divided once for a task and remembered.

How many documents hold an id pair linked is counted in two steps: tasks deal their documents to chunks of about ``CHUNK`` links with a dictionary of
the distinct pairs and their documents; only dictionaries are shuffled by pair. The counts go back to the chunk that asked for them.

Defined results: null and empty texts, and texts whose tokens do not give back their bytes (as with U+2581, which side B takes for a
space), have no tokens, zeros and an empty digest; repeated rows and rows of one id are documents of their own; null ids pass through.
"""
from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_of_letter
from .common import map_arrow, store, text_or_empty

CHUNK = 2_000_000
REMEMBER, REMEMBER_CHARS = 250_000, 10_000_000
SPACE = "▁"
#: A single space before a sign that is surely neither a space nor part of one.
PLACES = re.compile(r"(?<=[^ ])(?= [!-~À-ɏ])")
ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary, pairs binary, holders binary"


def divide(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """Groups ``(a from, a to, b from, b to)`` of two rising lists of ends that close at the same last end."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a1 - a0 == b1 - b0 and a[a0:a1] == b[b0:b1]:  # every end is a cut
            out += zip(range(a0, a1), range(a0 + 1, a1 + 1), range(b0, b1), range(b0 + 1, b1 + 1))
            continue
        if a1 - a0 > 1 and b1 - b0 > 1:  # else no end lies inside
            last, middle = a1 - 1, (a0 + a1) // 2 - 1
            i, j = -1, 0
            for near in range(max(middle - a0 + 1, last - 1 - middle)):  # outwards from the middle
                i = middle - near
                if i >= a0 and b[j := bisect_left(b, a[i], b0, b1 - 1)] == a[i]:
                    break
                i = middle + near + 1
                if i < last and b[j := bisect_left(b, a[i], b0, b1 - 1)] == a[i]:
                    break
                i = -1
            if i >= 0:
                open_ += [(i + 1, a1, j + 1, b1), (a0, i + 1, b0, j + 1)]  # the left half is taken next
                continue
        out.append((a0, a1, b0, b1))
    return out


class Unit(NamedTuple):
    """The aligned tokens of a stretch of text; its linked pairs are packed as 64-bit numbers, A id in the high half."""

    ok: bool
    n_a: int
    n_b: int
    n_groups: int
    text: str
    pairs: bytes


class Aligner:
    """Both tokenizers with the bytes of their tokens, and the units seen before."""

    def __init__(self, path_a: str, path_b: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab(with_added_tokens=False)
        letter = byte_of_letter()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.known: dict[str, Unit] = {}
        self.before: dict[str, Unit] = {}
        self.chars = 0

    def unit(self, text: str, a: list[int], b: list[int]) -> Unit:
        raw = text.encode("utf-8", "surrogatepass")
        parts_a, parts_b = [*map(self.bytes_a.__getitem__, a)], [*map(self.bytes_b.__getitem__, b)]
        if not b"".join(parts_a) == raw == b"".join(parts_b):
            return Unit(False, len(a), len(b), 0, "", b"")
        groups, texts, pairs = divide([*accumulate(map(len, parts_a))], [*accumulate(map(len, parts_b))]), [], []
        for i, j, k, m in groups:
            if j - i == 1 == m - k:
                x, y = a[i], b[k]
                texts.append(f"{x}|{y}")
                pairs.append(x << 32 | y)
            else:
                left, right = a[i:j], b[k:m]
                texts.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
                pairs += [x << 32 | y for x in left for y in right]
        return Unit(True, len(a), len(b), len(groups), ";".join(texts), array("q", pairs).tobytes())

    def units(self, texts: list[str]) -> list[list[Unit]]:
        """The units of every text, with the space in front."""
        cut = [(PLACES.split(" " + t) if self.splits else [" " + t]) if t else [] for t in texts]
        if len(self.known) > REMEMBER or self.chars > REMEMBER_CHARS:  # what is not met again goes at the next turn
            self.known, self.before, self.chars = {}, self.known, 0
        known, before = self.known, self.before
        missing = {u for c in cut for u in c if u not in known}
        met = missing & before.keys()
        known.update((u, before[u]) for u in met)
        if new := [*(missing - met)]:
            for u, a, b in zip(new, self.a.encode_batch_fast(new, add_special_tokens=False), self.b.encode([u[1:] for u in new], num_threads=1)):
                known[u] = self.unit(u, a.ids, b)
        self.chars += sum(map(len, missing))
        return [[*map(known.__getitem__, c)] for c in cut]

    def documents(self, texts: list[str]) -> Iterator[list[Unit]]:
        """As :meth:`units`; a text that does not come back from its tokens has none."""
        for i in range(0, len(texts), 256):
            for found in self.units(texts[i:i + 256]):
                yield found if all(u.ok for u in found) else []


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, so its next task finds the words remembered."""
    return Aligner(path_a, path_b)


class _Chunk:
    """Documents and the distinct pairs they hold."""

    def __init__(self, number: int):
        self.number, self.rows, self.codes, self.times, self.n = number, [], [], [], 0

    def add(self, doc, found: list[Unit]):
        if found:
            _, n_a, n_b, n_groups, texts, pairs = zip(*found)
            codes, times = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
            self.rows.append((doc, sum(n_a), sum(n_b), sum(n_groups), int(times.sum()), hashlib.sha256(";".join(texts).encode()).hexdigest()))
        else:
            codes = times = np.empty(0, np.int64)
            self.rows.append((doc, 0, 0, 0, 0, ""))
        self.codes.append(codes)
        self.times.append(times.astype("<u4" if len(times) and times.max() > 65535 else "<u2").tobytes())
        self.n += len(codes)

    def batch(self) -> pa.RecordBatch:
        pairs, place, holders = np.unique(np.concatenate(self.codes), return_inverse=True, return_counts=True)
        links, at = [], 0
        for c in self.codes:
            links.append(np.diff(place[at:at + len(c)], prepend=0).astype("<u4").tobytes())
            at += len(c)
        rest = [None] * (len(self.rows) - 1)
        kinds = [k for _, k in _fields(ALIGNED)]
        cols = [[self.number] * len(self.rows), *zip(*self.rows), links, self.times, [pairs.astype("<i8").tobytes(), *rest], [holders.astype("<u4").tobytes(), *rest]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [n for n, _ in _fields(ALIGNED)])


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]


def align(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its numbers and, packed, its distinct linked pairs as places in the sorted dictionary that the first row of its chunk carries."""
    def run(batches):
        held, sides = _Chunk(TaskContext.get().partitionId() << 32), aligner(path_a, path_b)
        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), sides.documents(batch.column(1).to_pylist())):
                held.add(doc, found)
                if held.n >= chunk:
                    yield held.batch()
                    held = _Chunk(held.number + 1)
        if held.rows:
            yield held.batch()
    return store(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, ALIGNED), "aligned", "zstd")


def chunk_pairs(aligned: DataFrame) -> DataFrame:
    """``(chunk, pair, docs)``: the distinct pairs of each chunk (A id in the high half) and the documents of the chunk that hold them."""
    def make():
        def step(batch):
            for number, pairs, holders in zip(*(c.to_pylist() for c in batch.columns)):
                p, n = np.frombuffer(pairs, "<i8"), np.frombuffer(holders, "<u4").astype(np.int64)
                for i in range(0, len(p), 100_000):
                    part = p[i:i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), pa.array(part), pa.array(n[i:i + 100_000])], ["chunk", "pair", "docs"])
        return step
    return map_arrow(aligned.filter("pairs IS NOT NULL").select("chunk", "pairs", "holders"), make, "chunk long, pair long, docs long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(pair, docs, best)`` over the corpus; ``best`` where no pair of the same A id is held by more documents."""
    counts = store(pairs.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32)), "counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def score(aligned: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The numbers of every document, with ``n_best`` and ``count_sum`` over its links."""
    pairs = chunk_pairs(aligned)
    counts = pair_counts(pairs) if counts is None else counts
    known = pairs.select("chunk", "pair").join(counts, "pair")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def add(key, mine, answers):
        order = np.argsort(answers.column("pair").to_numpy())
        docs = answers.column("docs").to_numpy()[order]
        best = answers.column("best").to_numpy(zero_copy_only=False).astype(np.int64)[order]
        n_best, total = [], []
        for links, times in zip(mine.column("links").to_pylist(), mine.column("times").to_pylist()):
            place = np.cumsum(np.frombuffer(links, "<u4").astype(np.int64))
            n = np.frombuffer(times, "<u2" if len(times) * 2 == len(links) else "<u4").astype(np.int64)
            n_best.append(int(n @ best[place]) if len(n) else 0)
            total.append(int(n @ docs[place]) if len(n) else 0)
        out = mine.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return (out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))
                .append_column("groups_sha256", mine.column("groups_sha256")))
    return aligned.drop("pairs", "holders").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(add, schema)


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, groups)``: the groups of every document in order, each with the ids of both sides."""
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def make():
        both = aligner(path_a, path_b)

        def step(batch):
            rows = []
            for found in both.documents(batch.column(1).to_pylist()):
                sides = [g.split("|") for u in found for g in u.text.split(";")]
                rows.append([{"a": [int(x) for x in a.split(",")], "b": [int(x) for x in b.split(",")]} for a, b in sides])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "groups"])
        return step
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), make, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")
