"""Log-bilinear language model trained with noise-contrastive estimation, in numpy on every task.

Frequent words are single symbols; all others share one symbol and are told apart by their own counts, so
every text has a normalised probability. Symbols are dealt into classes by frequency. The vectors of the two
words before predict a vector; its products with the class vectors and then with the word vectors of the class
(plus biases) are normalised over all classes and all words of the class. Training contrasts each class
and word with noise drawn from their unigram shares. Every task learns from all its texts of a round, starting from the common
parameters; the results are averaged by tokens, in two steps so that no group holds all tasks.

Whole texts; A-Z lowered; words between blanks, then one end. Counts cover all training texts: words met by a task are counted in it, then summed
by word. Words outside the dictionary of frequent words are joined to their counts by word.

Defined results: a null text is an empty one (its end only); a null id counts as the empty text in the hash; rows are scored one by one, repeated
rows included; without training text the base is uniform over one unseen word and the model equals the base.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, store, text_or_empty

DICTIONARY, SYMBOLS, CLASSES, WIDTH = 50_000, 4096, 64, 16
ROUNDS, NOISE, BATCH, RATE = 2, 24, 4096, 0.15
END, RARE, START = 0, 1, 2
FLUSH = 300_000
PART = 128


def words_of(text: str | bytes) -> list[bytes]:
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()


def is_held_out(doc) -> bool:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))


def texts_of(batches) -> Iterator[tuple[int | None, bytes]]:
    """``(id, text)`` of every row; only ``PART`` rows at a time become Python objects, however many a batch has. Texts stay UTF-8."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            yield from zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist())


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, n)`` over the training texts, without ends."""
    def count(batches):
        seen = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return made
        for doc, text in texts_of(batches):
            if not is_held_out(doc):
                seen.update(words_of(text))
                if len(seen) > FLUSH:
                    yield out()
        if seen:
            yield out()
    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Layout:
    """Dictionary and classes; symbols are places in (class, member) order."""
    known: dict[bytes, int]     # dictionary word -> its count
    place: dict[bytes, int]     # word with a symbol of its own -> symbol
    share: np.ndarray           # symbol -> share of training tokens
    size: int                   # symbols in use, a multiple of CLASSES
    tokens: int
    types: int
    ends: int


def layout(counts: DataFrame, rows: DataFrame) -> Layout:
    """From the counts: totals and the bounded dictionary of the most frequent words (ties in byte order)."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    count_ends = F.expr("CAST(count_if(crc32(cast(coalesce(cast(id AS string), '') AS binary)) % 7 <> 2) AS long)")
    ends = rows.agg(count_ends.alias("n")).first().n
    top = counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()
    known = {bytes(r.word): r.n for r in top}
    single = list(known)[:SYMBOLS - 3]
    tokens = (total.n or 0) + ends
    n = [ends, tokens - ends - sum(known[w] for w in single), 0] + [known[w] for w in single]
    per = -(-len(n) // CLASSES)
    place = {w: 3 + i for i, w in enumerate(single)}
    share = np.zeros(per * CLASSES)
    share[:len(n)] = (np.array(n, float) + 0.5) / (tokens + 0.5 * len(n))
    share[START] = 0
    return Layout(known, place, share, per * CLASSES, tokens, total.v + (ends > 0), ends)


class Parameters:
    """Context vectors of two positions, class and word vectors and biases; symbol s is member s // CLASSES of class s % CLASSES."""
    NAMES = ("near", "far", "cls", "cls_bias", "word", "word_bias")

    def __init__(self, lay: Layout):
        rng = np.random.default_rng(11)
        shape = (lay.size, WIDTH)
        self.near, self.far, self.word = (rng.normal(0, 0.05, shape).astype(np.float32) for _ in range(3))
        self.cls = rng.normal(0, 0.05, (CLASSES, WIDTH)).astype(np.float32)
        shares = lay.share.reshape(-1, CLASSES)
        with np.errstate(divide="ignore"):
            self.cls_bias = np.log(np.maximum(shares.sum(0), 1e-12)).astype(np.float32)
            self.word_bias = np.where(lay.share > 0, np.log(np.maximum(lay.share / np.tile(np.maximum(shares.sum(0), 1e-12), len(shares)), 1e-12)), -30).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray):
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at:at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def log_probabilities(self, near: np.ndarray, far: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural log probability of each target symbol."""
        q = self.near[near] + self.far[far]
        cls, member = target % CLASSES, target // CLASSES
        s = q @ self.cls.T + self.cls_bias
        top = s.max(axis=1)
        s -= top[:, None]
        out = s[np.arange(len(target)), cls] - np.log(np.exp(s).sum(axis=1))
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        ends = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        word, bias = self.word.reshape(-1, CLASSES, WIDTH), self.word_bias.reshape(-1, CLASSES)
        for c in range(CLASSES):
            at = order[ends[c]:ends[c + 1]]
            if len(at):
                s = q[at] @ word[:, c].T + bias[:, c]
                top = s.max(axis=1)
                s -= top[:, None]
                out[at] += s[np.arange(len(at)), member[at]] - np.log(np.exp(s).sum(axis=1))
        return out


def _scatter(size: int, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` by ``index``, counted cell by cell."""
    width = rows.shape[1]
    cells = (index * width)[:, None] + np.arange(width)
    return np.bincount(cells.ravel(), rows.ravel(), size * width).astype(np.float32).reshape(size, width)


class Trainer:
    """One task's steps of noise-contrastive estimation; noise is shared by a batch."""

    def __init__(self, lay: Layout, par: Parameters, seed: int):
        self.par, self.rng = par, np.random.default_rng(seed)
        shares = lay.share.reshape(-1, CLASSES)
        self.cls_share = np.maximum(shares.sum(0), 1e-12)
        self.cls_share /= self.cls_share.sum()
        self.used = lay.share > 0
        self.past = {n: np.full(getattr(par, n).shape, 1e-3, np.float32) for n in par.NAMES}

    def _move(self, name: str, g: np.ndarray):
        self.past[name] += g * g
        value = getattr(self.par, name)
        value -= RATE * g / np.sqrt(self.past[name])

    def _contrast(self, q, names, true, noise, share, size):
        """Gradients of q for telling ``true`` from ``noise`` symbols; moves the target vectors."""
        vec, bias = (getattr(self.par, n) for n in names)
        k, n = len(noise), len(true)
        up = np.einsum("ij,ij->i", q, vec[true]) + bias[true] - np.log(k * share[true])
        down = q @ vec[noise].T + bias[noise] - np.log(k * share[noise])
        e_up = (-1 / (1 + np.exp(np.clip(up, -30, 30)))).astype(np.float32) / n
        e_down = (1 / (1 + np.exp(-np.clip(down, -30, 30)))).astype(np.float32) / n
        grad_q = e_up[:, None] * vec[true] + e_down @ vec[noise]
        g, b = _scatter(size, true, e_up[:, None] * q), np.bincount(true, e_up, size)
        np.add.at(g, noise, e_down.T @ q)
        np.add.at(b, noise, e_down.sum(axis=0))
        return grad_q, g, b.astype(np.float32)

    def step(self, near, far, target):
        par = self.par
        q = par.near[near] + par.far[far]
        size, cls = len(par.word), target % CLASSES
        noise_c = self.rng.choice(CLASSES, NOISE, p=self.cls_share)
        g1, gc, bc = self._contrast(q, ("cls", "cls_bias"), cls, noise_c, self.cls_share, CLASSES)
        # noise words are drawn evenly from the target's class; places without a symbol never count
        per = size // CLASSES
        member = self.rng.integers(per, size=(NOISE // 4, len(target)))
        g2, gw, bw = np.zeros_like(q), np.zeros_like(par.word), np.zeros_like(par.word_bias)
        for true, sign in [(target, -1), *((m * CLASSES + cls, 1) for m in member)]:
            vec = par.word[true]
            s = np.einsum("ij,ij->i", q, vec) + par.word_bias[true] - np.float32(np.log(len(member) / per))
            e = np.where(self.used[true], np.float32(sign) / (1 + np.exp(np.clip(-sign * s, -30, 30))), np.float32(0)) / np.float32(len(target))
            g2 += e[:, None] * vec
            gw += _scatter(size, true, e[:, None] * q)
            bw += np.bincount(true, e, size).astype(np.float32)
        grad = g1 + g2
        for name, g in (("cls", gc), ("cls_bias", bc), ("word", gw), ("word_bias", bw), ("near", _scatter(size, near, grad)), ("far", _scatter(size, far, grad))):
            self._move(name, g)


def _symbols(words: list[bytes], place: dict[bytes, int]) -> np.ndarray:
    out = np.empty(len(words) + 3, np.int64)
    out[:2], out[-1] = START, END
    out[2:-1] = np.fromiter(map(place.get, words, repeat(RARE)), np.int64, len(words))
    return out


def train(rows: DataFrame, lay: Layout) -> Parameters:
    """Rounds over disjoint parts of the training texts; each text is learnt from once."""
    par = Parameters(lay)
    if not lay.place:
        return par
    blocks, size_of_step = 16, BATCH
    for r in range(ROUNDS):
        start = par.flat()

        def learn(batches, start=start, r=r):
            task = TaskContext.get().partitionId()
            own = Trainer(lay, Parameters(lay).load(start.copy()), 1000 * task + r)
            held, size, seen = [], 0, 0

            def flush():
                nonlocal held, size, seen
                near, far, target = (np.concatenate([s[i:len(s) - 2 + i] for s in held]) for i in (1, 0, 2))
                order = own.rng.permutation(len(target))
                for at in range(0, len(order), size_of_step):
                    part = order[at:at + size_of_step]
                    own.step(near[part], far[part], target[part])
                seen += len(target)
                held, size = [], 0
            for doc, text in texts_of(batches):
                if not is_held_out(doc) and zlib.crc32(f"round {doc}".encode()) % ROUNDS == r:
                    held.append(_symbols(words_of(text), lay.place))
                    size += len(held[-1])
                    if size > 1 << 18:
                        flush()
            if held:
                flush()
            if seen:
                parts = np.array_split(own.par.flat().astype(np.float64) * seen, blocks)
                yield pa.RecordBatch.from_arrays([pa.array([task % 64] * blocks), pa.array(range(blocks)), pa.array([seen] * blocks), pa.array([p.astype("<f8").tobytes() for p in parts])],
                                                 ["salt", "block", "seen", "sums"])

        def add(key, table):
            sums = np.sum([np.frombuffer(x, "<f8") for x in table.column("sums").to_pylist()], axis=0)
            return pa.table({"block": [key[-1].as_py()], "seen": [sum(table.column("seen").to_pylist())], "sums": [sums.tobytes()]})
        kind = "block long, seen long, sums binary"
        parts = rows.mapInArrow(learn, "salt long, block long, seen long, sums binary").groupBy("salt", "block").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind)
        got = sorted(store(parts, "parameters").collect(), key=lambda x: x.block)
        if got:
            par.load(np.concatenate([np.frombuffer(x.sums, "<f8") / x.seen for x in got]))
    return par


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row."""
    rows = _rows(docs, id_col, text_col)
    counts = store(word_counts(rows), "counts")
    lay = layout(counts, rows)
    par = train(rows, lay)
    ten, total, vocabulary = np.log(10), lay.tokens + lay.types + 1, lay.types
    rare_tokens = lay.tokens - lay.ends - sum(lay.known[w] for w in lay.place)
    rare_types = vocabulary - len(lay.place) - (lay.ends > 0)

    def make():
        rank = {w: i for i, w in enumerate(lay.known)}
        n = np.array([*lay.known.values(), 0], float)  # the last place stands for words outside the dictionary
        base_of, tail_of = np.log10((n + 1) / total), np.log10((n + 1) / (rare_tokens + rare_types + 1))
        single = len(lay.place)
        base_of[-1] = tail_of[-1] = 0
        tail_of[:single] = 0
        symbol_of = np.full(len(n), RARE)
        symbol_of[:single] = 3 + np.arange(single)
        base_end = np.log10((lay.ends + 1) / total)

        def step(batch):
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                texts = [words_of(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                ranks = [np.fromiter(map(rank.get, w, repeat(len(rank))), np.int64, len(w)) for w in texts]
                symbols = [np.concatenate(([START, START], symbol_of[x], [END])) for x in ranks]
                near, far, target = (np.concatenate([s[i:len(s) - 2 + i] for s in symbols]) for i in (1, 0, 2))
                owner = np.repeat(np.arange(len(texts)), [len(s) - 2 for s in symbols])
                logs = np.zeros(len(target))
                for k in range(0, len(target), 1 << 15):
                    logs[k:k + (1 << 15)] = par.log_probabilities(near[k:k + (1 << 15)], far[k:k + (1 << 15)], target[k:k + (1 << 15)])
                model = np.bincount(owner, logs, len(texts)) / ten if lay.place else np.zeros(len(texts))
                out = ([], [], [], [], [], [])
                for i, (w, x) in enumerate(zip(texts, ranks)):
                    outside = np.flatnonzero(x == len(rank))
                    other = Counter(w[k] for k in outside.tolist())
                    for col, value in zip(out, (len(w) + 1, len(w) - len(outside) + int(lay.ends > 0), float(base_end + base_of[x].sum()),
                                                float(model[i] + tail_of[x].sum()), list(other), list(other.values()))):
                        col.append(value)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
                ids = part.column(0)
                yield pa.RecordBatch.from_arrays([ids, pa.array([is_held_out(x) for x in ids.to_pylist()]), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                                                 ["id", "held_out", "n_tokens", "n_known", "base", "model", "words", "times"])
        return step
    kind = "id long, held_out boolean, n_tokens long, n_known long, base double, model double, words array<binary>, times array<long>"
    # a row number of its own keeps repeated ids apart
    scored = store(map_arrow(rows, make, kind).withColumn("row", F.monotonically_increasing_id()), "scored")
    other = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("k"))
    tail_sum = float(rare_tokens + rare_types + 1)
    rest = (other.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
            .groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("known_too"), F.sum(F.col("k") * F.log10((F.col("c") + 1) / F.lit(float(total)))).alias("base_too"),
                                F.sum(F.col("k") * F.log10((F.col("c") + 1) / F.lit(tail_sum))).alias("tail_too")))
    out = scored.drop("words", "times").join(rest, "row", "left")
    zero = F.lit(0.0)
    base = F.col("base") + F.coalesce("base_too", zero)
    score = F.col("model") + F.coalesce("tail_too", zero)
    return out.select("id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_too", F.lit(0))).alias("n_known"), F.lit(lay.tokens).cast("long").alias("train_tokens"),
                      base.alias("base_score"), (score if lay.place else base).alias("score"))
