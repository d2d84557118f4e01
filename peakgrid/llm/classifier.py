"""Quality classifier by co-training on two views of a document.

The *content* view sees hashed words and word shapes; the *metadata* view sees language, source,
length and page layout (lines, character classes), no words. Both are logistic regressions. In each round
every unlabelled document is scored by both, and the documents one view is surest of
become training rows of the other. Held-out labelled rows calibrate the views, whose log odds are then added.

Bounds (parameters): ``max_labels`` labelled rows are fitted, half for each class, chosen by
a hash of the id; a fifth of them only calibrates. Each round moves at most ``quota`` rows a class
and view. All documents are candidates in every round and all are scored.

Defined results: a null text is empty; null or missing language, source and length are values of their own;
ids with contradictory or null labels count as unlabelled; if one class has no label, every score is the
prior and every document is kept; repeated rows are scored each.
"""
from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, store

WORDS, SHAPES, SPREAD = 6144, 2032, 16
CONTENT = WORDS + SHAPES + SPREAD
NUMBERS, LANGS, SOURCES = 12, 16, 64
META = NUMBERS + LANGS + SOURCES
CACHE = 200_000


def _shape(word: str) -> str:
    """Runs of capitals, small letters, digits and each other sign, folded, over the whole word; in long shapes repeated run patterns count once."""
    out = []
    for ch in word:
        kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out) if len(out) <= 24 else re.sub(r"(.{1,4}?)\1+", r"\1", "".join(out))


class Places(dict):
    """Word -> its place among words and among shapes, packed into one number; computed once for each word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        at = (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS) << 16 | (
            WORDS + zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) % SHAPES)
        self[word] = at
        return at


class Content:
    """Texts to counts of hashed words and shapes; remembers words it has seen."""

    def __init__(self):
        self.places = Places()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        both = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        counts = np.bincount(both >> 16, minlength=CONTENT) + np.bincount(both & 0xFFFF, minlength=CONTENT)
        counts[WORDS + SHAPES + min(SPREAD - 1, SPREAD * len(set(words)) // len(words))] = len(words)
        at = np.flatnonzero(counts)
        return at.astype(np.int32), counts[at].astype(np.int32)


def _place(value, size: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(str(value).encode()) % (size - 1)


def metadata(text: str, lang, source, n_chars) -> np.ndarray:
    """Layout numbers, then one place each for language and source."""
    out = np.zeros(META, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    size, lines = max(1, len(raw)), int(kinds[10]) + 1
    upper, lower, digit = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    space, wide = kinds[32] + kinds[9:14].sum(), kinds[128:].sum()
    common = kinds[[44, 46]].sum()
    other = len(raw) - upper - lower - digit - space - wide - common
    out[:NUMBERS] = [np.log1p(len(text) if n_chars is None else max(0, n_chars)), np.log1p(lines), np.log1p(len(raw) / lines), upper / size, lower / size,
                     digit / size, space / size, wide / size, common / size, other / size, np.sqrt(other / size), np.sqrt(upper / size)]
    out[NUMBERS + _place(lang, LANGS)] = 1
    out[NUMBERS + LANGS + _place(source, SOURCES)] = 1
    return out


def _fit(margin, gradient, size: int, y: np.ndarray, w: np.ndarray, ridge: float, steps: int = 200) -> np.ndarray:
    """Logistic regression by Adam on the whole sample; the last weight is the intercept."""
    beta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w = w / w.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(margin(beta[:-1]) + beta[-1], -35, 35)))
        r = w * (p - y)
        g = np.append(gradient(r) + ridge * beta[:-1], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        beta -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return beta


def _unit(at: np.ndarray, n: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Logarithms of the counts, scaled to length one for each document."""
    w = np.log1p(n.astype(np.float64))
    return w / np.sqrt(np.bincount(owner, w * w, size))[owner] if len(w) else w


def fit_content(rows: list[tuple[np.ndarray, np.ndarray]], y, w) -> np.ndarray:
    ids, n = np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows])
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    vals = _unit(ids, n, owner, len(rows))
    return _fit(lambda b: np.bincount(owner, vals * b[ids], len(rows)), lambda r: np.bincount(ids, vals * r[owner], CONTENT), CONTENT, y, w, 1e-5)


def fit_metadata(x: np.ndarray, y, w) -> np.ndarray:
    return _fit(lambda b: x @ b, lambda r: x.T @ r, META, y, w, 1e-3)


@dataclass
class Model:
    content: np.ndarray
    meta: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    scale: np.ndarray  # slope and intercept of each view's log odds
    prior: float

    def margins(self, at: np.ndarray, n: np.ndarray, sizes: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of many documents at once; ``sizes`` places of each lie one after another in ``at``."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        a = np.bincount(owner, _unit(at, n, owner, len(sizes)) * self.content[at], len(sizes))
        return a + self.content[-1], ((meta - self.mean) / self.sd) @ self.meta[:-1] + self.meta[-1]

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.scale[0] * a + self.scale[1], self.scale[2] * b + self.scale[3]
        odds = a + b - np.log(self.prior / (1 - self.prior))
        return tuple(1 / (1 + np.exp(-np.clip(x, -35, 35))) for x in (a, b, odds))


def _columns(docs: DataFrame) -> DataFrame:
    def have(c, kind):
        return F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       have("lang", "string"), have("source", "string"), have("n_chars", "long"))


VECTOR = "doc_id long, at array<int>, n array<int>, meta array<float>"


def vectors(docs: DataFrame) -> DataFrame:
    """Both views of every document: ``(doc_id, at, n, meta)``."""
    def make():
        content = Content()

        def step(batch):
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [x.to_pylist() for x in part.columns]
                pairs = [content(t) for t in rows[1]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in pairs], pa.list_(pa.int32())), pa.array([n for _, n in pairs], pa.list_(pa.int32())),
                                                  pa.array([metadata(*r) for r in zip(*rows[1:])], pa.list_(pa.float32()))], ["doc_id", "at", "n", "meta"])
        return step
    return map_arrow(_columns(docs), make, VECTOR)


def _sample(rows: DataFrame, ids: list[int]) -> dict:
    """Vectors of the given ids (a bounded list), by id; of repeated rows with one id, the smallest vector."""
    chosen = rows.sparkSession.createDataFrame(sorted((i,) for i in set(ids)), "doc_id long")
    got = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "at", "n", "meta").toArrow()
    out = {}
    for part in got.to_batches():  # numpy views of the Arrow buffers: no Python numbers, and no second copy on the driver
        (at, n), ends = (c.flatten().to_numpy() for c in part.columns[1:3]), np.append(0, part.column(1).value_lengths().to_numpy().cumsum())
        meta = part.column(3).flatten().to_numpy().reshape(-1, META).astype(np.float64)
        for k, i in enumerate(part.column(0).to_pylist()):
            one = slice(ends[k], ends[k + 1])
            if i not in out or at[one].tobytes() < out[i][0][0].tobytes():
                out[i] = ((at[one], n[one]), meta[k])
    return dict(sorted(out.items()))


def _platt(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the log odds; smoothed targets keep them finite."""
    up, down = (y > 0.5).sum(), (y < 0.5).sum()
    target = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    sd = s.std() or 1.0
    beta = _fit(lambda b: s / sd * b[0], lambda r: np.array([(s / sd * r).sum()]), 1, target, w, 1e-4, 400)
    return max(0.0, beta[0]) / sd, beta[1]


def clean_labels(labels: DataFrame) -> DataFrame:
    return (labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min("quality").alias("y"), F.max("quality").alias("top")).filter("y = top").select("doc_id", "y"))


def train(labelled: DataFrame, pool: DataFrame, labels: DataFrame, max_labels: int = 8000, rounds: int = 3, quota: int = 200, sure: float = 0.95) -> Model | float:
    """Co-train on :func:`vectors` of ``labelled`` and of the ``pool``, whose unlabelled rows are the candidates.
    With labels of one class only, their share."""
    known = store(clean_labels(labels).join(labelled.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id"), "labels")
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return float(next(iter(count), 1))
    order = F.xxhash64("doc_id")
    chosen = known.filter("y = 0").orderBy(order).limit(max_labels // 2).union(known.filter("y = 1").orderBy(order).limit(max_labels // 2))
    y_of = {r.doc_id: r.y for r in chosen.collect()}
    rows = _sample(labelled, list(y_of))
    share = {c: count[c] / max(1, sum(y == c for y in y_of.values())) for c in count}
    held = [i for i in rows if zlib.crc32(f"held {i}".encode()) % 5 == 0]
    fit = [i for i in rows if zlib.crc32(f"held {i}".encode()) % 5]
    if {y_of[i] for i in held} != {0, 1} or {y_of[i] for i in fit} != {0, 1}:
        held = fit = list(rows)
    mean = np.mean([rows[i][1] for i in fit], axis=0)
    sd = np.std([rows[i][1] for i in fit], axis=0)
    sd[sd < 1e-6] = 1
    prior = count[1] / (count[0] + count[1])
    extra: list[dict] = [{}, {}]  # rows the other view has labelled, for content and for metadata

    def fitted() -> Model:
        sides = []
        for side in (0, 1):
            own = [(rows[i][side], y_of[i], share[y_of[i]]) for i in fit] + [(x[side], y, share[y]) for x, y in extra[side].values()]
            y, w = np.array([r[1] for r in own], float), np.array([r[2] for r in own], float)
            sides.append(fit_content([r[0] for r in own], y, w) if side == 0 else fit_metadata((np.array([r[0] for r in own]) - mean) / sd, y, w))
        model = Model(sides[0], sides[1], mean, sd, np.array([1.0, 0, 1, 0]), prior)
        s = np.stack(model.margins(np.concatenate([rows[i][0][0] for i in held]), np.concatenate([rows[i][0][1] for i in held]),
                                   np.array([len(rows[i][0][0]) for i in held]), np.array([rows[i][1] for i in held])), axis=1)
        y, w = np.array([y_of[i] for i in held], float), np.array([share[y_of[i]] for i in held])
        model.scale = np.array([*_platt(s[:, 0], y, w), *_platt(s[:, 1], y, w)])
        return model

    model = fitted()
    for _ in range(rounds):
        scored = store(score(pool, model).filter("doc_id IS NOT NULL").select("doc_id", "p_content", "p_metadata")
                       .join(known.select("doc_id"), "doc_id", "left_anti"), "scores")  # narrow rows, no text in the shuffle
        moved = []
        for side, view in enumerate(("p_content", "p_metadata")):
            for y, part in ((1, scored.filter(f"{view} >= {sure}").orderBy(F.desc(view), order)), (0, scored.filter(f"{view} <= {1 - sure}").orderBy(view, order))):
                moved += [(1 - side, r.doc_id, y) for r in part.limit(quota + len(extra[1 - side])).collect() if r.doc_id not in extra[1 - side]][:quota]
        if not moved:
            break
        found = _sample(pool, [i for _, i, _ in moved])
        for side, i, y in moved:
            extra[side][i] = (found[i], y)
        model = fitted()
    return model


def _scored(at: pa.Array, n: pa.Array, meta: pa.Array, model: Model) -> list[np.ndarray]:
    sizes = np.diff(at.offsets.to_numpy())
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (at, n)]
    return list(model.scores(*model.margins(*flat, sizes, meta.flatten().to_numpy(zero_copy_only=False).reshape(-1, META).astype(np.float64))))


def score(rows: DataFrame, model: Model | float) -> DataFrame:
    """``(doc_id, p_content, p_metadata, score)`` for :func:`vectors`: the probability of good quality by each view and by both."""
    names = ("p_content", "p_metadata", "score")
    if isinstance(model, float):
        return rows.select("doc_id", *[F.lit(model).alias(c) for c in names])

    def make():
        def step(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _scored(*batch.columns[1:], model))], ["doc_id", *names])
        return step
    return map_arrow(rows.select("doc_id", "at", "n", "meta"), make, "doc_id long, p_content double, p_metadata double, score double")


def keep_good(docs: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those scored below ``threshold``; columns as they were."""
    if isinstance(model, float):
        return docs
    views = _columns(docs).columns
    held = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in views]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct(*held).alias("_view"))

    def make():
        content = Content()

        def step(batch):
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                view = [(r["text"] or "", r["lang"], r["source"], r["n_chars"]) for r in part.column(1).to_pylist()]
                pairs = [content(v[0]) for v in view]
                cols = [pa.array([p[i] for p in pairs], pa.list_(pa.int32())) for i in (0, 1)]
                good = _scored(*cols, pa.array([metadata(*v) for v in view], pa.list_(pa.float32())), model)[2] >= threshold
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good))], ["_row"])
        return step
    return map_arrow(rows, make, f"_row {docs.schema.simpleString()}").select("_row.*")
