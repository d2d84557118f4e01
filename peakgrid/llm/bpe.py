"""BPE with word ends: exact encoding and decoding with the vocabulary of a tokenizer file.

A text is cut at the special tokens, normalised (NFC, small letters) and split into words by the file's
pattern; the ids of a word do not depend on its neighbours. Frequent words of the corpus are compiled into a minimal
acyclic transducer (states with equal futures are shared, every edge adds to an output that ends as the
word's place in an id table). Tasks map that file into memory and walk it; words outside it are merged
exactly, pair by pair in rank order. Results are remembered per task, so each distinct word is looked up once.

Defined results: a null text is empty and has no tokens; repeated rows are encoded each; null ids pass through.
"""
from __future__ import annotations

import heapq
import json
import mmap
import tempfile
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import frequency_cut, map_arrow, store, text_or_empty

LEXICON_WORDS = 50_000
REMEMBER = 300_000
#: Edges of the mapped transducer that a task remembers.
EDGES = 200_000
#: Words of up to so many bytes are merged by a scan of their pairs, longer ones by a heap.
SHORT = 40
UNRANKED = 1 << 60


@lru_cache
def byte_letters() -> list[str]:
    """The visible letter of each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@lru_cache
def byte_of_letter() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


#: Ranges whose classes are the same in every Unicode version in use: Latin, Greek, Cyrillic, Devanagari, punctuation, kana, Han, Hangul.
SETTLED = regex.compile("[\x00-\u0557\u0900-\u097f\u2010-\u2027\u20a0-\u20b9\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]*")


class Vocabulary:
    """Ids, merges, special tokens and word pattern of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        # ids of two neighbours -> rank of their merge and id of the merged token
        self.joins = {self.ids[a] << 20 | self.ids[b]: rank << 20 | self.ids[a + b] for rank, (a, b) in enumerate(model["merges"])}
        self.inner = [self.ids[c] for c in byte_letters()]
        self.last = [self.ids[c + self.end] for c in byte_letters()]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.library = Tokenizer.from_file(path)
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens. Letters of recent Unicode versions are left to the library's own splitter."""
        if not text.isascii():
            if not SETTLED.fullmatch(text):
                runs = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes(map(byte_of_letter().__getitem__, run)).decode("utf-8", "surrogatepass") for run, _ in runs]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form: letters are lowered one by one
        return self.pattern.findall(text.lower())

    def words_of_chunk(self, chunk: bytes) -> list[str]:
        """Words of a stretch without ASCII blanks: no word holds a blank, and blanks neither compose nor change the letters beside them."""
        return self.words(chunk.decode("utf-8", "surrogatepass"))

    def segments(self, text: str):
        """Stretches of text and the special tokens between them, as (text, special id or None)."""
        at = 0
        if self.cut is not None and "<" in text:
            for m in self.cut.finditer(text):
                yield text[at:m.start()], self.special[m.group()]
                at = m.end()
        yield text[at:], None

    def merge(self, word: str) -> list[int]:
        """Ids of a word: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
        raw, joins, none = word.encode("utf-8", "surrogatepass"), self.joins.get, UNRANKED
        parts = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        n = len(parts)
        if n <= SHORT:
            order = [joins(left << 20 | right, none) for left, right in pairwise(parts)]
            while order and (low := min(order)) != none:
                i = order.index(low)
                parts[i] = low & 0xFFFFF
                del parts[i + 1], order[i]
                if i:
                    order[i - 1] = joins(parts[i - 1] << 20 | parts[i], none)
                if i < len(order):
                    order[i] = joins(parts[i] << 20 | parts[i + 1], none)
            return parts
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(join, i, parts[i], parts[i + 1]) for i in range(n - 1) if (join := joins(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            join, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = join & 0xFFFFF, -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (join := joins(parts[i] << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (join, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (join := joins(parts[h] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (join, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space (the file names no decoder); word ends and special tokens stay visible."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# The transducer ---------------------------------------------------------------------------------------------

def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """Minimal acyclic transducer over the UTF-8 bytes of ``words`` with their ids.

    Words enter in byte order; the part of the last word that can no longer change is replaced by an equal
    registered state. Layout, all little-endian uint32: numbers of states, edges, words and ids; per state the
    first edge (top bit: a word ends here); per edge label, target and output; id offsets; ids.
    """
    register: dict[tuple, int] = {}
    edges_of: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    path: list[tuple[list[tuple[int, int]], bool]] = [([], False)]  # open states of the last word

    def close(keep: int, last: bytes):
        while len(path) > keep + 1:
            edges, ends = path.pop()
            key = (ends, tuple(edges))
            if key not in register:
                register[key] = len(edges_of)
                edges_of.append(edges)
                final.append(ends)
            path[-1][0].append((last[len(path) - 1], register[key]))

    keys = sorted(w.encode("utf-8", "surrogatepass") for w in words)
    last = b""
    for key in keys:
        same = next((i for i, (a, b) in enumerate(zip(key, last)) if a != b), min(len(key), len(last)))
        close(same, last)
        path += [([], False) for _ in key[same:]]
        path[-1] = (path[-1][0], True)
        last = key
    close(0, last)
    edges_of.append(path[0][0])
    final.append(path[0][1])
    reach = []  # words from each state on; targets come first
    for edges, ends in zip(edges_of, final):
        reach.append(ends + sum(reach[t] for _, t in edges))
    first, label, target, output = [], [], [], []
    for edges, ends in zip(edges_of, final):
        first.append(len(label) | ends << 31)
        seen = int(ends)
        for c, t in edges:
            label.append(c)
            target.append(t)
            output.append(seen)
            seen += reach[t]
    ids = [words[k.decode("utf-8", "surrogatepass")] for k in keys]
    offsets = np.cumsum([0, *map(len, ids)])
    flat = [x for w in ids for x in w]
    parts = [[len(first), len(label), len(keys), len(flat)], [*first, len(label)], label, target, output, offsets, flat]
    return b"".join(np.asarray(p, dtype="<u4").tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon mapped into memory from a file of this task that has no name any more."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map).cast("I")
        states, edges, words, ids = view[:4]
        at = 4
        for name, size in (("first", states + 1), ("label", edges), ("target", edges), ("output", edges), ("offset", words + 1), ("ids", ids)):
            setattr(self, name, view[at:at + size])
            at += size
        self.start = states - 1
        self.walked: dict[int, tuple[int, int] | None] = {}

    def _edge(self, step: int) -> tuple[int, int] | None:
        """Target and output of the edge ``state << 8 | label`` from the map, remembered for the next walk."""
        state, c = step >> 8, step & 255
        low, end = self.first[state] & 0x7FFFFFFF, self.first[state + 1] & 0x7FFFFFFF
        at = bisect_left(self.label, c, low, end)
        found = (self.target[at], self.output[at]) if at < end and self.label[at] == c else None
        if len(self.walked) >= EDGES:
            self.walked.clear()
        self.walked[step] = found
        return found

    def find(self, word: str) -> list[int] | None:
        """Ids of the word, or None if it is not in the lexicon."""
        state, place, first, walked = self.start, 0, self.first, self.walked
        for c in word.encode("utf-8", "surrogatepass"):
            step = state << 8 | c
            edge = walked.get(step, 0)
            if edge == 0:
                edge = self._edge(step)
            if edge is None:
                return None
            state = edge[0]
            place += edge[1]
        if not first[state] >> 31:
            return None
        return self.ids[self.offset[place]:self.offset[place + 1]].tolist()


@lru_cache(maxsize=1)
def library_encoder(path: str) -> "Encoder":
    """One encoder for all tasks of a worker, with the library's own merging of words not yet met."""
    encoder = Encoder(path)
    letters, model = byte_letters(), encoder.vocabulary.library.model
    encoder.merge = lambda word: [t.id for t in model.tokenize("".join(map(letters.__getitem__, word.encode("utf-8", "surrogatepass"))))]
    return encoder


class Encoder(dict):
    """Word -> its ids as little-endian bytes; texts to id bytes."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        super().__init__()
        self.vocabulary = vocabulary(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.merge = self.vocabulary.merge

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = raw = np.asarray(self.ids_of(word), dtype="<u4").tobytes()
        return raw

    def ids_of(self, word: str) -> list[int]:
        ids = self.lexicon.find(word) if self.lexicon else None
        return self.merge(word) if ids is None else ids

    def encode(self, text: str) -> bytes:
        out = []
        for part, special in self.vocabulary.segments(text):
            out += map(self.__getitem__, self.vocabulary.words(part))
            if special is not None:
                out.append(special.to_bytes(4, "little"))
        return b"".join(out)


class Remembered(dict):
    """Word -> what ``make`` gives for it; forgets all when full."""

    def __init__(self, make: Callable[[str], str]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> str:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = out = self.make(word)
        return out


class Listing:
    """Texts to their ids as decimals and to their tokens, both joined by spaces and remembered for each word."""

    def __init__(self, encoder: Encoder):
        self.vocabulary = encoder.vocabulary
        self.decimals = Remembered(lambda word: " ".join(map(str, encoder.ids_of(word))))
        # the ids are read back from their decimals
        self.tokens = Remembered(lambda word: self.vocabulary.decode(map(int, self.decimals[word].split())))

    def list(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the decoded text."""
        ids, decoded = [], []
        for part, special in self.vocabulary.segments(text):
            words = self.vocabulary.words(part)
            ids += map(self.decimals.__getitem__, words)
            decoded += map(self.tokens.__getitem__, words)
            if special is not None:
                ids.append(str(special))
                decoded.append(self.vocabulary.tokens[special])
        joined = " ".join(ids)
        return joined.count(" ") + bool(joined), joined, " ".join(decoded)


def chunks(text: str) -> list[bytes]:
    """Stretches between ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def _count(words: Vocabulary, batches: Iterable[pa.RecordBatch]):
    """``(word, n)`` batches of a task: stretches between blanks are counted, and each distinct one is cut into words once."""
    seen = Counter()

    def rows():
        found = {}
        for chunk, n in seen.items():
            for word in words.words_of_chunk(chunk):
                found[word] = found.get(word, 0) + n
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for part, _ in words.segments(text):
                seen.update(chunks(part))
            if len(seen) > REMEMBER:
                yield rows()
    if seen:
        yield rows()


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over all texts, counted inside the tasks first."""
    return (docs.select(text_or_empty(text_col).alias("text")).mapInArrow(lambda batches: _count(vocabulary(path), batches), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """Lexicon of the most frequent words of all texts, ``size`` at most (equal counts stay or go together); the rest is merged exactly when met."""
    counts = store(word_counts(docs, path, text_col), "words")
    top = counts.filter(F.col("n") >= frequency_cut(counts, size)).select("word").collect()
    return compile_lexicon({r.word: vocabulary(path).merge(r.word) for r in top})


def encode(docs: DataFrame, path: str, lexicon: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` for every row, whole texts."""
    def make():
        encoder = Encoder(path, lexicon)

        def step(batch):
            raw = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in raw], pa.list_(pa.int32()))], ["id", "ids"])
        return step
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")), make, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` with the decoded text of each id list; a null list gives an empty text."""
    def make():
        words = vocabulary(path)

        def step(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])
        return step
    return map_arrow(encoded.select("id", ids_col), make, "id long, text string")


def round_trip(docs: DataFrame, path: str, lexicon: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_text, decoded)``: encoded, listed as decimals, and decoded from the ids, in one pass."""
    def make():
        listing = Listing(Encoder(path, lexicon))

        def step(batch):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids, decoded = zip(*map(listing.list, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                                 ["id", "n_tokens", "ids_text", "decoded"])
        return step
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")), make,
                     "id long, n_tokens long, ids_text string, decoded string")
