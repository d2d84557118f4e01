"""BPE against the tokenizers library."""
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from peakgrid.llm import bpe
from peakgrid.llm.common import frequency_cut
from peakgrid.llm.queries import tokenizer_path

PATH = tokenizer_path()
TEXTS = ["", " \t\n", "Hello, World! it's 2024", "ΣΑΣ σας İstanbul ǅ ﬁn", "été ẛ̣", "<|startoftext|>Hi<|endoftext|> <|endoftext|", "a<|STARTOFTEXT|>b", "日本語 テスト ١٢٣ ½ ²",
         "\x00\x01\x1c\x1d\x85  　x﻿y", "🙂🙃 👩‍👩‍👧", "don't 'tis we'll they'd I'm 'sword", "x" * 5000, "ab" * 3000 + "!" * 999, "word " * 3000, "naïve façade — “quoted” …", "́ͅą́"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_library(library):
    own = bpe.Encoder(PATH)
    for t in TEXTS:
        want = library.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(t), "<u4").tolist()
        assert got == want, t[:30]
        assert own.vocabulary.decode(got) == library.decode(got, skip_special_tokens=False)


def test_every_character(library):
    """All characters, in small groups with letters around them."""
    own = bpe.Encoder(PATH)
    chars = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x10000), *range(0x10000, 0x20000, 3)]]
    bad = []
    for i in range(0, len(chars), 40):
        text = "".join(f"{c}a{c}1 " for c in chars[i:i + 40])
        if np.frombuffer(own.encode(text), "<u4").tolist() != library.encode(text, add_special_tokens=False).ids:
            bad += [hex(ord(c)) for c in chars[i:i + 40] if np.frombuffer(own.encode(f"{c}a{c}1 "), "<u4").tolist() != library.encode(f"{c}a{c}1 ", add_special_tokens=False).ids]
    assert not bad, bad


def test_both_ways_of_merging(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeinrst'éø日"), int(rng.integers(1, 30)))) for _ in range(1500)] + ["aaaa", "aaaaaaa", "abababab"]
    own = bpe.vocabulary(PATH)
    scanned = [own.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [own.merge(w) for w in words] == scanned


def test_lexicon_finds_its_words_only():
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abcé日"), int(rng.integers(1, 7)))): None for _ in range(2000)}
    words = {w: rng.integers(0, 49_000, int(rng.integers(1, 4))).tolist() for w in words}
    lexicon = bpe.Lexicon(compiled := bpe.compile_lexicon(words))
    assert all(lexicon.find(w) == ids for w, ids in words.items())
    others = ["".join(rng.choice(list("abcé日x"), int(rng.integers(0, 8)))) for _ in range(3000)]
    assert all(lexicon.find(w) is None for w in others if w not in words)
    assert bpe.Lexicon(bpe.compile_lexicon({})).find("a") is None
    endings = {f"{a}{b}tionally": [1] for a in "abcdefgh" for b in "klmnop"}
    assert np.frombuffer(bpe.compile_lexicon(endings), "<u4")[0] < 15  # endings are shared: far fewer states than letters
    assert len(compiled) > 0


def test_tables(spark, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, None, "word"])] + [(None, "word", 2)], "doc_id long, text string, n_tokens int")
    for size in (0, 5, 50_000):
        lexicon = bpe.build_lexicon(df, PATH, size=size)
        got = {r.id: r for r in bpe.round_trip(df, PATH, lexicon).collect()}
        assert len(got) == len(TEXTS) + 3
        for i, t in enumerate([*TEXTS, "", "word"]):
            ids = library.encode(t, add_special_tokens=False).ids
            assert (got[i].n_tokens, got[i].ids_text, got[i].decoded) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
    back = {r.id: r.text for r in bpe.decode(bpe.encode(df, PATH, lexicon), PATH).collect()}
    assert back == {i: r.decoded for i, r in got.items()}
    assert bpe.round_trip(df.limit(0), PATH, bpe.build_lexicon(df.limit(0), PATH)).collect() == []


def test_frequency_cut(spark):
    """Against sorted counts: at most so many rows reach the cut, and one class of equal counts more would be too many."""
    rng = np.random.default_rng(9)
    for values in ([], [1] * 10, [5, 4, 3, 2, 1], rng.integers(1, 100, 500).tolist(), (2 ** rng.uniform(0, 40, 300)).astype(int).tolist()):
        counts = spark.createDataFrame([(v,) for v in [*values, None]], "n long")
        for size in (0, 1, 5, 250, 1000):
            cut = frequency_cut(counts, size)
            kept = [v for v in values if v >= cut]
            assert len(kept) <= size
            below = [v for v in values if v < cut]
            if below and max(below) < 128:
                assert len(kept) + below.count(max(below)) > size


def test_listing_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 4)
    own = bpe.Listing(bpe.Encoder(PATH))
    for t in TEXTS + ["one two three", "four five six seven eight nine", "one nine two"]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.list(t) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), t[:30]


def test_words_are_counted_by_stretches(spark, monkeypatch):
    """Counts are those of the words of whole texts, and a stretch that comes often is cut into words once."""
    own, texts = bpe.vocabulary(PATH), TEXTS + [f"{a}{b}{c}" for a in ("x", "Σ", "e", "<") for b in " \t\n\x0b\x0c\r\x1c\x85　 " for c in ("́a", "'S it's", "̸=", "9½")]
    want = Counter(w for t in texts for part, _ in own.segments(t) for w in own.words(part))
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    assert {r.word: r.n for r in bpe.word_counts(df, PATH).collect()} == want
    calls, words = [], bpe.Vocabulary.words
    monkeypatch.setattr(bpe.Vocabulary, "words", lambda self, text: calls.append(text) or words(self, text))
    batch = pa.RecordBatch.from_arrays([pa.array(["the same, again"] * 500)], ["text"])
    assert [r for b in bpe._count(own, [batch]) for r in b.to_pylist()] == [{"word": w, "n": 500} for w in ("the", "same", ",", "again")]
    assert len(calls) == 3
