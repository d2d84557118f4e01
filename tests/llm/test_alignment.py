"""Alignment against the libraries on whole texts, a scan over all ends and counting in plain Python."""
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peakgrid.llm import alignment
from peakgrid.llm.bpe import byte_of_letter

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["plain words, twice: plain words", "two  spaces   here ", " leading", "tabs\tand\nlines \n  indented\n\n x", "naïve café, Ünïcode ÷ ×", "日本語のテキスト と english", "emoji 👩‍👩‍👧 and ½ ²  x  y",
         "<|endoftext|> <s> </s> <unk> <0x0A>", "1234567 00000000 3.14", "don't they'll WE'VE 'd", "=" * 100 + " " + "-" * 33, "a" * 5000, "▁ under", "zero▁", "﻿ bom ​ \u0000 nul", "", None,
         "  ", "\n", " \n a", "é é İstanbul ǆ ɏ ɐ x", "x" * 300_000 + " " + "word " * 20_000]


def scan(a, b):
    """Groups by walking over all ends."""
    out, i, j, i0, j0 = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i0, i + 1, j0, j + 1))
            i, j = i + 1, j + 1
            i0, j0 = i, j
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60), min_size=1), st.sets(st.integers(1, 60), min_size=1))
def test_divide_finds_every_cut(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    assert alignment.divide(a, b) == scan(a, b)


class Whole:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        letters = byte_of_letter()
        self.vocab = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}

    def piece(self, i):
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        ids = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = [[self.vocab[i] for i in ids[0]], [self.piece(i) for i in ids[1]]]
        if not b"".join(raw[0]) == b"".join(raw[1]) == (" " + text).encode():
            return []
        ends = [[], []]
        for e, r in zip(ends, raw):
            at = 0
            for x in r:
                at += len(x)
                e.append(at)
        return [(ids[0][i:j], ids[1][k:m]) for i, j, k, m in scan(*ends)]


def brute(rows):
    whole, links = Whole(), []
    found = [(doc, whole.groups(text)) for doc, text in rows]
    for _, g in found:
        links.append([(a, b) for x, y in g for a in x for b in y])
    docs = Counter(p for x in links for p in set(x))
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (doc, g), x in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(x), sum(docs[p] == most[p[0]] for p in x), sum(docs[p] for p in x),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1, 40, 10**6])
def test_equals_whole_texts(spark, chunk):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, "another text of the id"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pairs int, chunk string").repartition(3)
    got = alignment.score(alignment.align(df, A, B, chunk)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert alignment.score(alignment.align(df.limit(0), A, B)).collect() == []


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = alignment.score(alignment.align(docs, A, B, 5000)).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_and_unit_memory(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in alignment.groups(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    whole = Whole()
    assert got == {i: whole.groups(t) for i, t in rows}
    monkeypatch.setattr(alignment, "REMEMBER", 2)
    small = alignment.Aligner(A, B)
    texts = [t for t in TEXTS if t]
    assert [[u.text for u in x] for x in small.documents(texts)] == [[u.text for u in x] for x in alignment.Aligner(A, B).documents(texts)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tab'sS1.,é×▁ 日<|>"), max_size=30))
def test_any_text(text):
    found = next(SHARED.documents([text]), [])
    assert ";".join(u.text for u in found) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in WHOLE.groups(text))


SHARED, WHOLE = alignment.Aligner(A, B), Whole()
