"""Licence notices by a positional index of rare words.

Every template's rarest words (by document frequency over all documents) are indexed with their places. A text's occurrences of such words are looked up;
each proposes where the template would begin, and proposals of several words meet at the same beginning. There the
template is verified: its rarest key phrase stands in its place, the other key phrases within ``slack`` words of theirs, and the share of all its words
found that near to their places is at least ``cover``. That share is the score.
Besides, plain phrases are searched word by word (``base``).

Words are ASCII letters and digits and everything beyond ASCII, in small ASCII letters. Defined results: a null text is empty; without a phrase its places are null, without a
label the lists are empty strings, without a notice the score is 0; repeated rows are scanned each; null ids pass through.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty

WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RARE, VOTES, SLACK, COVER = 8, 3, 4, 0.6

#: Plain phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Usual notices as (label, wording, key phrases).
NOTICES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "version 3 of the license"]),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "version 2 of the license"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ["gnu lesser general public license"]),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
     ["gnu affero general public license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
     ["in compliance with the license", "apache org licenses license 2 0"]),
    ("mit", "Released under the MIT License", ["the mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
            "notice appear in all copies", ["with or without fee is hereby granted"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]


def words(text: str) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower())  # of bytes, only ASCII letters get small


def _places(text: Sequence[bytes], phrase: Sequence[bytes]) -> list[int]:
    n = len(phrase)
    return [i for i in range(len(text) - n + 1) if text[i] == phrase[0] and list(text[i:i + n]) == list(phrase)]


class Index:
    """Templates with their rare words, from the number of documents each word is in."""

    def __init__(self, notices: Sequence[tuple[str, str, Sequence[str]]], holders: dict[bytes, int], n_docs: int, rare: int = RARE, votes: int = VOTES, slack: int = SLACK, cover: float = COVER):
        self.slack, self.cover = slack, cover
        self.labels, self.texts, self.keys, self.need, self.anchor = [], [], [], [], []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for label, wording, phrases in notices:
            text = words(wording)
            keys = []
            for p in phrases:
                at = _places(text, words(p))
                if not at:
                    raise ValueError(f"key phrase {p!r} is not in the notice of {label}")
                keys.append((at[0], words(p)))
            idf = {w: math.log((n_docs + 1) / (holders.get(w, 0) + 1)) for w in text}

            def rank(w, idf=idf):
                return (-idf[w], w)
            keys.sort(key=lambda k: min(map(rank, k[1])))
            anchor = min(keys[0][1], key=rank)
            chosen = {anchor, *sorted(idf, key=rank)[:rare]}
            number = len(self.labels)
            for place, w in enumerate(text):
                if w in chosen:
                    self.postings[w].append((number, place))
            self.labels.append(label)
            self.texts.append(text)
            self.keys.append(keys)
            self.need.append(min(votes, len(chosen)))
            self.anchor.append((anchor, keys[0][0] + keys[0][1].index(anchor)))

    def find(self, text: list[bytes]) -> list[tuple[int, int, float]]:
        """``(template, beginning, share of its words in place)`` of every notice."""
        votes = defaultdict(list)
        for at, w in enumerate(text):
            if w in self.postings:
                for number, place in self.postings[w]:
                    votes[number].append((at - place, w))
        out = []
        for number, cast in votes.items():
            if len({w for _, w in cast}) < self.need[number]:
                continue
            cast.sort()
            anchor, place = self.anchor[number]
            for start in sorted({o for o, w in cast if w == anchor and text[o + place:o + place + 1] == [anchor]}):
                near = {w for _, w in cast[bisect_left(cast, (start - self.slack,)):bisect_left(cast, (start + self.slack + 1,))]}
                if len(near) >= self.need[number] and (share := self.verify(text, number, start)):
                    out.append((number, start, share))
        return out

    def verify(self, text: list[bytes], number: int, start: int) -> float:
        """Share of the template's words near their places, 0 where a key phrase is missing or the share is too small."""
        for i, (place, phrase) in enumerate(self.keys[number]):
            reach = self.slack if i else 0
            if not any(text[o:o + len(phrase)] == phrase for o in range(max(0, start + place - reach), start + place + reach + 1)):
                return 0.0
        wording = self.texts[number]
        found = sum(w in text[max(0, start + i - self.slack):max(0, start + i + self.slack + 1)] for i, w in enumerate(wording))
        return found / len(wording) if found >= self.cover * len(wording) else 0.0


def holders(docs: DataFrame, notices=NOTICES, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """Documents that hold each word of the notices, and all documents; at most one row a word and task is shuffled, one a word collected."""
    known = {w for _, wording, _ in notices for w in words(wording)}

    def run(batches):
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(known.intersection(words(text)))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*seen, b""], pa.binary()), pa.array([*seen.values(), n], pa.int64())], ["word", "docs"])
    found = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "word binary, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    counts = {bytes(r.word): r.docs for r in found}
    return counts, counts.pop(b"", 0)


SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "notices array<struct<label:string,start:int,words:int,share:double>>")


def scan(docs: DataFrame, notices=NOTICES, base: dict[str, str] = BASE, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its words, base phrases, labels of both kinds, score, and every notice with its beginning and the words it spans."""
    index = index or Index(notices, *holders(docs, notices, text_col))
    phrases = defaultdict(list)
    for phrase, label in base.items():
        phrases[words(phrase)[0]].append((words(phrase), label))
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("words", pa.int32()), ("share", pa.float64())]))
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), spans]
    names = [x.split()[0] for x in SCANNED.split(", ")]

    def make():
        def step(batch):
            rows = []
            for doc, raw in zip(*(c.to_pylist() for c in batch.columns)):
                text = words(raw)
                places, labels = [], set()
                for at, w in enumerate(text):
                    if w in phrases:
                        for phrase, label in phrases[w]:
                            if text[at:at + len(phrase)] == phrase:
                                places.append(at)
                                labels.add(label)
                found = sorted(index.find(text), key=lambda x: (x[1], x[0]))
                more = labels | {index.labels[t] for t, _, _ in found}
                rows.append((doc, len(text), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(labels)), ",".join(sorted(more)),
                             max((s for _, _, s in found), default=0.0), [{"label": index.labels[t], "start": o, "words": len(index.texts[t]), "share": s} for t, o, s in found]))
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        return step
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), make, SCANNED)
