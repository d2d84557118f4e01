"""The scan against a plain search of phrases and a trial of every template at every place."""
import random
import re

from peakgrid.llm import licences as lic

LINES = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.",
         "Licensed under the Apache License, Version 2.0.", "the MIT license, the mit LICENSE and cc by", "gnu general public", "Apache-license", *[n for _, n, _ in lic.NOTICES]]
PLAIN = "the of and this mit cc by license software under version 3 2 0 4 word prose é日本 public general".split()


def text_of(rng):
    parts = []
    for _ in range(rng.randint(0, 6)):
        line = rng.choice(LINES).split()
        if rng.random() < 0.5:  # damage: words dropped, added or changed
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(line) + 1)
                line[at:at + rng.randint(0, 1)] = rng.choices(PLAIN, k=rng.randint(0, 2))
        parts += rng.choices(PLAIN, k=rng.randint(0, 30)) + line
    return rng.choice([" ", "\n", " * "]).join(parts)


def tokens(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def places(ws, phrase):
    p = phrase.split()
    return [i for i in range(len(ws)) if ws[i:i + len(p)] == p]


def brute(text, holders, n):
    ws = tokens(text)
    base = sorted((i, label) for phrase, label in lic.BASE.items() for i in places(ws, phrase))
    found = []
    for label, wording, phrases in lic.NOTICES:
        t = tokens(wording)
        order = sorted(set(t), key=lambda w: (holders[w], w.encode()))
        keys = sorted(phrases, key=lambda p: min(order.index(w) for w in tokens(p)))
        anchor = min(tokens(keys[0]), key=order.index)
        chosen = {anchor, *order[:8]}
        for start in range(-len(t), len(ws)):
            near = {w for i, w in enumerate(t) if w in chosen and w in ws[max(0, start + i - 4):max(0, start + i + 5)]}
            first = start + places(t, " ".join(tokens(keys[0])))[0]
            if len(near) < min(3, len(chosen)) or first < 0 or ws[first:first + len(tokens(keys[0]))] != tokens(keys[0]):
                continue
            if not all(any(0 <= start + places(t, " ".join(tokens(k)))[0] + d and places(ws, " ".join(tokens(k))).count(start + places(t, " ".join(tokens(k)))[0] + d) for d in range(-4, 5)) for k in keys[1:]):
                continue
            share = sum(w in ws[max(0, start + i - 4):max(0, start + i + 5)] for i, w in enumerate(t)) / len(t)
            if share >= 0.6:
                found.append((label, start, len(t), share))
    b = {label for _, label in base}
    return (len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(b)), ",".join(sorted(b | {f[0] for f in found})),
            max((f[3] for f in found), default=0.0), sorted(found, key=str))


def test_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [*LINES, *[text_of(rng) for _ in range(150)], None, "", " .,;", "mit license " * 3000 + "x" * 50_000, "MIT\nLicense", "GNU general public license"]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(3, LINES[1], "en", 1), (None, LINES[2], "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, score int").repartition(5)
    vocab = {w for _, wording, _ in lic.NOTICES for w in tokens(wording)}
    holders = {w: sum(w in tokens(t) for _, t, _, _ in rows) for w in vocab}
    counted, n = lic.holders(df)
    assert n == len(rows) and {w: counted.get(w.encode(), 0) for w in vocab} == holders
    got = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted([tuple(x) for x in r.notices], key=str)) for r in lic.scan(df).collect()], key=repr)
    assert got == sorted([(i, *brute(t, holders, n)) for i, t, _, _ in rows], key=repr)
    assert lic.scan(df.limit(0)).collect() == []


def test_whole_notices_are_found_and_prose_is_not():
    index = lic.Index(lic.NOTICES, {}, 100)
    for label, wording, _ in lic.NOTICES:
        found = index.find(lic.words("Some words before. " + wording + ". And after."))
        assert any(index.labels[t] == label and start == 3 and share == 1.0 for t, start, share in found)
    assert index.find(lic.words("the general public may use this software under the terms of the license, version 3 " * 50)) == []
