"""Quality rules against plain Python and numpy."""
import math
import re
from collections import Counter

import numpy as np

from peakgrid.llm import rules

KIND = "doc_id long, text string, lang string, source string"
HARD = ["", None, " \t\n", "one", "two words", "a b c a b c", "a a a a a", "x\x0by\x0cz\rw", "é# $% &| <>* ##", "l1 a\nl1 a\n\n \nl1 a \nb", "a b c d a b c e a b c",
        "Ünï " * 70, "same line\n" * 60, "w " * 40_000, " ".join(f"w{i}" for i in range(20_000))]


def base(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(runs)
    covered = {j for i, r in enumerate(runs) if often[r] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_base_statistics(spark):
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(HARD)], KIND)
    got = {r.doc_id: r for r in rules.quality_rules(df.withColumn("n_words", df.doc_id * 0 - 1).withColumn("kept", df.doc_id)).collect()}
    for i, t in enumerate(HARD):
        r = got[i]
        want = base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:40] if t else t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) for _ in range(int(rng.integers(60, 200)))]
        words = [w.capitalize() + "." if rng.random() < 0.1 else w for w in words]
        if i % 20 == 0:
            words = [w + "##" for w in words]
        texts.append(" ".join(words))
    return texts


def model(z):
    """The same estimates with numpy for one group."""
    floor = np.diag(np.array(rules.FLOOR) ** 2)

    def fit(x):
        c = x.mean(0)
        m = (x.T @ x) / len(x) - np.outer(c, c) + floor
        return c, np.linalg.inv(m), math.log(np.linalg.det(m))

    def dist(x, c, q):
        return np.einsum("ij,jk,ik->i", x - c, q, x - c)

    def quantile(d, share):
        return np.sort(d)[max(0, math.ceil(share * len(d)) - 1)]
    lo, mid, hi = (np.array([quantile(z[:, i], s) for i in range(rules.P)]) for s in (0.25, 0.5, 0.75))
    sd = np.maximum((hi - lo) / 1.349, rules.FLOOR)
    starts = [(mid, np.diag(1 / sd ** 2), 0), fit(mid + sd * np.tanh((z - mid) / sd))]
    out = []
    for s in starts:
        for k in range(rules.STEPS):
            d = dist(z, s[0], s[1])
            s = fit(z[d <= quantile(d, 0.5 if k == 0 else rules.COVER)])
        out.append(s)
    c, q, _ = min(out, key=lambda s: s[2])
    d = dist(z, c, q)
    c, q, _ = fit(z[d * rules.CHI_HALF <= rules.CHI_WEIGHT * quantile(d, 0.5)])
    return dist(z, c, q)


def test_outliers_match_numpy(spark):
    texts = vectors(200, 1)
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], KIND)
    got = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    z = np.array([[math.log(r.word_chars / r.n_words), math.sqrt(r.n_symbols / r.n_words), math.asin(math.sqrt(r.n_upper / r.word_chars)),
                   math.log(0.1 + r.n_marks / r.n_words), math.sqrt(r.n_dup_lines / max(1, r.n_lines)), math.sqrt(r.n_repeat_words / r.n_words)]
                  for r in (got[i] for i in range(200))])
    assert np.allclose([got[i].distance for i in range(200)], model(z), rtol=1e-6, atol=1e-6)
    assert all(got[i].kept == (i % 20 != 0) for i in range(200))


def test_sparse_null_and_repeated(spark):
    texts = vectors(120, 2)
    rows = [(i, t, None if i % 2 else "fr", f"s{i % 30}" if i % 3 else None) for i, t in enumerate(texts)] + [(None, texts[1], None, None), (1, texts[1], None, None)]
    df = spark.createDataFrame(rows, KIND)
    got = rules.quality_rules(df).collect()
    assert len(got) == 122 and sum(not r.kept for r in got) == 6
    good = rules.keep_good(df.withColumn("grp", df.lang).withColumn("z", df.lang))
    assert good.columns == df.columns + ["grp", "z"] and good.count() == 116
    assert rules.quality_rules(df.limit(0)).count() == 0
    assert all(r.kept and r.distance is None for r in rules.quality_rules(df.filter("doc_id < 10 AND doc_id % 20 <> 0").drop("lang", "source")).collect())
