"""URL rules against plain Python; the character models against held-out urls."""
import math
import re
from collections import Counter

import numpy as np

from peakgrid.llm import urls

KIND = "page_id long, url string"
ODD = [None, "", "no scheme/net/", "http://", "http://net", "http://net/", "HTTP://WWW.A.NET/x", "http://example.net/en/a?b#c", "http://example.net/en", "http://a.example.net/en/", "http://notexample.net/en/",
       "http://example.com/de/", "http://xexample.com/de/", "http://a.org/fr/x", "http://a.org/fr?/fr/", "ftp://net:80/x", "x://y://z/", "http://a.org#/fr/", "http://É.NET/ü", "http://a.net/\nb?c"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    got = {r.id: r for r in urls.judge(spark.createDataFrame(list(enumerate(ODD)), KIND)).collect()}
    for i, u in enumerate(ODD):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert verdict is None or got[i].verdict == verdict
        assert got[i].verdict in ("allow", "block")


def grams(text):
    """(context, sign) of every order."""
    t = "^" * urls.ORDER + text
    return [(t[i - k:i], t[i]) for i in range(urls.ORDER, len(t)) for k in range(urls.ORDER + 1)]


def model(rows, contexts):
    """Plain form: kept contexts and a function for the probability of a sign behind a context."""
    seen = {v: Counter() for v in ("allow", "block")}
    for s, v, n in rows:
        for g in grams(s):
            seen[v][g] += n
    both = Counter()
    for v in seen:
        for (c, _), n in seen[v].items():
            both[c] += n
    counts = sorted((n for c, n in both.items() if c), reverse=True)
    cut = 1 if len(counts) <= contexts else counts[contexts] + 1
    kept = {c for c, n in both.items() if not c or n >= cut}

    def p(v, c, x):
        out = 1 / len(urls.SIGNS)
        for k in range(len(c) + 1):
            own = {y: n for (d, y), n in seen[v].items() if d == c[len(c) - k:]}
            if own:
                out = (own.get(x, 0) + len(own) * out) / (sum(own.values()) + len(own))
        return out
    return kept, p


EXAMPLES = [("ab.c", "allow", 3), ("abab", "allow", 1), ("xa.c", "block", 2), ("bb", "block", 1), ("bbb0", "block", 1), ("abab", "block", 2)]


def test_ratios_and_scores_equal_plain_models(spark, monkeypatch):
    examples = spark.createDataFrame(EXAMPLES, "s string, verdict string, n long")
    for contexts in (5_000, 6):
        monkeypatch.setattr(urls, "CONTEXTS", contexts)
        kept, p = model(EXAMPLES, contexts)
        assert all(c[1:] in kept for c in kept if c)
        want = {c + x: math.log(p("allow", c, x) / p("block", c, x)) for c in kept for x in urls.SIGNS}
        table = urls.ratios(examples)
        got = {r.w: r.ratio for r in table.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[w], want[w], rel_tol=1e-9, abs_tol=1e-12) for w in want)
        texts = ["ab.c", "zzz", "abzab", "b", "xaxaxa", "", "bbbbbbbbb/~0"]
        scored = {r.key: r.score for r in urls.scores(spark.createDataFrame([(t,) for t in texts], "s string"), table).collect()}
        for t in filter(None, texts):
            padded = "^" * urls.ORDER + t
            longest = [next(padded[i - k:i + 1] for k in range(urls.ORDER, -1, -1) if padded[i - k:i] in kept) for i in range(urls.ORDER, len(padded))]
            assert math.isclose(scored[t], sum(want[w] for w in longest) / len(t), rel_tol=1e-9, abs_tol=1e-12), t
    one_sided = spark.createDataFrame(EXAMPLES[:2], "s string, verdict string, n long")
    assert urls.ratios(one_sided).count() == 0 and urls.ratios(examples.limit(0)).count() == 0


def test_threshold_has_the_smallest_balanced_error(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), int(rng.integers(0, 5)), int(rng.integers(0, 2))) for x in rng.normal(0.3, 1, 80)]
    rows += [(float(x), int(rng.integers(0, 2)), int(rng.integers(0, 5))) for x in rng.normal(-0.3, 1, 80)]
    cut = urls.threshold(spark.createDataFrame(rows, "score double, allowed long, blocked long")).first().cut
    a, b = sum(r[1] for r in rows), sum(r[2] for r in rows)

    def error(at):
        return sum(r[1] for r in rows if math.floor(r[0] / urls.BINS) < at) / a + sum(r[2] for r in rows if math.floor(r[0] / urls.BINS) >= at) / b
    edges = {math.floor(r[0] / urls.BINS) for r in rows} | {0}
    assert math.isclose(error(round(cut / urls.BINS)), min(map(error, edges)), abs_tol=1e-8)


def test_verdicts_do_not_depend_on_the_order_of_rows(spark):
    """Two rows with one folded string and different rules count for both models, wherever they stand."""
    rows = [(1, "http://a.net/9"), (2, "http://a.org/fr/1"), (3, "HTTP://x1.example.net/en/"), (4, "http://x2.EXAMPLE.net/en/"), (5, "http://b.info/")]
    rows += [(10 + i, f"http://a{i % 7}.example.com/{'de/' if i % 2 else 'DE/'}") for i in range(40)]
    results = []
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, KIND).coalesce(1)
        results.append(sorted((r.id, r.verdict, round(r.score, 9)) for r in urls.judge(df).collect()))
    assert results[0] == results[1]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "h", "p", "v", 5)], "page_id long, url string, host string, path string, verdict string, s int")
    assert [(r.id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()] == [(1, "a.net", "/x", "net/", "block")]


def test_method_separates_unseen_urls(spark):
    rng = np.random.default_rng(1)

    def name(letters):
        return "".join(rng.choice(list(letters), 8))
    rows = [(i, f"http://{name('abcde')}.org/fr/{name('abcde')}") for i in range(200)] + [(i, f"http://{name('vwxyz')}.net/{name('vwxyz')}") for i in range(200, 400)]
    rows += [(i, f"http://{name('abcde')}.info/{name('abcde')}") for i in range(400, 500)] + [(i, f"http://{name('vwxyz')}.info/{name('vwxyz')}") for i in range(500, 600)]
    got = {r.id: r.verdict for r in urls.judge(spark.createDataFrame(rows, KIND)).collect()}
    assert np.mean([got[i] == ("allow" if i < 500 else "block") for i in range(400, 600)]) > 0.97


def test_empty_repeated_and_one_sided(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://a.info/x"), (2, "y" * 50_000)], KIND + "")
    got = urls.judge(df).collect()
    assert len(got) == 4 and all(r.verdict == "allow" for r in got if r.rule is None)
    assert urls.judge(df.limit(0)).collect() == []


def test_every_context_of_the_examples_is_kept(spark):
    """More than 5,000 contexts, the number that was kept before: rare ones count as well."""
    rng = np.random.default_rng(3)
    rows = [("".join(rng.choice(list("abcdefghijklmnop"), 30)), ("allow", "block")[i % 2], 1 + i % 3) for i in range(260)]
    kept, _ = model(rows, 10 ** 9)
    assert len(kept) > 5_001
    table = urls.ratios(spark.createDataFrame(rows, "s string, verdict string, n long"))
    assert {r.c for r in table.selectExpr("substring(w, 1, length(w) - 1) AS c").distinct().collect()} == kept
