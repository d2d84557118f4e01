"""Operators against plain Python models on random inputs, tiled small so that borders matter."""
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from peakgrid.functions import scores as X
from peakgrid.operators import barcodes as BC
from peakgrid.operators import bins as B
from peakgrid.operators import gc as GC
from peakgrid.operators import genes as G
from peakgrid.operators import intervals as I
from peakgrid.operators import peaks as P
from peakgrid.operators import profiles as PR
from peakgrid.operators import reads as R


@pytest.fixture(scope="module")
def signal(spark):
    """Two samples on 400 bins with gaps, as a dense list per sample and as sparse rows."""
    rnd = random.Random(5)
    dense = {s: [rnd.choice([0, 0, 0, 10000, 20000, 55555, 123456, 400000]) if (i // 40) % 3 else 0 for i in range(401)]
             for s in ("a", "b")}
    sparse = [(s, "c", i, v) for s, vs in dense.items() for i, v in enumerate(vs) if v]
    genome = spark.createDataFrame([("c", 4000, None, 0)], "chrom string, length int, mappable long, ord int")
    return dense, spark.createDataFrame(sparse, "sample string, chrom string, bin int, v long").cache(), genome


def model_gauss(v, n):
    w = [math.exp(-j * j / 2.0) for j in range(n + 1)]
    r = 1 / (sum(w) * 2 - w[0])
    out = list(v)
    for i in range(n, len(v) - n):
        acc = w[0] * v[i]
        for j in range(1, n + 1):
            acc += w[j] * (v[i - j] + v[i + j])
        out[i] = int(acc * r)
    return out


def model_average(v, n):
    if len(v) <= n:
        return list(v)
    out = []
    for i in range(len(v)):
        part = v[max(i - n, 0): i + n + 1]
        out.append(int(sum(part) / len(part)))
    return out


def model_lambda(v, window):
    h = window // 2
    out = []
    for i in range(len(v)):
        lo, hi = max(i - h, 0), min(i + h, len(v))
        out.append(sum(v[lo:hi]) // (hi - lo))
    return out


@pytest.mark.parametrize("n", [1, 5, 20])
@pytest.mark.parametrize("method", ["gaussian", "average"])
def test_smoothing(signal, n, method):
    dense, df, genome = signal
    fn, model = (B.smooth_gaussian, model_gauss) if method == "gaussian" else (B.smooth_average, model_average)
    got = rows(fn(df, genome, 10, n, tile=32), "sample", "bin", "v")
    want = sorted((s, i, x) for s, v in dense.items() for i, x in enumerate(model(v, n)) if x)
    assert got == want


def test_smoothing_is_skipped_on_short_chromosomes(spark):
    genome = spark.createDataFrame([("c", 39, None, 0)], "chrom string, length int, mappable long, ord int")
    df = spark.createDataFrame([("a", "c", 1, 10000), ("a", "c", 3, 20000)], "sample string, chrom string, bin int, v long")
    for fn in (B.smooth_gaussian, B.smooth_average):
        assert rows(fn(df, genome, 10, 5), "bin", "v") == [(1, 10000), (3, 20000)]


@pytest.mark.parametrize("window", [20, 100, 1000])
def test_local_lambda(signal, window):
    dense, df, genome = signal
    got = rows(B.local_lambda(df, genome, 10, window, tile=64), "sample", "bin", "lam")
    want = sorted((s, i, x) for s, v in dense.items() for i, x in enumerate(model_lambda(v, window)) if v[i])
    assert got == want


def ln_pois(k, m):
    return k * math.log(m) - m - math.lgamma(k + 1)


def model_peaks(chip, control, p, window, b):
    lam = model_lambda(chip, window)
    out, open_ = [], None
    for i, (c, d) in enumerate(zip(chip, control)):
        cv, dv, lv = c / 1e4, d / 1e4, lam[i] / 1e4
        pi = -ln_pois(int(cv), lv) / math.log(10) if lv and cv > lv else 0.0
        n1, n2 = math.ceil(cv), math.ceil(dv)
        pe = 0.0
        if n1 >= n2 and n1 + n2:
            pe = -(math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1) - (n1 + n2) * math.log(2)) / math.log(10)
        ratio = cv / dv if d else 0.0
        if pi >= p.p_internal and pe >= p.p_enrich and ratio >= p.ratio and cv >= p.height:
            if open_ is None:
                open_ = dict(start=i * b, end=(i + 1) * b - 1, c=c, i=d, pi=pi, pe=pe, best=i)
                out.append(open_)
            else:
                open_["end"] = (i + 1) * b - 1
                open_["c"] += c
                open_["i"] += d
                if pi > open_["pi"]:
                    open_["pi"], open_["best"] = pi, i
                open_["pe"] = max(open_["pe"], pe)
        else:
            open_ = None
    return out


@pytest.mark.parametrize("tile", [8, 32, 8192])
@pytest.mark.parametrize("params", [P.PeakParams(0.5, 0, 0, 0, 0), P.PeakParams(0.3, 0.2, 0.5, 0, 5), P.PeakParams(0, 0, 2, 5, 2)])
def test_peaks(spark, signal, tile, params):
    dense, df, genome = signal
    pairs = spark.createDataFrame([("S", "a", "b")], "label string, chip string, input string")
    got = P.call_peaks(df, pairs, genome, 10, params, window=100, tile=tile)
    got = P.number_peaks(got, genome).orderBy("peak_no").collect()
    chip = model_gauss(dense["a"], params.smooth) if params.smooth else dense["a"]
    control = model_gauss(dense["b"], params.smooth) if params.smooth else dense["b"]
    want = model_peaks(chip, control, params, 100, 10)
    assert [(r["start"], r["end"], r["length"], r["peak_no"]) for r in got] == [
        (w["start"], w["end"], w["end"] - w["start"], k) for k, w in enumerate(want)]
    for r, w in zip(got, want):
        assert r["summit"] == w["best"] * 10 + 4
        assert r["pileup"] == pytest.approx(w["c"] / 1e4) and r["pileup_input"] == pytest.approx(w["i"] / 1e4)
        assert r["p_internal"] == pytest.approx(w["pi"], abs=1e-9) and r["p_enrich"] == pytest.approx(w["pe"], abs=1e-9)


def test_scores(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 3.0), (5.7, 2.5), (4000.0, 1.0), (1.0, 0.0), (150.0, 3.25)], "v double, m double")
    got = {r["v"]: r["s"] for r in X.with_poisson_score(df, F.col("v"), F.col("m"), "s").collect()}
    assert got[0.0] == 0 and got[3.0] == 0 and got[1.0] == 0
    assert got[5.7] == pytest.approx(-ln_pois(5, 2.5) / math.log(10), abs=1e-9)
    assert got[150.0] == pytest.approx(-ln_pois(150, 3.25) / math.log(10), abs=1e-9)
    assert got[4000.0] == 300


def test_binomial_scales_the_larger_sample(spark):
    df = spark.createDataFrame([(10.0, 4.0, 1.0), (10.0, 4.0, 2.0), (10.0, 9.0, 0.5), (2.0, 5.0, 1.0), (0.0, 0.0, 1.0), (6.0, 6.0, 1.0)],
                               "c double, i double, r double")
    out = X.with_binomial_score(df, F.col("c"), F.col("i"), F.col("r"), "s").collect()

    def want(n1, n2):
        return -(math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1) - (n1 + n2) * math.log(2)) / math.log(10)
    assert [r["s"] for r in out] == pytest.approx([want(10, 4), want(5, 4), want(10, 5), 0, 0, want(6, 6)], abs=1e-9)


def random_intervals(seed, n, top, longest):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        s = rnd.randrange(top)
        out.append((rnd.choice(["x", "y"]), s, s + rnd.randrange(longest)))
    return out


def bases(iv):
    return {(c, p) for c, s, e in iv for p in range(s, e + 1)}


def runs(points):
    out = []
    for c, p in sorted(points):
        if out and out[-1][0] == c and out[-1][2] + 1 == p:
            out[-1][2] = p
        else:
            out.append([c, p, p])
    return [tuple(o) for o in out]


@pytest.mark.parametrize("tile", [16, 64, 65536])
def test_interval_algebra(spark, tile):
    a, b = random_intervals(1, 40, 900, 60), random_intervals(2, 25, 900, 90)
    schema = "chrom string, start int, end int"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    assert rows(I.merge_intervals(da, tile=tile), "chrom", "start", "end") == runs(bases(a))
    assert rows(I.combine(da, db, "subtract", tile=tile), "chrom", "start", "end") == runs(bases(a) - bases(b))
    assert rows(I.combine(da, db, "intersect", tile=tile), "chrom", "start", "end") == runs(bases(a) & bases(b))


@pytest.mark.parametrize("bucket", [16, 50, 4096])
def test_overlaps(spark, bucket):
    a, b = random_intervals(3, 60, 900, 40), random_intervals(4, 20, 900, 120)
    schema = "chrom string, start int, end int"
    da = spark.createDataFrame(a + a[:5], schema)
    db = spark.createDataFrame(b, schema)
    hit = [x for x in a + a[:5] if any(x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2] for y in b)]
    miss = [x for x in a + a[:5] if x not in hit]
    for span in (None, 60):
        assert rows(I.overlaps_any(da, db, span, bucket=bucket), "chrom", "start", "end") == sorted(hit)
        assert rows(I.overlaps_any(da, db, span, bucket=bucket, anti=True), "chrom", "start", "end") == sorted(miss)
    joined = I.overlap_join(da, db.selectExpr("chrom", "start AS s", "end AS e"), bucket, right_span=("s", "e"))
    want = sorted((*x, y[1], y[2]) for x in a + a[:5] for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert rows(joined, "chrom", "start", "end", "s", "e") == want


def test_longer_rows_than_the_usual_bound_are_found(spark):
    schema = "chrom string, start int, end int"
    a = spark.createDataFrame([("x", 0, 100), ("x", 200, 2_000_000_000), ("x", 150, 160)], schema)
    b = spark.createDataFrame([("x", 90, 95), ("x", 1_999_999_999, 2_100_000_000)], schema)
    assert rows(I.overlaps_any(a, b, 50, bucket=16), "start") == [(0,), (200,)]
    assert rows(I.overlaps_any(a, b, 50, bucket=16, anti=True), "start") == [(150,)]


def test_long_interval_among_short_ones(spark):
    """With buckets of one base, an interval over a chromosome could never be dealt to every bucket it touches."""
    short = [("x", 1000 * i, 1000 * i + i % 40) for i in range(300)]
    a = spark.createDataFrame([*short, ("x", 50_000, 2_000_000_000), ("y", 0, 9)], "chrom string, start int, end int")
    b = spark.createDataFrame([("x", 1000 * i + 20, 1000 * i + 20) for i in range(300)] + [("x", 0, 2_000_000_000)], "chrom string, s int, e int")
    got = rows(I.overlap_join(a, b, 1, right_span=("s", "e")), "chrom", "start", "end", "s", "e")
    spans_a, spans_b = [tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]
    assert got == sorted((*p, q[1], q[2]) for p in spans_a for q in spans_b if p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2])


def make_reads(spark, n=3000, hot=0.4):
    """Random reads; a large share sits on one site."""
    rnd = random.Random(9)
    out = []
    for k in range(n):
        strand = rnd.choice("+-")
        pos = 500 if rnd.random() < hot else rnd.randrange(0, 5000)
        out.append(("s", k, "c", "+" if pos == 500 else strand, pos))
    return out, spark.createDataFrame(out, "sample string, read_id long, chrom string, strand string, f3 int")


@pytest.mark.parametrize("threshold", [1, 3])
def test_duplicates(spark, threshold):
    data, df = make_reads(spark)
    seen, want = {}, []
    for s, k, c, st, p in data:
        seen[(st, p)] = seen.get((st, p), 0) + 1
        want.append((k, seen[(st, p)] > threshold))
    assert rows(R.mark_duplicates(df, threshold), "read_id", "duplicate") == sorted(want)
    assert rows(R.nonredundant(df, threshold), "read_id") == sorted((k,) for k, d in want if not d)
    plan = R.nonredundant(df, threshold)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_threshold_per_sample(spark, genome):
    data = [("a", i, "chr1", "+", i % 2) for i in range(600)] + [("b", 1000 + i, "chr1", "+", 7) for i in range(30)]
    df = spark.createDataFrame(data, "sample string, read_id long, chrom string, strand string, f3 int")
    limits = R.duplicate_threshold(df, genome)
    assert rows(limits, "sample", "threshold") == [("a", 4.0), ("b", 1.0)]
    assert rows(R.nonredundant(df, limits), "sample", "read_id") == [("a", i) for i in range(8)] + [("b", 1000)]
    assert rows(R.site_counts(df, limits), "sample", "f3", "n", "n_nonred") == [("a", 0, 300, 4), ("a", 1, 300, 4), ("b", 7, 30, 1)]


@pytest.mark.parametrize("tile", [256, 65536])
def test_strand_shift(spark, tile):
    data, df = make_reads(spark, 1500, 0.2)
    f = {p for *_, st, p in data if st == "+"}
    r = {p for *_, st, p in data if st == "-"}
    got = rows(R.strand_shift_profile(df, -20, 150, tile=tile), "shift", "n_match")
    assert got == [(d, sum(p + d in r for p in f)) for d in range(-20, 151)]


def test_coverage_and_frip(spark):
    data, df = make_reads(spark, 400, 0.3)
    genome = spark.createDataFrame([("c", 5200, None, 0)], "chrom string, length int, mappable long, ord int")
    frags = R.fragments(R.extend(df, 60), genome)
    bed = [("c", 450, 520), ("c", 500, 700), ("c", 3000, 3000)]
    dbed = spark.createDataFrame(bed, "chrom string, start int, end int")
    span = {k: (max(min(p, p + 60 if st == "+" else p - 60), 0), min(max(p, p + 60 if st == "+" else p - 60), 5199))
            for _, k, _, st, p in data}
    covered = {x for s, e in span.values() for x in range(s, e + 1)}
    mask = {p for _, p in bases(bed)}
    got = {r["chrom"]: r for r in R.genome_coverage(frags, I.combine(
        genome.selectExpr("chrom", "0 AS start", "length - 1 AS end"), dbed, "subtract")).collect()}
    assert got["c"]["covered"] == got["Genome"]["covered"] == len(covered - mask)
    assert got["c"]["considered"] == 5200 - len(mask)
    inbed = sum(any(s <= e2 and s2 <= e for _, s2, e2 in bed) for s, e in span.values())
    for bound in (None, 60):
        fr = {r["chrom"]: r for r in R.frip(frags, dbed, bound).collect()}
        assert fr["c"]["n_inbed"] == fr["Genome"]["n_inbed"] == inbed and fr["c"]["n_nonred"] == 400


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95])
def test_percentile(spark, p):
    rnd = random.Random(3)
    vals = [rnd.choice([0, 10000, 20000, 30000, rnd.randrange(1, 10**7)]) for _ in range(700)]
    df = spark.createDataFrame([("s", "c", i, v) for i, v in enumerate(vals)], "sample string, chrom string, bin int, v long")
    nz = sorted(v for v in vals if v)
    assert B.nonzero_percentile(df, p).first()["percentile"] == nz[int(len(nz) * p)]


@pytest.mark.parametrize("tile", [512, 1 << 20])
def test_split_by_gap(spark, tile):
    rnd = random.Random(8)
    data = [(rnd.choice(["b1", "b2", "b3"]), "c", rnd.randrange(0, 20000)) for _ in range(150)] + [("b1", "c", 7)] * 3
    df = spark.createDataFrame(data, "barcode string, chrom string, pos int")
    want = []
    for b in ("b1", "b2", "b3"):
        ps = sorted({p for x, _, p in data if x == b})
        frag = prev = None
        for p in ps:
            if prev is None or p - prev > 400:
                frag = p
            want.append((b, p, frag))
            prev = p
    got = rows(BC.split_by_gap(BC.barcode_positions(df), 400, tile), "barcode", "pos", "frag")
    assert got == sorted(want)


def test_gap_of_exactly_the_threshold_is_no_cut(spark):
    df = spark.createDataFrame([("b", "c", 0), ("b", "c", 100000), ("b", "c", 200001)], "barcode string, chrom string, pos int")
    assert rows(BC.split_by_gap(BC.barcode_positions(df)), "pos", "frag") == [(0, 0), (100000, 0), (200001, 200001)]


def test_nearest_tss(spark):
    rnd = random.Random(12)
    genes = [("c", str(i), rnd.choice("+-"), s, s + 30) for i, s in enumerate(rnd.sample(range(50000), 20))]
    bed = [("c", s, s + 9, str(i)) for i, s in enumerate(rnd.sample(range(60000), 50))]
    g = spark.createDataFrame(genes, "chrom string, tid string, strand string, tx_start int, tx_end int")
    b = spark.createDataFrame(bed, "chrom string, start int, end int, name string")
    tss = [s if st == "+" else e for _, _, st, s, e in genes]
    want = sorted((n, min(abs((s + e) // 2 - t) for t in tss)) for _, s, e, n in bed)
    assert rows(G.nearest_tss(b, g, 1024), "name", "tss_distance") == want


def test_global_rank(spark):
    rnd = random.Random(2)
    data = [(str(i), float(rnd.randrange(30))) for i in range(300)]
    df = spark.createDataFrame(data, "site string, v double")
    got = PR.global_rank(df, [F.col("v").desc(), F.col("site").asc()], "k", parts=7).collect()
    want = {s: i for i, (s, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])))}
    assert {r["site"]: r["k"] for r in got} == want


@pytest.mark.parametrize("tile, fan", [(8, 2), (64, 4), (8192, 16)])
def test_range_totals_and_maxima(spark, tile, fan):
    """Against the exploded form; ranges from one bin to the whole chromosome, ranges without signal, backward ranges."""
    rnd = random.Random(21)
    data = [(label, chrom, b, round(rnd.random() * 100 - 20, 4)) for label in "xy" for chrom in "cd" for b in rnd.sample(range(1000), 250)]
    spans = [(rnd.choice("cd"), a, min(a + rnd.choice([0, 1, 7, 63, 64, 300, 999]), 1200)) for a in (rnd.randrange(1100) for _ in range(120))]
    spans += [("c", 0, 999), ("c", 0, 0), ("d", 1100, 1150), ("c", 9, 3), ("none", 0, 5), ("c", 0, 999)]
    values = spark.createDataFrame(data, "label string, chrom string, bin int, value double")
    ranges = spark.createDataFrame(spans, "chrom string, sbin int, ebin int")
    inside = {(label, c, s, e): [v for x, k, b, v in data if (x, k) == (label, c) and s <= b <= e] for label in "xy" for c, s, e in spans if e >= s}
    got = {(r.label, r.chrom, r.sbin, r.ebin): r.total for r in PR.range_totals(ranges, values, ["x", "y"], tile).collect()}
    assert got == {k: pytest.approx(sum(v), abs=1e-9) for k, v in inside.items()} and all(got[k] == 0 for k, v in inside.items() if not v)
    top = {(r.label, r.chrom, r.sbin, r.ebin): r.top for r in PR.range_maxima(ranges, values, fan, 4).collect()}
    assert top == {k: max(v) for k, v in inside.items() if v}


def test_long_range_is_not_exploded(spark):
    """A range over ten million bins costs two points, or a few blocks for the maximum."""
    values = spark.createDataFrame([("x", "c", 5, 2.0), ("x", "c", 9_999_999, 3.0)], "label string, chrom string, bin int, value double")
    ranges = spark.createDataFrame([("c", 1, 9_999_999)], "chrom string, sbin int, ebin int")
    totals = PR.range_totals(ranges, values, ["x"])
    assert totals.first().total == 5.0 and "sequence(" not in totals._jdf.queryExecution().toString()
    assert PR.range_maxima(ranges, values).first().top == 3.0


@pytest.mark.parametrize("tile", [4, 64, 8192])
def test_mark_track(spark, tile):
    """Against the exploded form; the user's list replaces the called peaks of its sample only."""
    rnd = random.Random(31)
    spans = {who: [(s, c, p, p + rnd.choice([0, 5, 99, 100, 900])) for s in names for c in "cd" for p in rnd.sample(range(6000), 6)] for who, names in (("called", "ab"), ("user", "b"))}
    track = [(s, c, b, s + c) for s in "abz" for c in "cde" for b in range(0, 80, rnd.choice([1, 2]))]
    kind = "sample string, chrom string, start int, end int"
    called, user = (spark.createDataFrame(spans[k], kind) for k in ("called", "user"))
    df = spark.createDataFrame(track, "sample string, chrom string, bin int, note string")
    for mine, source in ((None, {"a": "called", "b": "called", "z": "called"}), (user, {"a": "called", "b": "user", "z": "called"})):
        want = sorted((s, c, b, any(x == s and k == c and p // 100 <= b <= e // 100 for x, k, p, e in spans[source[s]]), note) for s, c, b, note in track)
        assert rows(P.mark_track(df, called, 100, mine, tile), "sample", "chrom", "bin", "in_peak", "note") == want


def test_annotation_equals_the_hits(spark):
    """Statuses, genes and numbers of hits without making the hits; flanks meet the start of the chromosome, names repeat and are null."""
    rng = random.Random(11)
    beds = [(rng.choice("ab"), s, s + rng.choice([0, 1, 5, 40, 300]), f"n{i}") for i, s in enumerate(rng.choices(range(900), k=120))]
    beds += [(None, 1, 5, "x"), ("a", None, 5, "y"), ("c", 5, 9, "z"), beds[0]]
    genes = []
    for i in range(60):
        s = rng.randrange(1000)
        genes.append((rng.choice("ab"), rng.choice([f"t{i}", "t1", None]), "g", rng.choice(["+", "-", None]), s, s + rng.choice([0, 3, 50, 200])))
    genes += [("a", "no end", "g", "+", 10, None), (None, "no chrom", "g", "+", 10, 20), ("a", "no start", "g", "+", None, 30), genes[0]]
    bed = spark.createDataFrame(beds, "chrom string, start int, end int, name string")
    tx = spark.createDataFrame(genes, "chrom string, tid string, gname string, strand string, tx_start int, tx_end int")
    hits = {}
    for r in G.interval_gene_hits(bed.distinct(), tx, 60, 25).collect():
        hits.setdefault(r.name, []).append((G.STATUSES.index(r.status), r.tid or ""))
    want = sorted((b[3], *((G.STATUSES[max(h)[0]], max(h)[1], len(h)) if (h := hits.get(b[3])) else ("INTERGENIC", "", 0))) for b in beds)
    got = G.annotate_intervals(bed, tx, 60, 25)
    assert sorted(tuple(r) for r in got.select("name", "status", "tid", "n_hits").collect()) == want
    assert len({w[1] for w in want}) == 4


def test_stab_max_and_counts(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), s, s + rng.choice([0, 7, 64, 513]), i) for i, s in enumerate(rng.choices(range(-20, 1200), k=80))]
    asked = [(c, p) for c in "abc" for p in range(-30, 1800, 7)]
    df = spark.createDataFrame(spans, "chrom string, start long, end long, v long")
    points = spark.createDataFrame(asked, "chrom string, pos long")
    over = {(c, p): [v for d, s, e, v in spans if d == c and s <= p <= e] for c, p in asked}
    for fan in (2, 8):
        got = {(r.chrom, r.pos): r.v for r in I.stab_max(df, points, "v", fan=fan).collect()}
        assert got == {k: max(v) for k, v in over.items() if v}
    begun = {(r.chrom, r.pos): r.n for r in I.count_up_to(df.select("chrom", F.col("start").alias("pos")), points, tile=100).collect()}
    assert begun == {(c, p): sum(d == c and s <= p for d, s, _, _ in spans) for c, p in asked}


def test_long_intervals_meet_few_that_do_not_overlap(spark):
    """A long interval is cut into a quarter of its length or less, so that short ones meet it only near by; homes without visitors have no rows."""
    long = spark.createDataFrame([("a", 32_768 * i + 20_000, 32_768 * i + 33_000) for i in range(40)], "chrom string, s int, e int")
    short = spark.createDataFrame([("a", p, p + 99) for p in range(0, 1_300_000, 100)], "chrom string, start int, end int")
    met = I._meetings(short, long, right_span=("s", "e")).count()
    n = I.overlap_join(short, long, right_span=("s", "e")).count()
    assert n == sum(1 for p in range(0, 1_300_000, 100) for i in range(40) if p <= 32_768 * i + 33_000 and p + 99 >= 32_768 * i + 20_000)
    assert n <= met < 2 * n


def test_chunks_are_counted_a_slice_at_a_time(spark, monkeypatch):
    """More chunks than a slice holds: whole windows and single places, in any split of the batch."""
    text = "ACGTNGGCCATT" * 9
    chunks = GC.chunk_sequences(spark.createDataFrame([("a", text), ("b", text[5:] + "G")], "chrom string, seq string"), 4).coalesce(1)
    want = sorted((c, i, -1 if "N" in s[i + 1:i + 4] else sum(x in "GC" for x in s[i + 1:i + 4])) for c, s in (("a", text), ("b", text[5:] + "G")) for i in range(len(s)))
    places = spark.createDataFrame([(c, p) for c, p, _ in want if p % 5 == 0], "chrom string, pos int")
    for n in (1, 7, 1000):
        monkeypatch.setattr(GC, "SLICE", n)
        assert rows(GC.gc_windows(chunks, 3, 4), "chrom", "pos", "gc") == want
        assert rows(GC.gc_at_positions(chunks, places, 3, 4), "chrom", "pos", "gc") == [x for x in want if x[1] % 5 == 0]


def test_heatmap_rows_are_not_shuffled_one_by_one(spark):
    """A packed profile is ranked before its rows are made, with the rows of the long one."""
    genome = spark.createDataFrame([("c", 40_000, None, 0)], "chrom string, length int, mappable long, ord int")
    bins = spark.createDataFrame([("chip", "c", i, 10_000 * (i % 7)) for i in range(400) if i % 3], "sample string, chrom string, bin int, v long")
    pairs = spark.createDataFrame([("L", "chip", None)], "label string, chip string, input string")
    bed = spark.createDataFrame([("c", s, s + 301) for s in (1000, 1000, 5000, 9000, 9100, 39_000)], "chrom string, start int, end int")
    long = PR.heatmap_order(PR.profile_sites(bed, bins, pairs, genome, 100, 500), "L", 3.0, 1)
    packed = PR.heatmap_order(PR.profile_sites(bed, bins, pairs, genome, 100, 500, packed=True), "L", 3.0, 1)
    cols = ("label", "chrom", "site", "offset", "value", "row_rank")
    assert rows(packed, *cols) == rows(long, *cols) and packed.count() == 66
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Join")


def test_left_rows_meet_the_right_side_in_blocks(spark, monkeypatch):
    """Rows that start close together travel as one, at most BLOCK_ROWS of them; long ones among them and null ends change nothing."""
    monkeypatch.setattr(I, "BLOCK_ROWS", 64)
    left = [("a", 3 * i, 3 * i + 50 + i % 90, i) for i in range(400)] + [("a", 700, 720, 1000 + i) for i in range(200)] + [("a", 5, 90_000, 2000), ("a", None, 9, 2001), ("a", 9, None, 2002), (None, 1, 9, 2003)]
    right = [("a", 11 * i, 11 * i + 400, f"r{i}") for i in range(90)] + [("a", None, 800, "none"), (None, 1, 9, "none")]
    a = spark.createDataFrame(left, "chrom string, start int, end int, n int")
    b = spark.createDataFrame(right, "chrom string, s int, e int, name string")
    blocks = I._blocks(a, I.BUCKET_BP, ["chrom"], ("start", "end"), 4).collect()
    assert max(len(x["_rows"]) for x in blocks) == 64 and len(blocks) < 20
    joined = I.overlap_join(a, b, right_span=("s", "e"))
    assert joined.columns == ["chrom", "start", "end", "n", "s", "e", "name"]
    want = sorted((x[3], y[3]) for x in left for y in right if None not in (*x, *y) and x[1] <= y[2] and y[1] <= x[2])
    assert rows(joined, "n", "name") == want
