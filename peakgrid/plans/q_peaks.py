"""Peak queries."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import bins as B
from ..operators import peaks as P
from ..operators import reads as R
from ..operators.bins import gaussian_weights
from .adapters import BIN, FLEN
from .registry import query, r6


def peak_cols() -> list:
    return ["chrom", "start", "end", "length", "summit",
            *[r6(c) for c in ("pileup", "pileup_input", "enrichment", "p_internal", "p_enrich")]]


def gauss_sql(col: str, n: int, last: int = 10000) -> str:
    w, r = gaussian_weights(n)
    terms = f"{w[0]!r}::DOUBLE * {col}"
    for j in range(1, n + 1):
        terms += f" + {w[j]:.17e}::DOUBLE * (lag({col}, {j}) OVER w + lead({col}, {j}) OVER w)"
    return (f"CASE WHEN bin >= {n} AND bin <= {last - n} THEN trunc(({terms}) * {r:.17e}::DOUBLE)::BIGINT"
            f" ELSE {col} END")


def sided_sql(smooth: int) -> str:
    """Dense ChIP / input pairs, smoothed, with the local background and scores."""
    c, i = (gauss_sql("c", smooth), gauss_sql("i", smooth)) if smooth else ("c", "i")
    return f"""+ sided0 AS (SELECT chrom, bin, (sum(v) FILTER (WHERE smp = 'chip'))::BIGINT AS c, (sum(v) FILTER (WHERE smp = 'input'))::BIGINT AS i
 FROM dense GROUP BY chrom, bin),
sided1 AS (SELECT chrom, bin, {c} AS c, {i} AS i FROM sided0 WINDOW w AS (PARTITION BY chrom ORDER BY bin)),
sided AS (SELECT *, (sum(c) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING))::BIGINT
 // (least(bin + 500, 10001) - greatest(bin - 500, 0)) AS lam FROM sided1)"""


SCORES = """, scored AS (SELECT *, c / 1e4 AS cv, i / 1e4 AS iv, ceil(c / 1e4) AS n1, ceil(i * ratio / 1e4) AS n2,
 trunc(c / 1e4) AS k FROM sided),
scores AS (SELECT chrom, bin, c, i, cv, iv, lam,
 CASE WHEN lam > 0 AND c > lam THEN -(k * ln(lam / 1e4) - lam / 1e4 - lgamma(k + 1)) / ln(10) ELSE 0 END AS pint,
 CASE WHEN n1 < n2 OR n1 + n2 = 0 THEN 0 ELSE
  -(lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1) - (n1 + n2) * ln(2)) / ln(10) END AS penr,
 CASE WHEN i <> 0 THEN cv / iv * ratio ELSE 0 END AS enr FROM scored)"""

RUNS = """, sig AS (SELECT *, bin - row_number() OVER (PARTITION BY chrom ORDER BY bin) AS run FROM scores WHERE {cond}),
peaks AS (SELECT chrom, min(bin) * 100 AS "start", (max(bin) + 1) * 100 - 1 AS "end",
 (max(bin) + 1) * 100 - 1 - min(bin) * 100 AS length,
 first(bin ORDER BY pint DESC, bin) * 100 + 49 AS summit,
 round(sum(cv), 6) AS pileup, round(sum(iv), 6) AS pileup_input,
 round(CASE WHEN sum(i) > 0 THEN sum(c)::DOUBLE / sum(i)::DOUBLE ELSE 0 END, 6) AS enrichment,
 round(max(pint), 6) AS p_internal, round(max(penr), 6) AS p_enrich FROM sig GROUP BY chrom, run)"""


def params(mode: str) -> P.PeakParams:
    """Mode with score thresholds that the driver tables can reach (ChIP and input are alike there)."""
    p = P.peak_presets(mode)
    return replace(p, p_internal=min(p.p_internal, 3), p_enrich=min(p.p_enrich, 1))


def peaks_sql(mode: str) -> str:
    p = params(mode)
    cond = f"pint >= {p.p_internal} AND penr >= {p.p_enrich} AND enr >= {p.ratio} AND cv >= {p.height}"
    return sided_sql(p.smooth) + SCORES.replace("ratio", "1.0::DOUBLE") + RUNS.format(cond=cond)


@query("peaks_sharp", "dense", peaks_sql("SHARP") + """
SELECT peaks.*, row_number() OVER (ORDER BY chrom, "start") - 1 AS peak_no FROM peaks""")
def peaks_sharp(t):
    peaks = P.call_peaks(t.bins, t.pairs, t.genome, BIN, params("SHARP"))
    return P.number_peaks(peaks, t.genome).select(*peak_cols(), "peak_no")


@query("peaks_broad", "dense", peaks_sql("BROAD") + " SELECT * FROM peaks")
def peaks_broad(t):
    return P.call_peaks(t.bins, t.pairs, t.genome, BIN, params("BROAD")).select(*peak_cols())


@query("peaks_enrich", "dense", peaks_sql("ENRICH") + " SELECT * FROM peaks")
def peaks_enrich(t):
    return P.call_peaks(t.bins, t.pairs, t.genome, BIN, params("ENRICH")).select(*peak_cols())


@query("peaks_global_ratio", "dense", peaks_sql("GV") + " SELECT * FROM peaks")
def peaks_global_ratio(t):
    return P.call_peaks(t.bins, t.pairs, t.genome, BIN, params("GV")).select(*peak_cols())


SCALED = (""", scored AS (SELECT *, c / 1e4 AS cv, i / 1e4 AS iv, CASE WHEN r > 1 THEN ceil(c / 1e4 / r) ELSE ceil(c / 1e4) END AS n1,
 CASE WHEN r > 1 THEN ceil(i / 1e4) ELSE ceil(i / 1e4 * r) END AS n2, trunc(c / 1e4) AS k, r AS ratio FROM sided, r)"""
          + SCORES[SCORES.index(",\nscores"):] + RUNS.format(cond="pint >= 3 AND penr >= 1") + " SELECT * FROM peaks")
RATIO = ", r AS (SELECT a.t / b.t AS r FROM totals a, totals b WHERE a.smp = 'chip' AND b.smp = 'input')"


@query("peaks_scaled", "dense", sided_sql(5) + """, totals AS (SELECT smp, (sum(t))::DOUBLE AS t FROM
 (SELECT smp, chrom, sum(v)::BIGINT // 10000 AS t FROM bins GROUP BY ALL) GROUP BY smp)""" + RATIO + SCALED)
def peaks_scaled(t):
    bins, totals = B.stored_with_totals(t.bins, t.genome, ["chip", "input"])
    ratios = B.chip_input_ratio(None, t.pairs, 1, totals)
    return P.call_peaks(bins, t.pairs, t.genome, BIN, params("SHARP"), ratios=ratios).select(*peak_cols())


@query("peaks_scaled_by_reads", "dense", sided_sql(5) + """, totals AS (SELECT smp, count(*)::DOUBLE AS t FROM nonred GROUP BY smp)"""
       + RATIO + SCALED)
def peaks_scaled_by_reads(t):
    totals = B.totals_of_stats(B.scale_factors(R.read_depth(R.read_counts(t.reads, t.genome), FLEN), "NONE"))
    ratios = B.chip_input_ratio(None, t.pairs, 1, totals)
    return P.call_peaks(t.bins, t.pairs, t.genome, BIN, params("SHARP"), ratios=ratios).select(*peak_cols())


@query("peaks_chip_only", "dense", sided_sql(5) + SCORES.replace("ratio", "1.0::DOUBLE") + RUNS.format(cond="pint >= 3") + """
SELECT chrom, "start", "end", length, summit, pileup, 0.0::DOUBLE AS pileup_input, 0.0::DOUBLE AS enrichment,
 p_internal FROM peaks""")
def peaks_chip_only(t):
    p = P.call_peaks_chip_only(t.bins, t.pairs, t.genome, BIN, params("SHARP"))
    return p.select("chrom", "start", "end", "length", "summit", r6("pileup"), r6("pileup_input"), r6("enrichment"),
                    r6("p_internal"))


@query("peaks_in_view", "dense", peaks_sql("SHARP") + """
SELECT chrom, greatest("start", 200000) AS "start", least("end", 700000) AS "end", summit FROM peaks
WHERE "start" <= 700000 AND "end" >= 200000""")
def peaks_in_view(t):
    peaks = P.call_peaks(t.bins, t.pairs, t.genome, BIN, params("SHARP"))
    return P.mark_peaks(peaks, peaks, 200000, 700000).select("chrom", "start", "end", "summit")


@query("tracks_marked_peaks", "dense", peaks_sql("SHARP") + """
SELECT chrom, bin, EXISTS (SELECT 1 FROM peaks p WHERE p.chrom = b.chrom AND p."start" < (b.bin + 1) * 100 AND p."end" >= b.bin * 100) AS in_peak
FROM bins b WHERE smp = 'chip'""")
def tracks_marked_peaks(t):
    peaks = P.call_peaks(t.bins, t.pairs, t.genome, BIN, params("SHARP"))
    track = t.bins.filter("sample = 'chip'").select(F.lit("S1").alias("sample"), "chrom", "bin")
    return P.mark_track(track, peaks, BIN).select("chrom", "bin", "in_peak")
