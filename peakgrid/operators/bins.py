"""Signals on fixed-width bins: ``(sample, chrom, bin, v)`` with v = value x 10000.

Signals are sparse (no zero rows). A chromosome of length n has ``n div b + 1``
bins, which is one empty bin more when n is a multiple of b.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import FIX, fixed_divide, fixed_multiply, safe_ratio, to_fixed
from ..functions.tiles import TILE_BINS, by_tile, cut_to_tiles, div, own_rows, spread
from ..session import cut, derived_lookup, lookup
from .intervals import tiled_union
from .reads import FIXED_FRAGMENT, GENOME_ROW, with_genome_row

LOCAL_BINS = 1000
MAPPABLE_THRESHOLD = 0.3
# beyond this distance a Gaussian weight exp(-j^2/2) is below 1e-31 of the centre and moves no fixed-point digit
GAUSS_REACH = 12
# sums that one pass computes beside its own work; more (sample, chromosome) pairs are summed from the stored table
OBSERVED_SUMS = 500


def bin_count(genome: DataFrame, binsize: int) -> DataFrame:
    return lookup(genome).select("chrom", (div("length", binsize) + 1).alias("nbin"))


def tiled(bins: DataFrame, halo: int, genome: DataFrame, binsize: int, tile: int = TILE_BINS,
          keys: Sequence[str] = ("sample", "chrom")) -> DataFrame:
    """Bins shuffled on (keys, tile) with halo copies and the bin count of the chromosome."""
    return by_tile(spread(bins.join(bin_count(genome, binsize), "chrom"), "bin", halo, tile), keys)


def densify(bins: DataFrame, genome: DataFrame, binsize: int, samples: Sequence[str],
            tile: int = TILE_BINS) -> DataFrame:
    """All bins of all chromosomes, zeros included.

    Only one seed row per tile is shuffled beside the signal. Behind the shuffle
    every row is followed by the zeros up to the next one.
    """
    last = F.col("nbin") - 1
    seeds = (bin_count(genome, binsize)
             .withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
             .withColumn("tile", F.explode(F.sequence(F.lit(0), div(last, tile))))
             .select("sample", "chrom", "tile", (F.col("tile") * tile).alias("bin"), F.lit(0).cast("long").alias("v"),
                     F.least(F.col("tile") * tile + (tile - 1), last).alias("_seed_end")))
    data = bins.select("sample", "chrom", div("bin", tile).alias("tile"), "bin", "v", F.lit(None).cast("int").alias("_seed_end"))
    w = Window.partitionBy("sample", "chrom", "tile").orderBy("bin", F.col("_seed_end").desc_nulls_last())
    rows = by_tile(seeds.unionByName(data), ["sample", "chrom"])
    rows = rows.select("sample", "chrom", "bin", "v", F.lead("bin").over(w).alias("_next"), F.max("_seed_end").over(
        w.rowsBetween(Window.unboundedPreceding, 0)).alias("_last"))
    upto = F.coalesce(F.col("_next") - 1, F.col("_last"))
    return (rows.filter(upto >= F.col("bin"))
            .select("sample", "chrom", F.col("bin").alias("_at"), "v", F.explode(F.sequence("bin", upto)).alias("bin"))
            .select("sample", "chrom", "bin", F.when(F.col("bin") == F.col("_at"), F.col("v")).otherwise(0).alias("v")))


# ---- smoothing and local background ---------------------------------------------

def gaussian_weights(n: int) -> tuple[list[float], float]:
    """Weights exp(-j^2/2), j = 0..n, and the factor that makes the symmetric sum 1."""
    w = [math.exp(-j * j / 2.0) for j in range(n + 1)]
    return w, 1.0 / (2.0 * sum(w) - w[0])


def smooth_tiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], n: int,
                 method: str = "gaussian") -> DataFrame:
    """Smooth the value columns of tiled rows (keys, tile, bin, nbin, cols...).

    The bins within reach of a stored one are added as zero rows first, each
    once and behind the shuffle: a row makes the bins before it that its
    predecessor does not reach, and those after it that its successor does not
    make. The smoothed signal then appears where it can be non-zero only.
    """
    keys, cols = list(keys), list(cols)
    reach = n if method == "average" else min(n, GAUSS_REACH)
    w = Window.partitionBy(*keys, "tile").orderBy("bin")
    b = F.col("bin")
    stored = df.select(*keys, "tile", "nbin", *cols, "bin", F.lag("bin").over(w).alias("_prev"), F.lead("bin").over(w).alias("_next"))
    first = F.greatest(b - reach, F.coalesce(F.col("_prev") + 1, F.lit(0)), F.lit(0))
    last = F.greatest(b, F.least(b + reach, F.coalesce(F.col("_next") - reach - 1, b + reach), F.col("nbin") - 1))
    near = (stored.select(*keys, "tile", "nbin", *cols, b.alias("_at"), F.explode(F.sequence(first, last)).alias("bin"))
            .select(*keys, "tile", "nbin", "bin", *[F.when(b == F.col("_at"), F.col(c)).otherwise(0).alias(c) for c in cols]))
    if method == "average":
        frame = w.rangeBetween(-n, n)
        width = F.least(F.col("bin") + n, F.col("nbin") - 1) - F.greatest(F.col("bin") - n, F.lit(0)) + 1
        new = {c: F.when(F.col("nbin") > n, (F.sum(c).over(frame).cast("double") / width).cast("long"))
               .otherwise(F.col(c)) for c in cols}
    else:
        weight, norm = gaussian_weights(n)
        inner = (F.col("bin") >= n) & (F.col("bin") < F.col("nbin") - n)

        def neighbour(c: str, j: int) -> Column:
            return F.when(F.lag("bin", j).over(w) == F.col("bin") - j, F.lag(c, j).over(w)).otherwise(0) \
                + F.when(F.lead("bin", j).over(w) == F.col("bin") + j, F.lead(c, j).over(w)).otherwise(0)

        new = {}
        for c in cols:
            acc = F.lit(weight[0]) * F.col(c)
            for j in range(1, reach + 1):
                acc = acc + F.lit(weight[j]) * neighbour(c, j)
            new[c] = F.when(inner, (acc * F.lit(norm)).cast("long")).otherwise(F.col(c))
    return near.select(*keys, "tile", "bin", "nbin", *[new[c].alias(c) for c in cols])


def _smooth(bins: DataFrame, genome: DataFrame, binsize: int, n: int, method: str, tile: int) -> DataFrame:
    if n <= 0:
        return bins
    t = tiled(bins, 2 * n, genome, binsize, tile)
    out = own_rows(smooth_tiles(t, ["sample", "chrom"], ["v"], n, method), "bin", tile)
    return out.filter(F.col("v") != 0).select("sample", "chrom", "bin", "v")


def smooth_average(bins: DataFrame, genome: DataFrame, binsize: int, n: int, tile: int = TILE_BINS) -> DataFrame:
    """Mean over i-n..i+n inside the chromosome, truncated; skipped when nbin <= n."""
    return _smooth(bins, genome, binsize, n, "average", tile)


def smooth_gaussian(bins: DataFrame, genome: DataFrame, binsize: int, n: int, tile: int = TILE_BINS) -> DataFrame:
    """Gaussian weights over i-n..i+n, truncated; the first and last n bins stay as they are."""
    return _smooth(bins, genome, binsize, n, "gaussian", tile)


def local_sum(keys: Sequence[str], col: str, window: int) -> Column:
    """Sum over [bin - window/2, bin + window/2) as the difference of two running sums."""
    half = window // 2
    w = Window.partitionBy(*keys, "tile").orderBy("bin")
    upto = F.sum(col).over(w.rangeBetween(Window.unboundedPreceding, half - 1))
    below = F.sum(col).over(w.rangeBetween(Window.unboundedPreceding, -half - 1))
    return F.coalesce(upto, F.lit(0).cast("long")) - F.coalesce(below, F.lit(0).cast("long"))


def local_mean(keys: Sequence[str], col: str, window: int) -> Column:
    """Fixed-point local mean: integer quotient by the number of bins inside the chromosome."""
    half = window // 2
    width = F.least(F.col("bin") + half, F.col("nbin")) - F.greatest(F.col("bin") - half, F.lit(0))
    total = local_sum(keys, col, window)
    return ((total - total % width) / width).cast("long")


def local_lambda(bins: DataFrame, genome: DataFrame, binsize: int, window: int = LOCAL_BINS,
                 tile: int = TILE_BINS) -> DataFrame:
    """Local background at every stored bin; works on the sparse signal (zeros add nothing)."""
    keys = ["sample", "chrom"]
    t = tiled(bins, window // 2, genome, binsize, tile)
    t = t.withColumn("lam", local_mean(keys, "v", window))
    return own_rows(t, "bin", tile).select("sample", "chrom", "bin", "v", "lam")


# ---- normalisation -------------------------------------------------------------

def mappability_normalise(bins: DataFrame, mappability: DataFrame, threshold: float = MAPPABLE_THRESHOLD) -> DataFrame:
    """Bins with mappable fraction above the threshold are divided by it; others stay."""
    m = mappability.select("chrom", "bin", F.col("fraction").alias("_m"))
    v = F.when(F.col("_m") > threshold, fixed_multiply(F.col("v"), F.lit(1.0) / F.col("_m"))).otherwise(F.col("v"))
    return bins.join(m, ["chrom", "bin"], "left").select("sample", "chrom", "bin", v.alias("v"))


def scale_factors(counts: DataFrame, norm: str, nrpm: int = 20_000_000, ndepth: float = 1.0) -> DataFrame:
    """Scaling weight ``w`` and normalised read number per (sample, chrom) row.

    ``counts`` has the genome row too (n_nonred, n_nonred_fwd, n_nonred_rev,
    mappable, depth). GR/GD use the genome, CR/CD the chromosome; ``noisy`` marks w > 2.
    """
    whole = Window.partitionBy("sample")
    is_genome = F.col("chrom") == GENOME_ROW

    def of_genome(c: str) -> Column:
        return F.max(F.when(is_genome, F.col(c))).over(whole)

    w = {
        "NONE": F.lit(1.0),
        "GR": safe_ratio(F.lit(float(nrpm)), of_genome("n_nonred")),
        "GD": safe_ratio(F.lit(float(ndepth)), of_genome("depth")),
        "CR": F.when(is_genome, F.lit(0.0)).otherwise(safe_ratio(
            F.lit(float(nrpm)) * safe_ratio(F.col("mappable"), of_genome("mappable")), F.col("n_nonred"))),
        "CD": F.when(is_genome, F.lit(0.0)).otherwise(safe_ratio(F.lit(float(ndepth)), F.col("depth"))),
    }[norm]
    out = counts.withColumn("w", w)
    number = F.col("n_nonred") if norm == "NONE" else (
        fixed_multiply(F.col("n_nonred_fwd"), F.col("w")) + fixed_multiply(F.col("n_nonred_rev"), F.col("w")))
    out = out.withColumn("normalised", number)
    total = F.sum(F.when(~is_genome, F.col("normalised"))).over(whole)
    return (out.withColumn("normalised", F.when(is_genome, total).otherwise(F.col("normalised")))
            .withColumn("noisy", F.col("w") > 2))


def total_read_normalise(bins: DataFrame, factors: DataFrame) -> DataFrame:
    """Every bin x w of its (sample, chrom), truncated."""
    f = derived_lookup(factors.filter(F.col("chrom") != GENOME_ROW).select("sample", "chrom", "w"))
    return bins.join(f, ["sample", "chrom"]).select(
        "sample", "chrom", "bin", fixed_multiply(F.col("v"), F.col("w")).alias("v"))


def signal_total(bins: DataFrame) -> DataFrame:
    """Integer total per chromosome; the genome row adds the truncated totals."""
    s = F.sum("v")
    per = bins.groupBy("sample", "chrom").agg(((s - s % FIX) / FIX).cast("long").alias("total"))
    return with_genome_row(per, ["total"])


def totals_of_stats(stats: DataFrame) -> DataFrame:
    """(sample, chrom, total) of a quality table: its normalised read numbers, genome row included."""
    return stats.select("sample", "chrom", F.col("normalised").cast("long").alias("total"))


def stored_with_totals(bins: DataFrame, genome: DataFrame, samples: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The bins, stored once, and their totals, summed while they were written.

    The sums are taken in the pass that writes, so nothing is read for them. ``samples`` are the
    signals to be summed; totals cover the chromosomes of the genome, those without a
    bin count 0, and the genome row adds the truncated totals.
    """
    chroms = [r["chrom"] for r in genome.select("chrom").collect()]  # one row per chromosome
    keys = [(s, c) for s in samples for c in chroms]
    if len(keys) > OBSERVED_SUMS:
        bins = cut(bins)
        every = genome.select("chrom", F.explode(F.array(*map(F.lit, samples))).alias("sample"))
        per = signal_total(bins).filter(F.col("chrom") != GENOME_ROW).join(every, ["sample", "chrom"], "right")
        return bins, with_genome_row(per.select("sample", "chrom", F.coalesce("total", F.lit(0)).alias("total")), ["total"])
    if not keys:
        return cut(bins), bins.sparkSession.createDataFrame([], "sample string, chrom string, total long")
    seen = Observation()
    sums = [F.sum(F.when((F.col("sample") == s) & (F.col("chrom") == c), F.col("v"))).alias(f"t{i}") for i, (s, c) in enumerate(keys)]
    bins = cut(bins.observe(seen, *sums))
    total = {k: int((seen.get[f"t{i}"] or 0) / FIX) for i, k in enumerate(keys)}
    rows = [(s, c, n) for (s, c), n in total.items()] + [(s, GENOME_ROW, sum(total[s, c] for c in chroms)) for s in samples]
    return bins, bins.sparkSession.createDataFrame(rows, "sample string, chrom string, total long")


def light_stats(bins: DataFrame, genome: DataFrame, flen: int = FIXED_FRAGMENT) -> DataFrame:
    """Totals and depth for a signal without read statistics."""
    size = genome.select("chrom", F.col("length").cast("long").alias("length"))
    whole = size.agg(F.lit(GENOME_ROW).alias("chrom"), F.sum("length").alias("length"))
    return signal_total(bins).join(size.unionByName(whole), "chrom").select(
        "sample", "chrom", "total", safe_ratio(F.col("total") * flen, F.col("length")).alias("depth"))


def chip_input_ratio(bins: DataFrame | None, pairs: DataFrame, norm: int = 0, totals: DataFrame | None = None) -> DataFrame:
    """ChIP / input total ratio per (label, chrom): 0 one, 1 genome totals, 2 chromosome totals.

    ``pairs`` = (label, chip, input); without an input the ratio is 1. ``totals`` = (sample, chrom, total)
    with a genome row spares the pass over the bins.
    """
    totals = signal_total(bins) if totals is None else totals
    c = totals.select(F.col("sample").alias("chip"), "chrom", F.col("total").alias("_c"))
    i = totals.select(F.col("sample").alias("input"), F.col("chrom").alias("_k"), F.col("total").alias("_i"))
    whole = c.filter(F.col("chrom") == GENOME_ROW).select("chip", F.col("_c").alias("_cg"))
    out = (pairs.select("label", "chip", "input").join(c.filter(F.col("chrom") != GENOME_ROW), "chip")
           .join(whole, "chip")
           .withColumn("_k", F.lit(GENOME_ROW) if norm == 1 else F.col("chrom")).join(i, ["input", "_k"], "left"))
    if norm in (1, 2):
        ratio = safe_ratio(F.col("_cg" if norm == 1 else "_c"), F.coalesce("_i", F.lit(0).cast("long")))
        ratio = F.when(F.col("input").isNull(), 1.0).otherwise(ratio)
    else:
        ratio = F.lit(1.0)
    return out.select("label", "chrom", ratio.alias("ratio"))


# ---- distributions -------------------------------------------------------------

def value_histogram(bins: DataFrame, by: Sequence[str] = ("sample", "chrom")) -> DataFrame:
    """Number of bins per stored value."""
    return bins.groupBy(*by, "v").agg(F.count("*").alias("n"))


def nonzero_percentile(bins: DataFrame, p: float, by: Sequence[str] = ("sample", "chrom")) -> DataFrame:
    """Element int(n*p) of the sorted non-zero values, exactly."""
    return histogram_percentile(value_histogram(bins, by), p, by)


def histogram_percentile(hist: DataFrame, p: float, by: Sequence[str] = ("sample", "chrom")) -> DataFrame:
    """The percentile from value counts.

    A coarse histogram finds the 1024-wide value range of the wanted rank, and
    only that range is ranked value by value.
    """
    by = list(by)
    run = Window.unboundedPreceding
    hist = hist.filter(F.col("v") != 0)
    coarse = hist.groupBy(*by, F.shiftright("v", 10).alias("g")).agg(F.sum("n").alias("gn"))
    w = Window.partitionBy(*by)
    ranked = coarse.select(*by, "g", "gn", F.sum("gn").over(w.orderBy("g").rowsBetween(run, 0)).alias("upto"),
                           F.floor(F.sum("gn").over(w) * F.lit(float(p))).alias("k"))
    pick = (ranked.filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("gn") <= F.col("k")))
            .select(*by, "g", (F.col("k") - F.col("upto") + F.col("gn")).alias("k")))
    fine = hist.withColumn("g", F.shiftright("v", 10)).join(pick, [*by, "g"])
    fine = fine.withColumn("_upto", F.sum("n").over(Window.partitionBy(*by).orderBy("v").rowsBetween(run, 0)))
    return (fine.filter((F.col("_upto") > F.col("k")) & (F.col("_upto") - F.col("n") <= F.col("k")))
            .select(*by, F.col("v").alias("percentile")))


def bin_value_distribution(bins: DataFrame, genome: DataFrame, binsize: int, values: int = 200,
                           p: float = 0.95) -> DataFrame:
    """Bins per integer value 0..values-1 below the percentile of the non-zero bins.

    Zero bins are counted from the bin count. Chromosome rows and a genome row.
    """
    by = ["sample", "chrom"]
    values_of = value_histogram(bins)
    cutoff = histogram_percentile(values_of, p)
    nonzero = F.sum(F.when(F.col("v") != 0, F.col("n")).otherwise(0))
    hist = (values_of.filter(F.col("v") >= 0).groupBy(*by, div(F.col("v"), FIX).alias("value")).agg(nonzero.alias("n")))
    stored = values_of.groupBy(*by).agg(nonzero.alias("stored"))
    sizes = stored.join(bin_count(genome, binsize), "chrom")
    zeros = sizes.select(*by, F.lit(0).alias("value"), (F.col("nbin") - F.col("stored")).alias("n"))
    counts = (hist.unionByName(zeros).join(cutoff, by)
              .filter((F.col("value") * FIX < F.col("percentile")) & (F.col("value") < values))
              .groupBy(*by, "value").agg(F.sum("n").alias("n_bins")))
    rows = counts.join(sizes.select(*by, "nbin"), by)
    whole = rows.groupBy("sample", "value").agg(F.sum("n_bins").alias("n_bins"))
    all_bins = sizes.groupBy("sample").agg(F.sum("nbin").alias("nbin"))
    genome_rows = whole.join(all_bins, "sample").withColumn("chrom", F.lit(GENOME_ROW))
    return (rows.unionByName(genome_rows.select(*rows.columns))
            .select(*by, "value", "n_bins", safe_ratio(F.col("n_bins"), F.col("nbin")).alias("prop")))


# ---- grids from other rows ------------------------------------------------------

def rebin(rows: DataFrame, binsize: int) -> DataFrame:
    """Value rows (sample, chrom, start, end half-open, value) on a bin grid.

    A bin takes the unweighted mean of the rows that touch it, in fixed point.
    """
    hit = rows.select("sample", "chrom", to_fixed(F.col("value")).alias("v"),
                      F.explode(F.sequence(div("start", binsize), div(F.col("end") - 1, binsize))).alias("bin"))
    total = hit.groupBy("sample", "chrom", "bin").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return total.select("sample", "chrom", "bin", fixed_divide(F.col("s"), F.col("n").cast("double")).alias("v"))


def bins_to_rows(bins: DataFrame, binsize: int) -> DataFrame:
    """Bins as value rows, the input form of :func:`rebin`."""
    return bins.select("sample", "chrom", (F.col("bin") * binsize).alias("start"),
                       ((F.col("bin") + 1) * binsize).alias("end"), (F.col("v") / float(FIX)).alias("value"))


def bin_mappability(mappable: DataFrame, binsize: int) -> DataFrame:
    """Mappable fraction per bin, four decimals."""
    seg = cut_to_tiles(tiled_union(mappable).select("chrom", "start", "end"), binsize)
    return (seg.groupBy("chrom", F.col("tile").alias("bin"))
            .agg(F.round(F.sum(F.col("end") - F.col("start") + 1) / F.lit(binsize), 4).alias("fraction")))


def longest_chrom(genome: DataFrame) -> DataFrame:
    """Chromosome with the most mappable bases."""
    size = F.coalesce("mappable", F.col("length").cast("long"))
    return genome.agg(F.max_by("chrom", F.struct(size.alias("m"), (-F.col("ord")).alias("tie"))).alias("chrom"),
                      F.max(size).alias("mappable"))
