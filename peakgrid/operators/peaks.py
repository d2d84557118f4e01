"""Peak calling on ChIP / control bins."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_fixed, safe_ratio
from ..functions.scores import evaluate_once, scaled_ratio, with_binomial_score, with_poisson_score
from ..functions.tiles import TILE_BINS, by_tile, div, own_rows, spread, stitch
from ..session import cut, derived_lookup, lookup
from .bins import LOCAL_BINS, bin_count, local_mean, smooth_tiles
from .intervals import tiled_union


@dataclass(frozen=True)
class PeakParams:
    """Thresholds of a mode: internal score, enrichment score, ratio, height, smoothing."""
    p_internal: float
    p_enrich: float
    ratio: float
    height: float
    smooth: int


PRESETS = {
    "SHARP": PeakParams(5, 4, 0, 0, 5),
    "BROAD": PeakParams(4, 3, 0, 0, 20),
    "ENRICH": PeakParams(0, 0, 2, 5, 5),
    "GV": PeakParams(0, 0, 2, 0, 0),
}  # fixed values: thresholds of the four modes


def peak_presets(mode: str) -> PeakParams:
    return PRESETS[mode]


def pair_bins(bins: DataFrame, pairs: DataFrame) -> DataFrame:
    """ChIP and input of every pair side by side: (label, chrom, bin, c, i), sparse, one row per side.

    ``pairs`` = (label, chip, input); an input shared by several pairs is read once
    and copied to each.
    """
    zero = F.lit(0).cast("long")
    roles = pairs.select("label", F.explode(F.array(
        F.struct(F.col("chip").alias("sample"), F.lit(True).alias("is_chip")),
        F.struct(F.col("input").alias("sample"), F.lit(False).alias("is_chip")))).alias("r"))
    roles = roles.select("label", "r.*").filter(F.col("sample").isNotNull())
    return (bins.join(lookup(roles), "sample")
            .select("label", "chrom", "bin", F.when(F.col("is_chip"), F.col("v")).otherwise(zero).alias("c"),
                    F.when(~F.col("is_chip"), F.col("v")).otherwise(zero).alias("i")))


def scored_bins(bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int, smooth: int = 0,
                method: str = "gaussian", window: int = LOCAL_BINS, ratios: DataFrame | None = None,
                tile: int = TILE_BINS, keep_zero: bool = False) -> DataFrame:
    """Smoothed signals, local background and scores of every bin with ChIP signal.

    One shuffle on (label, chrom, tile) serves pairing, smoothing and the local
    mean; the halo covers both windows. ``ratios`` = (label, chrom, ratio).
    Columns: label, chrom, tile, bin, c, i, lam (fixed point), ratio, p_internal,
    p_enrich, enrichment.
    """
    keys = ["label", "chrom"]
    halo = window // 2 + 2 * smooth
    sided = pair_bins(bins, pairs).join(bin_count(genome, binsize), "chrom")
    t = (by_tile(spread(sided, "bin", halo, tile), keys)
         .groupBy(*keys, "tile", "bin").agg(F.first("nbin").alias("nbin"), F.sum("c").alias("c"), F.sum("i").alias("i")))
    if smooth:
        t = smooth_tiles(t, keys, ["c", "i"], smooth, method)
    t = own_rows(t.withColumn("lam", local_mean(keys, "c", window)), "bin", tile)
    if not keep_zero:
        t = t.filter(F.col("c") > 0)
    if ratios is not None:
        t = t.join(derived_lookup(ratios.select("label", "chrom", "ratio")), keys)
    else:
        t = t.withColumn("ratio", F.lit(1.0))
    c, i = from_fixed(F.col("c")), from_fixed(F.col("i"))
    t = t.withColumn("enrichment", scaled_ratio(c, i, F.col("ratio")))
    t = with_poisson_score(t, c, from_fixed(F.col("lam")), "p_internal")
    t = with_binomial_score(t, c, i, F.col("ratio"), "p_enrich")
    t = t.select(*keys, "tile", "bin", "c", "i", "lam", "ratio", "p_internal", "p_enrich", "enrichment")
    return evaluate_once(t, "p_internal", "p_enrich")


def significant(scored: DataFrame, params: PeakParams, chip_only: bool = False) -> DataFrame:
    """Bins that pass every threshold of the mode."""
    keep = (F.col("p_internal") >= params.p_internal) & (from_fixed(F.col("c")) >= params.height)
    if not chip_only:
        keep = keep & (F.col("p_enrich") >= params.p_enrich) & (F.col("enrichment") >= params.ratio)
    return scored.filter(keep)


def bins_to_peaks(sig: DataFrame, binsize: int, tile: int = TILE_BINS) -> DataFrame:
    """Maximal runs of adjacent significant bins.

    Runs are found inside tiles; those that touch a tile border are then joined.
    The summit is the middle of the first bin with the highest internal score.
    """
    keys = ["label", "chrom"]
    w = Window.partitionBy(*keys, "tile").orderBy("bin")
    best = F.struct(F.col("p_internal").alias("score"), (-F.col("bin")).alias("nbin"))
    runs = (sig.withColumn("_run", F.col("bin") - F.row_number().over(w))
            .groupBy(*keys, "tile", "_run")
            .agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.sum("c").alias("c"), F.sum("i").alias("i"),
                 F.max(best).alias("best"), F.max("p_enrich").alias("p_enrich")))
    whole = stitch(runs, keys, tile, [F.sum("c").alias("c"), F.sum("i").alias("i"), F.max("best").alias("best"),
                                      F.max("p_enrich").alias("p_enrich")], "b0", "b1")
    start, end = F.col("b0") * binsize, (F.col("b1") + 1) * binsize - 1
    return whole.select(
        F.col("label").alias("sample"), "chrom", start.alias("start"), end.alias("end"), (end - start).alias("length"),
        (-F.col("best.nbin") * binsize + (binsize - 1) // 2).alias("summit"),
        from_fixed(F.col("c")).alias("pileup"), from_fixed(F.col("i")).alias("pileup_input"),
        safe_ratio(F.col("c"), F.col("i")).alias("enrichment"),
        F.col("best.score").alias("p_internal"), F.col("p_enrich"))


def call_peaks(bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int, params: PeakParams,
               method: str = "gaussian", window: int = LOCAL_BINS, ratios: DataFrame | None = None,
               chip_only: bool = False, tile: int = TILE_BINS) -> DataFrame:
    """Peaks of every pair in one pass."""
    if not chip_only and params.p_internal <= 0 and params.ratio <= 0 and params.height <= 0:
        raise ValueError("thresholds that accept empty bins would make every bin a peak")
    scored = scored_bins(bins, pairs, genome, binsize, params.smooth, method, window, ratios, tile)
    return bins_to_peaks(significant(scored, params, chip_only), binsize, tile)


def call_peaks_chip_only(bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int, params: PeakParams,
                         method: str = "gaussian", window: int = LOCAL_BINS, tile: int = TILE_BINS) -> DataFrame:
    """Peaks from the local background alone."""
    return call_peaks(bins, pairs.withColumn("input", F.lit(None).cast("string")), genome, binsize, params,
                      method, window, None, True, tile)


def number_peaks(peaks: DataFrame, genome: DataFrame) -> DataFrame:
    """Running number from 0 in genome order.

    The peaks are read twice, so they are written once before. Ranks are local to a 16 Mb stretch; the offset of a stretch comes from the
    small table of stretch sizes, so no task sorts all peaks of a sample.
    """
    step = 1 << 24
    p = cut(peaks).join(lookup(genome).select("chrom", "ord"), "chrom").withColumn("_s", div("start", step))
    sizes = p.groupBy("sample", "ord", "_s").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("sample").orderBy("ord", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("sample", "ord", "_s", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("sample", "ord", "_s").orderBy("start"))
    out = p.join(offsets, ["sample", "ord", "_s"])
    return out.withColumn("peak_no", (local - 1 + F.col("_off")).cast("long")).drop("_s", "_off", "ord")


def mark_peaks(track: DataFrame, peaks: DataFrame, start: int, end: int) -> DataFrame:
    """Peaks of the shown range, clipped to it."""
    return (peaks.filter((F.col("start") <= end) & (F.col("end") >= start))
            .withColumn("start", F.greatest("start", F.lit(start))).withColumn("end", F.least("end", F.lit(end))))


def mark_track(track: DataFrame, called: DataFrame, binsize: int, user: DataFrame | None = None, tile: int = TILE_BINS) -> DataFrame:
    """Bins (sample, chrom, bin, ...) with ``in_peak``: whether a peak of the sample touches them, a sample's user list (sample, chrom, start, end) before its called peaks.

    The merged peaks are cut at tile borders, so one sweep over the bins and the interval ends of a tile needs nothing from other tiles.
    """
    keys, span = ["sample", "chrom"], ["sample", "chrom", "start", "end"]
    peaks = called.select(span)
    if user is not None:
        peaks = peaks.join(user.select("sample").distinct(), "sample", "left_anti").unionByName(user.select(span))
    spans = tiled_union(peaks.withColumn("start", div("start", binsize)).withColumn("end", div("end", binsize)), keys, tile)
    steps = spans.select(*keys, "tile", F.inline(F.array(F.struct(F.col("start").alias("bin"), F.lit(1).alias("_step")),
                                                         F.struct((F.col("end") + 1).alias("bin"), F.lit(-1).alias("_step")))))
    rows = by_tile(track.withColumn("tile", div("bin", tile)).unionByName(steps, True), keys)
    w = Window.partitionBy(*keys, "tile").orderBy("bin", F.col("_step").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # ends before the bin itself
    return (rows.withColumn("in_peak", F.coalesce(F.sum("_step").over(w), F.lit(0)) > 0).filter("_step IS NULL").drop("_step", "tile"))
