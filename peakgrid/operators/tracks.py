"""Derived signals and the data behind track views."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip_to_scale, from_fixed, safe_ratio, to_fixed
from ..functions.scores import log_ratio
from ..functions.tiles import div
from .bins import LOCAL_BINS, densify
from .peaks import pair_bins, scored_bins

LINE_WIDTH = 500_000
LINES_PER_PAGE = 1
BARS = 2
MAX_THIN = 20


def genwig(bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int, labels: Sequence[str], value: int = 0,
           smooth: int = 0, window: int = LOCAL_BINS, ratios: DataFrame | None = None) -> DataFrame:
    """Derived signal of every pair on all bins: 0 ratio, 1 internal score, 2 enrichment score.

    Pairs without an input are left out. ``labels`` are the labels of the others.
    """
    with_input = pairs.filter(F.col("input").isNotNull())
    if value == 0 and not smooth:
        t = (pair_bins(bins, with_input).groupBy("label", "chrom", "bin")
             .agg(F.sum("c").alias("c"), F.sum("i").alias("i"))
             .withColumn("value", safe_ratio(F.col("c"), F.col("i"))))
    else:
        t = scored_bins(bins, with_input, genome, binsize, smooth, window=window, ratios=ratios)
        col = {0: safe_ratio(F.col("c"), F.col("i")), 1: F.col("p_internal"), 2: F.col("p_enrich")}[value]
        t = t.withColumn("value", col)
    sparse = t.select(F.col("label").alias("sample"), "chrom", "bin", to_fixed(F.col("value")).alias("v"))
    return densify(sparse, genome, binsize, labels)


def thin_factor(line_width: int, binsize: int) -> int:
    return max(min(line_width // (1000 * binsize), MAX_THIN), 1)


def downsample_track(values: DataFrame, sbin: int, ebin: int, thin: int, keys: Sequence[str] = ("label", "chrom")) -> DataFrame:
    """Groups of ``thin`` bins from ``sbin``: the value of largest size, the first on ties, sign kept.

    A last group that is not full is left out. Groups without signal have no row.
    """
    group = div(F.col("bin") - sbin, thin)
    inside = (F.col("bin") >= sbin) & (F.col("bin") < ebin)
    full = group * thin + sbin < ebin - thin + 1
    return (values.filter(inside).withColumn("grp", group).filter(full)
            .groupBy(*keys, "grp")
            .agg(F.max_by("value", F.struct(F.abs("value").alias("size"), (-F.col("bin")).alias("tie"))).alias("value")))


def highlight(value: Column, threshold: float, on: bool = True) -> Column:
    """Whether a ratio or score reaches its threshold."""
    return (value >= threshold) if on else F.lit(False)


def tile_lines(df: DataFrame, start: int, end: int, width: int = LINE_WIDTH, per_page: int = LINES_PER_PAGE,
               pos: str = "pos") -> DataFrame:
    """Line and page of every position of a region."""
    line = div(F.col(pos) - start, width)
    return (df.filter((F.col(pos) >= start) & (F.col(pos) <= end))
            .withColumn("line", line).withColumn("page", div(line, per_page)))


def line_count(start: int, end: int, width: int = LINE_WIDTH, per_page: int = LINES_PER_PAGE) -> tuple[int, int]:
    """Number of lines and pages of a region; the last line ends with the region."""
    lines = (end - start - 1) // width + 1
    return lines, (lines - 1) // per_page + 1


def line_table(regions: DataFrame, width: int = LINE_WIDTH, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Lines of every region: (…, line, page, line_start, line_end)."""
    last = div(F.col("end") - F.col("start") - 1, width)
    out = regions.withColumn("line", F.explode(F.sequence(F.lit(0), last)))
    begin = F.col("start") + F.col("line") * width
    return (out.withColumn("page", div("line", per_page)).withColumn("line_start", begin)
            .withColumn("line_end", F.least(begin + width, F.col("end"))))


def gv_layout(genome: DataFrame) -> DataFrame:
    """Whole-chromosome view: one line per chromosome, as wide as the longest plus one."""
    longest = genome.agg(F.max("length")).first()[0]
    return genome.select("chrom", F.lit(0).alias("start"), F.col("length").alias("end"),
                         F.lit(longest + 1).alias("width"))


LAYERS = ("pinter", "penrich", "ratio", "logratio", "chip", "input")


def track_view(bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int, chrom: str, start: int, end: int,
               layers: Sequence[str] = LAYERS, scale_tag: float = 30.0, scale_ratio: float = 5.0,
               scale_pvalue: float = 5.0, ratio_threshold: float = 2.0, p_internal: float = 5.0, p_enrich: float = 4.0,
               width: int = LINE_WIDTH, per_page: int = LINES_PER_PAGE, bars: int = BARS, smooth: int = 0,
               input_of_first: str | None = None) -> DataFrame:
    """Long table of the layers of a region, thinned for display.

    Columns: label, [panel, layer_no when ``pairs`` has them], layer, line, page,
    grp, value, drawn (clipped to the scale), marked. ``input_of_first`` keeps the
    input layer for that label only. Overlay samples are further rows of ``pairs``
    with the same panel.

    Only bins within reach of the region (half the local window and twice the smoothing) are read and scored; the
    condition goes down to the files, which ``write_bins`` sorts by bin.
    """
    reach = LOCAL_BINS // 2 + 2 * smooth
    near = bins.filter((F.col("chrom") == chrom) & F.col("bin").between(start // binsize - reach, end // binsize + reach))
    s = scored_bins(near, pairs, genome, binsize, smooth, keep_zero=True)
    value = {
        "pinter": F.col("p_internal"), "penrich": F.col("p_enrich"), "ratio": F.col("enrichment"),
        "logratio": log_ratio(F.col("enrichment"), scale_ratio), "chip": from_fixed(F.col("c")),
        "input": from_fixed(F.col("i")),
    }
    long = s.select("label", "chrom", "bin", F.inline(F.array(*[
        F.struct(F.lit(k).alias("layer"), value[k].alias("value")) for k in layers])))
    if input_of_first is not None:
        long = long.filter((F.col("layer") != "input") | (F.col("label") == input_of_first))
    long = tile_lines(long.withColumn("pos", F.col("bin") * binsize), start, end, width, per_page).filter(F.col("value") != 0)
    # thinning restarts at the first bin of a line
    thin = thin_factor(width, binsize)
    first = div(F.col("line") * width + start, binsize)
    last = div(F.least((F.col("line") + 1) * width + start, F.lit(end)), binsize)
    grp = div(F.col("bin") - first, thin)
    keys = ["label", "chrom", "layer", "line", "page"]
    long = (long.withColumn("grp", grp).filter((F.col("bin") < last) & (grp * thin + first < last - thin + 1))
            .groupBy(*keys, "grp")
            .agg(F.max_by("value", F.struct(F.abs("value").alias("size"), (-F.col("bin")).alias("tie"))).alias("value")))
    is_p = F.col("layer").isin("pinter", "penrich")
    scale = F.when(is_p, float(scale_pvalue)).when(F.col("layer") == "ratio", float(scale_ratio)).when(
        F.col("layer") == "logratio", 1.0).otherwise(float(scale_tag))
    limit = scale * float(bars)
    drawn = F.when(F.col("layer") == "logratio", F.greatest(F.least(F.col("value"), limit), -limit)).otherwise(
        F.greatest(F.least(F.col("value"), limit), F.lit(0.0)))
    marked = (F.when(F.col("layer") == "pinter", F.col("value") >= p_internal)
              .when(F.col("layer") == "penrich", F.col("value") >= p_enrich)
              .when(F.col("layer") == "ratio", F.col("value") >= ratio_threshold)
              .when(F.col("layer") == "logratio", F.col("value") >= 0).otherwise(F.lit(False)))
    out = long.withColumn("drawn", drawn).withColumn("marked", marked)
    extra = [c for c in ("panel", "layer_no") if c in pairs.columns]
    return out.join(pairs.select("label", *extra), "label") if extra else out


def graph_range(track: DataFrame, ymin: float | None = None, ymax: float | None = None) -> DataFrame:
    """Window track with its axis range and the value scaled to it; default 0..max(20, maximum)."""
    if ymin is None or ymax is None:
        top = track.agg(F.greatest(F.max("value"), F.lit(20.0)).alias("m")).first()["m"]
        ymin, ymax = 0.0, float(top if top is not None else 20.0)
    return (track.withColumn("ymin", F.lit(float(ymin))).withColumn("ymax", F.lit(float(ymax)))
            .withColumn("scaled", (F.col("value") - F.lit(float(ymin))) / F.lit(float(ymax) - float(ymin))))


def clipped(values: DataFrame, scale: float, bars: int = BARS, show_negative: bool = False, bars_minus: int = 0) -> DataFrame:
    return values.withColumn("drawn", clip_to_scale(F.col("value"), scale, bars, show_negative, bars_minus))
