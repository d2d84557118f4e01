"""Signals around genes and sites: profiles, matrices and their summaries.

Sites with the same bin range share one lookup of the signal; the result is
joined back to the sites.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_fixed, safe_ratio
from ..functions.tiles import by_tile, div
from ..session import BROADCAST_ROWS, cut, derived_lookup, lookup

NONCANONICAL = ["nonsense_mediated_decay", "processed_transcript", "retained_intron"]  # fixed values
GENE_BLOCKS = 100
PROFILE_WIDTH = 2500
LOCUS_FLANK = 50_000
SUM_BINS = 1024
#: Of range sums of values that are not fixed point.
EXACT = "decimal(28,12)"


def drop_noncanonical_biotypes(genes: DataFrame) -> DataFrame:
    return genes.filter(~F.col("gtype").isin(*NONCANONICAL))


def valid_sites(sites: DataFrame, genome: DataFrame, width: int, pos: str = "pos") -> DataFrame:
    """Sites whose window stays inside the chromosome."""
    return (sites.join(lookup(genome).select("chrom", "length"), "chrom")
            .filter((F.col(pos) - width >= 0) & (F.col(pos) + width < F.col("length"))).drop("length"))


def site_counts(sites: DataFrame, genome: DataFrame, width: int, pos: str = "pos") -> DataFrame:
    """Number of sites and of those left out."""
    inside = (F.col(pos) - width >= 0) & (F.col(pos) + width < F.col("length"))
    return (sites.join(lookup(genome).select("chrom", "length"), "chrom")
            .agg(F.count("*").alias("n_sites"), F.sum((~inside).cast("long")).alias("n_skipped")))


def gene_loci_regions(genes: DataFrame, names: DataFrame, genome: DataFrame, flank: int = LOCUS_FLANK) -> DataFrame:
    """Regions around the listed genes, inside the chromosome."""
    return (genes.join(names.select(F.col("name").alias("gname")).distinct(), "gname", "left_semi")
            .join(lookup(genome).select("chrom", "length"), "chrom")
            .select("chrom", F.greatest(F.col("tx_start") - flank, F.lit(0)).alias("start"),
                    F.least(F.col("tx_end") + flank, F.col("length") - 1).alias("end"), F.col("gname").alias("name")))


def value_bins(bins: DataFrame, pairs: DataFrame, stype: int = 0) -> DataFrame:
    """Values to profile: 0 the ChIP signal (with its fixed-point ``v``), 1 ChIP / input per bin -> (label, chrom, bin, value)."""
    if stype == 0:
        one = lookup(pairs).select("label", F.col("chip").alias("sample"))
        return bins.join(one, "sample").select("label", "chrom", "bin", from_fixed(F.col("v")).alias("value"), "v")
    from .peaks import pair_bins
    side = (pair_bins(bins, pairs).groupBy("label", "chrom", "bin")
            .agg(F.sum("c").alias("c"), F.sum("i").alias("i")))
    return (side.filter((F.col("c") != 0) & (F.col("i") != 0))
            .select("label", "chrom", "bin", safe_ratio(F.col("c"), F.col("i")).alias("value")))


def _check_width(width: int, binsize: int) -> int:
    half = width // binsize
    if half <= 1:
        raise ValueError(f"width {width} is too small for bin size {binsize}")
    return half


def window_rows(sites: DataFrame, values: DataFrame, labels: DataFrame, binsize: int, width: int) -> DataFrame:
    """Values around (site, chrom, pos, strand), one row a site and label: (label, chrom, site, values), from offset -half to half.

    Rows of the - strand are reversed. Bins without signal are 0 and present. Where the distinct centres are few, they are
    brought to the sites, so that the sites are not shuffled.
    """
    half = _check_width(width, binsize)
    size = 2 * half + 1
    placed = sites.withColumn("centre", div("pos", binsize))
    centres = placed.select("chrom", "centre").distinct()
    offsets = centres.withColumn("k", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    hit = (offsets.withColumn("bin", F.col("centre") + F.col("k")).join(values, ["chrom", "bin"])
           .groupBy("chrom", "centre", "label").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m")))
    # at most 2*half+1 values per centre and label travel with the join
    around = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    hit = derived_lookup(hit.select("chrom", "centre", "label", around.alias("m")), BROADCAST_ROWS // size)
    every = placed.withColumn("label", F.explode(F.array(*[F.lit(r[0]) for r in labels.select("label").collect()])))
    rows = every.join(hit, ["chrom", "centre", "label"], "left")
    along = F.when(F.col("strand") == "-", F.reverse("m")).otherwise(F.col("m"))
    return rows.select("label", "chrom", "site", F.coalesce(along, F.array_repeat(F.lit(0.0), size)).alias("values"))


def long_rows(packed: DataFrame) -> DataFrame:
    """One row a value: ``values`` becomes (offset, value), offsets counted from the middle; other columns are kept."""
    rest = [c for c in packed.columns if c != "values"]
    half = F.floor(F.size("values") / 2).cast("int")
    return packed.select(*rest, half.alias("_half"), F.posexplode("values").alias("offset", "value")).select(
        *rest, (F.col("offset") - F.col("_half")).alias("offset"), "value")


def window_profile(sites: DataFrame, values: DataFrame, labels: DataFrame, binsize: int, width: int, packed: bool = False) -> DataFrame:
    """Site x offset values around (site, chrom, pos, strand); long form (label, chrom, site, offset, value), or ``packed`` as :func:`window_rows`."""
    rows = window_rows(sites, values, labels, binsize, width)
    return rows if packed else long_rows(rows)


def _gene_sites(genes: DataFrame, at_start: bool) -> DataFrame:
    fwd, rev = ("tx_start", "tx_end") if at_start else ("tx_end", "tx_start")
    return drop_noncanonical_biotypes(genes).select(
        F.col("tid").alias("site"), "chrom", "strand",
        F.when(F.col("strand") == "+", F.col(fwd)).otherwise(F.col(rev)).alias("pos"))


def profile_tss(genes: DataFrame, bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int,
                width: int = PROFILE_WIDTH, stype: int = 0) -> DataFrame:
    """Values around transcription start sites."""
    sites = valid_sites(_gene_sites(genes, True), genome, width)
    return window_profile(sites, value_bins(bins, pairs, stype), pairs, binsize, width)


def profile_tes(genes: DataFrame, bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int,
                width: int = PROFILE_WIDTH, stype: int = 0) -> DataFrame:
    """Values around transcription end sites."""
    sites = valid_sites(_gene_sites(genes, False), genome, width)
    return window_profile(sites, value_bins(bins, pairs, stype), pairs, binsize, width)


def profile_sites(bed: DataFrame, bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int,
                  width: int = PROFILE_WIDTH, stype: int = 0, packed: bool = False) -> DataFrame:
    """Values around the interval midpoints, never reversed; a site is named chrom-start-end."""
    sites = bed.select(F.concat_ws("-", "chrom", "start", "end").alias("site"), "chrom", F.lit("+").alias("strand"),
                       div(F.col("start") + F.col("end"), 2).alias("pos"))
    return window_profile(valid_sites(sites, genome, width), value_bins(bins, pairs, stype), pairs, binsize, width, packed)


def _trunc_bin(x: Column, binsize: int) -> Column:
    return (x / float(binsize)).cast("int")


def _gene_blocks(genes: DataFrame, genome: DataFrame, binsize: int, width: int | None) -> DataFrame:
    """300 blocks per gene: upstream, body, downstream, with their closed bin range."""
    n = GENE_BLOCKS
    g = drop_noncanonical_biotypes(genes).join(lookup(genome).select("chrom", "length"), "chrom")
    body = (F.col("tx_end") - F.col("tx_start")).cast("double")
    flank = F.lit(float(width)) if width is not None else body
    g = g.withColumn("_body", body).withColumn("_flank", flank)
    g = g.filter((F.col("tx_end") + F.col("_flank") < F.col("length")) & (F.col("tx_start") - F.col("_flank") >= 0))
    g = g.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(3 * n - 1))))
    i = F.col("block")
    step_f, step_b = F.col("_flank") / float(n), F.col("_body") / float(n)
    up, down = i < n, i >= 2 * n
    ts, te = F.col("tx_start").cast("double"), F.col("tx_end").cast("double")
    if width is None:
        # one formula over three gene lengths
        fs, fe = ts - F.col("_body") + step_b * i, ts - F.col("_body") + step_b * (i + 1) - 1
        rs, re_ = te + F.col("_body") - step_b * (i + 1), te + F.col("_body") - step_b * i - 1
    else:
        fs = (F.when(up, ts - F.col("_flank") + step_f * i).when(down, te + step_f * (i - 2 * n))
              .otherwise(ts + step_b * (i - n)))
        fe = (F.when(up, ts - F.col("_flank") + step_f * (i + 1) - 1).when(down, te + step_f * (i + 1 - 2 * n) - 1)
              .otherwise(ts + step_b * (i + 1 - n) - 1))
        rs = (F.when(up, te + F.col("_flank") - step_f * (i + 1)).when(down, ts - step_f * (i + 1 - 2 * n))
              .otherwise(te - step_b * (i + 1 - n)))
        re_ = (F.when(up, te + F.col("_flank") - step_f * i - 1).when(down, ts - step_f * (i - 2 * n) - 1)
               .otherwise(te - step_b * (i - n) - 1))
    fwd = F.col("strand") == "+"
    return g.select(F.col("tid").alias("site"), "chrom", "block",
                    _trunc_bin(F.when(fwd, fs).otherwise(rs), binsize).alias("sbin"),
                    _trunc_bin(F.when(fwd, fe).otherwise(re_), binsize).alias("ebin"))


def range_totals(ranges: DataFrame, values: DataFrame, labels: Sequence[str], tile: int = SUM_BINS) -> DataFrame:
    """Sum of the values in every distinct closed range (chrom, sbin, ebin), per label -> (label, chrom, sbin, ebin, total).

    Running sums are made inside tiles, which hold the points asked for beside the stored bins; what lies in earlier tiles is carried
    through the table of tile sums. So a range costs two points, however long it is. Sums are exact (of the
    fixed-point ``v`` where there is one, else of decimals), hence a range without signal is 0. Every range has a row for every label.
    """
    keys, fixed = ["label", "chrom"], "v" in values.columns
    q, kind = (F.col("v"), "long") if fixed else (F.col("value"), EXACT)
    distinct = ranges.filter(F.col("ebin") >= F.col("sbin")).select("chrom", "sbin", "ebin").distinct()
    points = (distinct.select("chrom", "sbin", "ebin", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), F.inline(F.array(
        F.struct((F.col("sbin") - 1).alias("bin"), F.lit(-1).alias("sign")), F.struct(F.col("ebin").alias("bin"), F.lit(1).alias("sign")))))
        .filter("bin >= 0").withColumn("q", F.lit(None).cast(kind)))
    rows = values.select(*keys, "bin", q.cast(kind).alias("q")).unionByName(points, True).withColumn("tile", div("bin", tile))
    w = Window.partitionBy(*keys, "tile").orderBy("bin", F.col("sign").asc_nulls_first())  # stored bins before the points on them
    sums = cut(by_tile(rows, keys)
               .withColumn("run", F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lead("bin").over(w).isNull())
               .filter("sign IS NOT NULL OR last").drop("q", "bin"))
    before = F.sum("run").over(Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.filter("last").select(*keys, "tile", before.alias("carried"))  # one row a tile
    upto = F.coalesce("run", F.lit(0)) + F.coalesce("carried", F.lit(0))
    total = F.sum(F.when(F.col("sign") < 0, -upto).otherwise(upto))
    return (sums.filter("sign IS NOT NULL").join(carried, [*keys, "tile"]).groupBy(*keys, "sbin", "ebin")
            .agg((from_fixed(total) if fixed else total.cast("double")).alias("total")))


def range_maxima(ranges: DataFrame, values: DataFrame, fan: int = 16, levels: int = 6) -> DataFrame:
    """Largest value in every distinct range (chrom, sbin, ebin), per label -> (label, chrom, sbin, ebin, top).

    Maxima are kept for blocks of ``fan`` bins, ``fan`` of those and so on; a range is cut into whole blocks, at most
    ``2 * fan`` of each level but the last.
    """
    def of_level(blocks: str, k: int) -> Column:
        return F.transform(F.coalesce(blocks, F.array().cast("array<int>")), lambda x: F.struct(F.lit(k).alias("level"), x.alias("block")))
    keys = ["label", "chrom"]
    layer = values.select(*keys, F.col("bin").alias("block"), F.col("value").alias("top"))
    layers = []
    for k in range(levels):
        if k:
            layer = layer.groupBy(*keys, div("block", fan).alias("block")).agg(F.max("top").alias("top"))
        layers.append(layer.withColumn("level", F.lit(k)))
    out = ranges.filter(F.col("ebin") >= F.col("sbin")).select("chrom", "sbin", "ebin").distinct()
    low, high, pieces = F.col("sbin"), F.col("ebin"), []
    for k in range(levels):
        # what lies outside the whole blocks of the next level; everything where there is none
        first, last = F.ceil(low / fan).cast("int"), (F.floor((high + 1) / fan) - 1).cast("int")
        some, inner = low <= high, (first <= last) if k < levels - 1 else F.lit(False)
        to, back = F.when(inner, first * fan - 1).otherwise(high), (last + 1) * fan
        head, tail = F.when(some & (low <= to), F.sequence(low, to)), F.when(some & inner & (back <= high), F.sequence(back, high))
        out = out.withColumn(f"_head{k}", head).withColumn(f"_tail{k}", tail).withColumn(f"_low{k}", F.when(some & inner, first).otherwise(1)).withColumn(f"_high{k}", F.when(some & inner, last).otherwise(0))
        low, high = F.col(f"_low{k}"), F.col(f"_high{k}")
        pieces += [of_level(f"_{part}{k}", k) for part in ("head", "tail")]
    blocks = out.select("chrom", "sbin", "ebin", F.inline(F.concat(*pieces)))
    return (blocks.join(reduce(DataFrame.unionByName, layers), ["chrom", "level", "block"])
            .groupBy(*keys, "sbin", "ebin").agg(F.max("top").alias("top")))


def _label_names(pairs: DataFrame) -> list[str]:
    return [r[0] for r in pairs.select("label").collect()]


def _block_means(blocks: DataFrame, values: DataFrame, pairs: DataFrame) -> DataFrame:
    labels = _label_names(pairs)
    hit = range_totals(blocks, values, labels)
    every = blocks.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    out = every.join(hit, ["chrom", "sbin", "ebin", "label"], "left")
    width = F.col("ebin") - F.col("sbin") + 1
    mean = F.when(width > 0, F.coalesce(safe_ratio(F.col("total"), width), F.lit(0.0))).otherwise(0.0)
    return out.select("label", "chrom", "site", (F.col("block") - GENE_BLOCKS).alias("offset"), mean.alias("value"))


def profile_gene_body(genes: DataFrame, bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int,
                      stype: int = 0) -> DataFrame:
    """300 columns per gene, -100..199: one gene length up, the body, one gene length down; mean per block."""
    blocks = _gene_blocks(genes, genome, binsize, None)
    return _block_means(blocks, value_bins(bins, pairs, stype), pairs)


def profile_gene_body_fixed(genes: DataFrame, bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int,
                            width: int = PROFILE_WIDTH, stype: int = 0) -> DataFrame:
    """As the gene body profile with flanks of fixed width; the body blocks span the gene."""
    blocks = _gene_blocks(genes, genome, binsize, width)
    return _block_means(blocks, value_bins(bins, pairs, stype), pairs)


def site_matrix(bed: DataFrame, bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int,
                how: str = "mean", stype: int = 0) -> DataFrame:
    """One row per interval, one column per pair label: mean or maximum of its bins.

    Intervals outside the chromosome are left out. Every distinct bin range is
    looked up once for all labels; equal intervals keep their rows.
    """
    labels = _label_names(pairs)
    inside = (bed.join(lookup(genome).select("chrom", "length"), "chrom")
              .filter((F.col("start") >= 0) & (F.col("end") < F.col("length"))).drop("length")
              .withColumn("sbin", div("start", binsize)).withColumn("ebin", div(F.col("end") - 1, binsize)))
    values = value_bins(bins, pairs, stype)
    hit = range_totals(inside, values, labels) if how == "mean" else range_maxima(inside, values)
    value = F.col("total") if how == "mean" else F.col("top")
    hit = hit.groupBy("chrom", "sbin", "ebin").agg(*[F.max(F.when(F.col("label") == l, value)).alias(l) for l in labels])
    width = F.col("ebin") - F.col("sbin") + 1

    def cell(label: str) -> Column:
        v = F.coalesce(F.col(f"`{label}`"), F.lit(0.0))
        return (safe_ratio(v, width) if how == "mean" else F.greatest(v, F.lit(0.0))).alias(label)

    return (inside.join(hit, ["chrom", "sbin", "ebin"], "left")
            .select("chrom", "start", "end", "name", *[cell(l) for l in labels]))


def aggregate_profile(profile: DataFrame) -> DataFrame:
    """Mean, standard deviation and 95% band per label and offset."""
    return (profile.groupBy("label", "offset")
            .agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
                 F.count("*").alias("n"))
            .withColumn("ci", F.lit(1.96) * F.col("sd") / F.sqrt(F.col("n").cast("double"))))


def profile_limits(aggregated: DataFrame, from_zero: bool = True) -> DataFrame:
    """Axis range of the mean lines over all labels; gene body profiles of reads start at their minimum."""
    low = F.lit(0.0) if from_zero else F.min("mean")
    return aggregated.agg(low.alias("ymin"), F.ceil(F.max("mean")).cast("double").alias("ymax"))


def profile_wide(profile: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Site x offset matrix per label. Equal sites have equal values and keep their number of rows."""
    cells = [F.max(F.when(F.col("offset") == o, F.col("value"))).alias(str(o)) for o in offsets]
    copies = F.count(F.when(F.col("offset") == offsets[0], 1)).cast("int").alias("_n")
    wide = profile.groupBy("label", "chrom", "site").agg(copies, *cells)
    return (wide.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
            .select("label", "site", *[str(o) for o in offsets]))


def heatmap_order(profile: DataFrame, ref: str, vmax: float, column: int = 0, sort: bool = True) -> DataFrame:
    """Profile with the row rank of every site and values clipped to [0, vmax].

    The rank is by descending value of ``column`` in the reference label, then by
    site; equal sites share it. A packed profile (of :func:`window_rows`) is ranked and joined as one row a site and label,
    and comes back in long form.
    """
    packed = "values" in profile.columns

    def clip(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(float(vmax)))
    out = profile.withColumn("values", F.transform("values", clip)) if packed else profile.withColumn("value", clip(F.col("value")))
    if sort:
        ref_rows = profile.filter(F.col("label") == ref)
        if packed:
            at = F.floor(F.size("values") / 2).cast("int") + column
            ref_rows = ref_rows.filter((at >= 0) & (at < F.size("values"))).withColumn("value", F.get("values", at))
        else:
            ref_rows = ref_rows.filter(F.col("offset") == column)
        key = ref_rows.groupBy("chrom", "site").agg(F.max("value").alias("_key"))
        rank = global_rank(key, [F.col("_key").desc(), F.col("site").asc(), F.col("chrom").asc()], "row_rank")
        out = out.join(rank.select("chrom", "site", "row_rank"), ["chrom", "site"])
    return long_rows(out) if packed else out


def global_rank(df: DataFrame, order: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """0-based rank over the whole table without one task sorting all rows."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                 .withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_lo"))
    offsets = sizes.select("_p", "_lo", F.coalesce(F.sum("_n").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_p")  # at most ``parts`` rows
            .withColumn(name, (F.col("_i") - F.col("_lo") + F.col("_off")).cast("long")).drop("_p", "_i", "_lo", "_off", "_n"))


def log1p_matrix(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """log(1 + x) of the label columns."""
    return matrix.select(*[c for c in matrix.columns if c not in labels], *[F.log1p(F.col(c)).alias(c) for c in labels])
