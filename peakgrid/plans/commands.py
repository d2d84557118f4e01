"""Whole workflows over files: reads to normalised bins with statistics, and the signal commands."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import drop_sex_mito, only_chrom, strip_chr
from ..operators import bins as B
from ..operators import gc as GC
from ..operators import intervals as I
from ..operators import peaks as P
from ..operators import profiles as PR
from ..operators import reads as R
from ..operators import tracks as T
from ..session import cut, lookup
from ..sources import signals, tables


@dataclass(frozen=True)
class Counted:
    """Result of :func:`count_reads`."""
    bins: DataFrame
    stats: DataFrame
    distribution: DataFrame
    complexity: DataFrame
    gc_weights: DataFrame | None


def count_reads(reads: DataFrame, genome: DataFrame, binsize: int = 100, flen: int | None = R.FIXED_FRAGMENT,
                read_length: int = 0, paired: bool = False, max_insert: int = R.MAX_INSERT, threshold: int | None = None,
                keep_duplicates: bool = False, multimap: bool = False, rcenter: int = 0, read_ends_only: bool = False,
                norm: str = "NONE", nrpm: int = 20_000_000, ndepth: float = 1.0, bed: DataFrame | None = None,
                mappable: DataFrame | None = None, bin_mappability: DataFrame | None = None,
                chunks: DataFrame | None = None, flen4gc: int = GC.GC_LENGTH, ncmp: int = R.COMPLEXITY_READS) -> Counted:
    """Filter, extend, weight, count and normalise reads; with quality statistics.

    ``flen`` None estimates the fragment length of each sample from the strand
    shift; a sample without reads on numbered chromosomes takes the fixed length. ``threshold`` None takes the rule 10 x expected reads, per sample.
    """
    if paired:
        reads = R.pair_filter(reads, max_insert)
    if paired:
        flen = flen or R.FIXED_FRAGMENT
    elif flen is None:
        flen = cut(R.with_every_sample(R.estimate_fragment_length(reads, genome, read_length, 5 if read_length else 0), reads))
    if threshold is None:
        threshold = cut(R.duplicate_threshold(reads, genome))
    limit = (1 << 31) - 1 if keep_duplicates else threshold  # without the filter no read is redundant
    weighted = gc_weights = None
    if multimap or chunks is not None or read_ends_only:
        kept = reads if keep_duplicates else R.nonredundant(reads, threshold, paired)
        if multimap:
            kept = R.multimap_weight(kept)
        if chunks is not None:
            whole = genome.select("chrom", F.lit(0).alias("start"), (F.col("length") - 1).alias("end"))
            unmappable = None if mappable is None else cut(I.combine(whole, mappable, "subtract"))
            kept, gc_weights = gc_normalise(kept, chunks, genome, flen, flen4gc, unmappable)
            weighted = kept
        frags = R.fragments(R.extend(kept, flen), genome, rcenter)
    else:
        frags = R.site_fragments(reads, genome, flen, limit, paired, rcenter)
    counted = (R.bin_read_ends if read_ends_only else R.bin_reads)(frags, binsize)
    if bin_mappability is not None:
        counted = B.mappability_normalise(counted, bin_mappability)
    stats = cut(R.qc_stats(reads, genome, bed, flen, limit, norm, nrpm, ndepth, mappable, weighted, paired, rcenter, max_insert))
    if norm != "NONE":
        counted = B.total_read_normalise(counted, stats)
    return Counted(counted, stats, B.bin_value_distribution(counted, genome, binsize),
                   R.library_complexity(reads, ncmp, threshold, paired), gc_weights)


def gc_normalise(reads: DataFrame, chunks: DataFrame, genome: DataFrame, flen: int | DataFrame, flen4gc: int = GC.GC_LENGTH,
                 unmappable: DataFrame | None = None, size: int = GC.CHUNK) -> tuple[DataFrame, DataFrame]:
    """Reads with GC weights and the weight table of each sample, from the chromosome with the most mappable bases.

    The window follows the fragment length of the sample; samples with one window length are weighted together.
    """
    windows: dict[int, list[str] | None] = {}
    if isinstance(flen, DataFrame):
        for r in R.with_every_sample(flen, reads).select("sample", "fragment_length").collect():  # one row per sample
            windows.setdefault(GC.window_length(r["fragment_length"], flen4gc), []).append(r["sample"])
    else:
        windows[GC.window_length(flen, flen4gc)] = None
    longest = F.col("chrom") == B.longest_chrom(genome).first()["chrom"]
    one = chunks.filter(longest)
    done = []
    for w, names in sorted(windows.items()):
        own = reads if names is None else reads.filter(F.col("sample").isin(names))
        hist = GC.gc_genome_distribution(one, genome, w, unmappable, size)
        seen = GC.gc_read_distribution(own.filter(longest), one, genome, flen, w, unmappable, size)
        weights = cut(GC.gc_weight(hist, seen, w))
        done.append((GC.gc_reweight(own, chunks, genome, weights, flen, w, size), weights))
    return tuple(reduce(DataFrame.unionByName, part) for part in zip(*done))


def _one_sample(spark: SparkSession, address: str) -> DataFrame:
    path, _, name = address.partition("#")
    bins = signals.read_bins(spark, path)
    if name:
        return bins.filter(F.col("sample") == name)
    if len({part for f in bins.inputFiles() for part in f.split("/") if part.startswith("sample=")}) > 1:
        raise ValueError(f"{path} holds several samples; write {path}#sample")
    return bins


def load_signals(spark: SparkSession, sheet: DataFrame, strip: bool = False) -> DataFrame:
    """Bins of every signal file of the sheet, each read once; the sample is the path.

    Files of one format and bin size are one scan. ``root#sample`` is one sample of a
    Parquet folder; a folder of several samples without a name is refused.
    """
    rows = sheet.select("chip", "input", "binsize").collect()  # the sheet is a parameter table
    groups: dict[tuple[str, int], set[str]] = {}
    for r in rows:
        for path in filter(None, (r["chip"], r["input"])):
            groups.setdefault((signals.format_of(path), r["binsize"]), set()).add(path)
    parts = []
    for (kind, size), paths in sorted(groups.items()):
        names = {p: p for p in sorted(paths)}
        if kind == "BEDGRAPH":
            parts.append(signals.read_bedgraph(spark, names, None, size, strip))
        elif kind == "WIG":
            parts.append(signals.read_wig(spark, names, None, size, strip))
        else:
            parts += [_one_sample(spark, p).withColumn("sample", F.lit(p)) for p in names]
    return reduce(DataFrame.unionByName, parts)


def signal_totals(bins: DataFrame, genome: DataFrame, names: Sequence[str],
                  stats: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The bins and the read totals of the named signals, as (sample, chrom, total) with genome rows.

    ``stats`` names the statistics file of a signal; its normalised read numbers are the totals, and
    chromosomes it leaves out count 0. Signals without one are summed while the bins are
    stored. With a file for each, the bins come back as they are and no row of them is read.
    """
    stats = {n: stats[n] for n in names if n in (stats or {})}
    rest = [n for n in names if n not in stats]
    parts = []
    if rest:
        bins, seen = B.stored_with_totals(bins, genome, rest)
        parts.append(seen)
    spark = genome.sparkSession
    chroms = genome.select("chrom", strip_chr(F.col("chrom")).alias("_k")).unionByName(
        spark.createDataFrame([(R.GENOME_ROW, R.GENOME_ROW)], "chrom string, _k string"))
    for name, path in stats.items():
        found = tables.read_stats(spark, path).select(F.col("chrom").alias("_k"), "total")
        parts.append(chroms.join(found, "_k", "left").select(
            F.lit(name).alias("sample"), "chrom", F.coalesce("total", F.lit(0)).cast("long").alias("total")))
    return bins, reduce(DataFrame.unionByName, parts)


def _scope(bins: DataFrame, genome: DataFrame, chrom: str | None, include_all: bool) -> DataFrame:
    bins = drop_sex_mito(bins, include_all)
    return only_chrom(bins, genome, chrom) if chrom else bins


def peak_command(bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int, mode: str = "SHARP", norm: int = 0,
                 chrom: str | None = None, include_all: bool = False, regions: DataFrame | None = None,
                 method: str = "gaussian", window: int = B.LOCAL_BINS, totals: DataFrame | None = None, **thresholds: float) -> DataFrame:
    """Numbered peaks of all pairs; pairs without an input use the internal score only.

    With ``norm`` 1 or 2 the ratios come from ``totals`` (of :func:`signal_totals`), else from a pass over the bins.

    ``thresholds`` override the preset (p_internal, p_enrich, ratio, height, smooth).
    """
    params = replace(P.peak_presets(mode), **thresholds)
    scoped = _scope(bins, genome, chrom, include_all)
    has_input = pairs.select(F.sum(F.col("input").isNotNull().cast("int")), F.count("*")).first()
    parts = []
    if has_input[0]:
        both = lookup(pairs.filter("input IS NOT NULL"))
        ratios = B.chip_input_ratio(bins, both, norm, totals) if norm in (1, 2) else None
        parts.append(P.call_peaks(scoped, both, genome, binsize, params, method, window, ratios))
    if has_input[0] < has_input[1]:
        parts.append(P.call_peaks_chip_only(scoped, lookup(pairs.filter("input IS NULL")), genome, binsize, params, method, window))
    peaks = reduce(DataFrame.unionByName, parts)
    if regions is not None:
        peaks = I.overlaps_any(peaks, regions)
    return P.number_peaks(peaks, genome)


def view_command(bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int, mode: str = "SHARP",
                 chrom: str | None = None, start: int = 0, end: int | None = None, **options) -> DataFrame:
    """Layers of a region; mode GV shows the whole chromosome on one line."""
    params = P.peak_presets(mode)
    length = genome.filter(F.col("chrom") == chrom).select("length").first()[0]
    if mode == "GV":
        options.setdefault("width", genome.agg(F.max("length")).first()[0] + 1)
    options.setdefault("smooth", params.smooth)
    return T.track_view(bins, pairs, genome, binsize, chrom, start, length - 1 if end is None else end, **options)


PROFILES = {"TSS": PR.profile_tss, "TES": PR.profile_tes, "GENE": PR.profile_gene_body,
            "GENE_FIXED": PR.profile_gene_body_fixed, "SITES": PR.profile_sites}


def profile_command(bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int, kind: str, sites: DataFrame,
                    include_all: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Site x offset values and their aggregate; ``sites`` are genes or intervals."""
    profile = PROFILES[kind](sites, _scope(bins, genome, None, include_all), pairs, genome, binsize, **options)
    return profile, PR.aggregate_profile(profile)


def matrix_command(bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int, bed: DataFrame,
                   how: str = "mean", stype: int = 0, include_all: bool = False) -> DataFrame:
    """Interval x sample matrix."""
    return PR.site_matrix(bed, _scope(bins, genome, None, include_all), pairs, genome, binsize, how, stype)


def signal_command(bins: DataFrame, pairs: DataFrame, genome: DataFrame, binsize: int, value: int = 0, norm: int = 0,
                   smooth: int = 0, totals: DataFrame | None = None) -> DataFrame:
    """Derived signals (0 ratio, 1 internal, 2 enrichment score) of the pairs with an input; no chromosome is left out."""
    both = lookup(pairs.filter("input IS NOT NULL"))
    labels = [r[0] for r in both.select("label").collect()]
    ratios = B.chip_input_ratio(bins, both, norm, totals) if norm in (1, 2) else None
    return T.genwig(bins, both, genome, binsize, labels, value, smooth, ratios=ratios)
