"""Read preprocessing: pairs, fragments, weights, duplicates, binning and QC."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FIX, autosomes, safe_ratio
from ..functions.tiles import TILE_BP, cut_to_tiles, div
from ..session import cut, derived_lookup, lookup
from .intervals import combine, overlaps_any, overlay

FIXED_FRAGMENT = 150
MAX_INSERT = 500
COVERAGE_READS = 5_000_000
COMPLEXITY_READS = 10_000_000
GENOME_ROW = "Genome"
SALT = 64


# ---- fragments -------------------------------------------------------------

def pair_filter(reads: DataFrame, max_insert: int = MAX_INSERT) -> DataFrame:
    """Pairs on one chromosome and not longer than ``max_insert``; adds ``flen``."""
    return (reads.filter((F.col("chrom") == F.col("mate_chrom")) & (F.abs("tlen") <= max_insert))
            .withColumn("flen", F.abs("tlen")))


def with_length(df: DataFrame, flen: int | DataFrame) -> DataFrame:
    """Add ``_flen``: one fragment length, or that of each sample (sample, fragment_length); a sample without one takes the fixed length."""
    if isinstance(flen, DataFrame):
        lengths = lookup(flen.select("sample", F.col("fragment_length").cast("int").alias("_flen")))
        return df.join(lengths, "sample", "left").withColumn("_flen", F.coalesce("_flen", F.lit(FIXED_FRAGMENT)))
    return df.withColumn("_flen", F.lit(int(flen)))


def extend(reads: DataFrame, flen: int | DataFrame = FIXED_FRAGMENT) -> DataFrame:
    """Single-end reads: the other fragment end by strand; known ends stay."""
    f5 = F.when(F.col("strand") == "+", F.col("f3") + F.col("_flen")).otherwise(F.col("f3") - F.col("_flen"))
    if "f5" in reads.columns:
        f5 = F.coalesce(F.col("f5"), f5)
    return with_length(reads, flen).withColumn("f5", f5.cast("int")).drop("_flen")


def fragments(reads: DataFrame, genome: DataFrame, rcenter: int = 0) -> DataFrame:
    """Closed fragment ``start..end``, optionally only its centre, inside the chromosome."""
    s, e = F.least("f3", "f5"), F.greatest("f3", "f5")
    if rcenter:
        twice = s + e - rcenter
        # half toward zero, as integers do; only fragments left of base 0 are negative
        s = F.when(twice >= 0, F.floor(twice / 2)).otherwise(F.ceil(twice / 2)).cast("int")
        e = s + rcenter
    return (reads.withColumn("start", s).withColumn("end", e)
            .join(lookup(genome).select("chrom", "length"), "chrom")
            .withColumn("start", F.greatest("start", F.lit(0)))
            .withColumn("end", F.least("end", F.col("length") - 1)).drop("length"))


def multimap_weight(reads: DataFrame) -> DataFrame:
    """Each of NH loci gets an equal share; a read without NH is unique."""
    return reads.withColumn("weight", F.col("weight") / F.coalesce("nh", F.lit(1)).cast("double"))


# ---- redundancy ------------------------------------------------------------

def site_keys(reads: DataFrame, paired: bool = False) -> list[str]:
    return ["sample", "chrom", "strand", "f3"] + (["f5"] if paired else [])


def duplicate_threshold(reads: DataFrame, genome: DataFrame) -> DataFrame:
    """Per sample: max(1, 10 x expected reads per mappable base)."""
    size = genome.agg(F.sum(F.coalesce("mappable", F.col("length").cast("long")))).first()[0]
    return (reads.groupBy("sample").agg(F.count("*").alias("n"))
            .select("sample", F.greatest(F.lit(1.0), F.col("n") * 10.0 / size).alias("threshold")))


def with_threshold(df: DataFrame, threshold: int | DataFrame) -> DataFrame:
    """Add ``_limit``: one threshold, or that of each sample (sample, threshold); a sample without one keeps one read a site."""
    if isinstance(threshold, DataFrame):
        limits = lookup(threshold.select("sample", F.floor("threshold").cast("long").alias("_limit")))
        return df.join(limits, "sample", "left").withColumn("_limit", F.coalesce("_limit", F.lit(1).cast("long")))
    return df.withColumn("_limit", F.lit(int(threshold)).cast("long"))


def nonredundant(reads: DataFrame, threshold: int | DataFrame = 1, paired: bool = False) -> DataFrame:
    """First ``threshold`` reads (by id) of every site.

    The rank filter is cut on the map side, so a site that holds a large share
    of the reads sends only ``threshold`` rows per input split. With a threshold per
    sample the cut uses the largest one and the rest is filtered behind it.
    """
    each = isinstance(threshold, DataFrame)
    top = max(1, int(threshold.agg(F.max("threshold")).first()[0] or 1)) if each else int(threshold)
    w = Window.partitionBy(*site_keys(reads, paired)).orderBy("read_id")
    out = reads.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    if each:
        out = with_threshold(out, threshold).filter(F.col("_rn") <= F.col("_limit")).drop("_limit")
    return out.drop("_rn")


def mark_duplicates(reads: DataFrame, threshold: int = 1, paired: bool = False) -> DataFrame:
    """All reads with a ``duplicate`` flag.

    Reads are ranked inside salted parts of a site first. Those beyond the
    threshold there are redundant for sure and stay spread; only
    ``SALT x threshold`` rows per site are ranked again together.
    """
    keys = site_keys(reads, paired)
    salt = F.pmod(F.xxhash64("read_id"), F.lit(SALT)).cast("int")
    first = Window.partitionBy(*keys, "_part").orderBy("read_id")
    df = (reads.withColumn("_part", salt)
          .withColumn("_r1", F.row_number().over(first))
          .withColumn("_part", F.when(F.col("_r1") <= threshold, -1).otherwise(F.col("_part"))))
    df = df.withColumn("_r2", F.row_number().over(first))
    return (df.withColumn("duplicate", (F.col("_part") >= 0) | (F.col("_r2") > threshold))
            .drop("_part", "_r1", "_r2"))


def site_counts(reads: DataFrame, threshold: int | DataFrame = 1, paired: bool = False) -> DataFrame:
    """Reads per site with the nonredundant share; the input of all count statistics."""
    sites = reads.groupBy(*site_keys(reads, paired)).agg(F.count("*").alias("n"))
    return with_threshold(sites, threshold).withColumn("n_nonred", F.least("n", "_limit")).drop("_limit")


def site_fragments(reads: DataFrame, genome: DataFrame, flen: int | DataFrame = FIXED_FRAGMENT,
                   threshold: int | DataFrame = 1, paired: bool = False, rcenter: int = 0) -> DataFrame:
    """Nonredundant fragments of reads with equal weight, folded by site.

    One row per site; ``weight`` is the number of reads that count. The reads
    themselves are folded map-side and never sorted.
    """
    sites = site_counts(reads, threshold, paired)
    return fragments(extend(sites, flen), genome, rcenter).withColumn("weight", F.col("n_nonred").cast("double"))


def sample_key(read_id: Column) -> Column:
    """Reproducible sampling key in 0..1000002 from the read id."""
    return ((read_id % 1000000007) * F.lit(2654435761) % 1000003).cast("long")


def library_complexity(reads: DataFrame, ncmp: int = COMPLEXITY_READS, threshold: int | DataFrame = 1,
                       paired: bool = False) -> DataFrame:
    """Nonredundant share of a ``ncmp``-read subset; ``enough`` is false when there are fewer reads."""
    totals = reads.groupBy("sample").agg(F.count("*").alias("n_total"))
    totals = derived_lookup(totals.withColumn(
        "_cut", F.least(F.lit(1.0), F.lit(float(ncmp)) / F.col("n_total")) * 1000003.0))
    subset = (reads.join(totals, "sample")
              .filter(sample_key(F.col("read_id")).cast("double") < F.col("_cut")))
    per = site_counts(subset, threshold, paired).groupBy("sample").agg(
        F.sum("n").alias("n_sampled"), F.sum("n_nonred").alias("n_nonred"))
    return per.join(totals.drop("_cut"), "sample").select(
        "sample", "n_sampled", "n_nonred", safe_ratio(F.col("n_nonred"), F.col("n_sampled")).alias("complexity"),
        (F.col("n_total") >= ncmp).alias("enough"))


# ---- strand shift ----------------------------------------------------------

def _matches_per_shift(lo: int, hi: int, tile: int):
    """Number of forward positions p with p+d on the reverse strand, d = lo..hi, in one tile.

    Each strand is a 0/1 track of bounded length; their correlation gives all shifts at once.
    """
    size = 1 << (tile + hi - lo).bit_length()

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        offset = pdf["pos"].to_numpy() - key[2] * tile
        fwd = pdf["fwd"].to_numpy()
        a, b = np.zeros(size), np.zeros(size)
        a[offset[fwd]] = 1.0
        b[offset[~fwd] - lo] = 1.0
        corr = np.fft.irfft(np.fft.rfft(b) * np.conj(np.fft.rfft(a)), size)
        n = np.rint(corr[: hi - lo + 1]).astype("int64")
        hit = np.flatnonzero(n)
        return pd.DataFrame({"sample": key[0], "chrom": key[1], "shift": (hit + lo).astype("int32"), "n": n[hit]})

    return count


def strand_shift_profile(reads: DataFrame, lo: int = 0, hi: int = 1000, pooled: bool = False,
                         tile: int = TILE_BP) -> DataFrame:
    """Jaccard index of forward 5' positions moved by d and reverse 5' positions.

    Defined on distinct positions; per chromosome or pooled over them. Work per
    tile is bounded by its length, however many reads pile up. Only the index and its
    maximum are given; further published scores are not specified by the reference.
    """
    sites = (reads.groupBy("sample", "chrom", "f3").agg(
        F.bool_or(F.col("strand") == "+").alias("has_fwd"), F.bool_or(F.col("strand") == "-").alias("has_rev")))
    fwd = sites.filter("has_fwd").select("sample", "chrom", F.col("f3").alias("pos"), F.lit(True).alias("fwd"),
                                         div(F.col("f3"), tile).alias("tile"))
    # a reverse position is offered to every tile whose forward positions can reach it
    first = div(F.greatest(F.col("f3") - hi, F.lit(0)), tile)
    last = div(F.greatest(F.col("f3") - lo, F.lit(0)), tile)
    rev = (sites.filter("has_rev")
           .withColumn("tile", F.explode(F.sequence(first, last)))
           .filter((F.col("f3") - F.col("tile") * tile) >= lo)
           .filter((F.col("f3") - F.col("tile") * tile) < tile + hi)
           .select("sample", "chrom", F.col("f3").alias("pos"), F.lit(False).alias("fwd"), "tile"))
    hits = (fwd.unionByName(rev).groupBy("sample", "chrom", "tile")
            .applyInPandas(_matches_per_shift(lo, hi, tile), "sample string, chrom string, shift int, n long"))
    by = ["sample"] if pooled else ["sample", "chrom"]
    per_shift = hits.groupBy(*by, "shift").agg(F.sum("n").alias("n_match"))
    strands = sites.groupBy(*by).agg(F.sum(F.col("has_fwd").cast("long")).alias("n_fwd"),
                                     F.sum(F.col("has_rev").cast("long")).alias("n_rev"))
    grid = strands.withColumn("shift", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    out = grid.join(per_shift, [*by, "shift"], "left").withColumn("n_match", F.coalesce("n_match", F.lit(0).cast("long")))
    return out.withColumn("jaccard", safe_ratio(F.col("n_match"), F.col("n_fwd") + F.col("n_rev") - F.col("n_match")))


def estimate_fragment_length(reads: DataFrame, genome: DataFrame, read_length: int = 0, margin: int = 0, lo: int = 0,
                             hi: int = 1000, include_all: bool = False) -> DataFrame:
    """Fragment length per sample from the profile pooled over numerically named chromosomes (or all)."""
    chroms = lookup(autosomes(genome, include_all).select("chrom"))
    profile = strand_shift_profile(reads.join(chroms, "chrom", "left_semi"), lo, hi, pooled=True)
    return fragment_length(profile, read_length, margin)


def with_every_sample(lengths: DataFrame, reads: DataFrame) -> DataFrame:
    """A length for each sample of the reads: the fixed one where none could be estimated, as without reads on numbered chromosomes."""
    return (reads.select("sample").distinct().join(lengths, "sample", "left")
            .withColumn("fragment_length", F.coalesce("fragment_length", F.lit(FIXED_FRAGMENT))))


def fragment_length(profile: DataFrame, read_length: int = 0, margin: int = 0) -> DataFrame:
    """Shift at the maximum, the peak at the read length left out; smallest shift on ties."""
    p = profile.filter(F.abs(F.col("shift") - read_length) > margin) if read_length else profile
    by = [c for c in ("sample", "chrom") if c in profile.columns]
    return p.groupBy(*by).agg(
        F.max_by("shift", F.struct(F.col("jaccard"), (-F.col("shift")).alias("tie"))).alias("fragment_length"),
        F.max("jaccard").alias("jaccard"))


# ---- binning ---------------------------------------------------------------

def _weight_fixed(frags: DataFrame) -> Column:
    return (F.col("weight") * float(FIX)).cast("long") if "weight" in frags.columns else F.lit(FIX).cast("long")


def bin_reads(frags: DataFrame, binsize: int = 100) -> DataFrame:
    """Full weight of a fragment to every bin it touches -> (sample, chrom, bin, v)."""
    return (frags.select("sample", "chrom", _weight_fixed(frags).alias("w"),
                         F.explode(F.sequence(div("start", binsize), div("end", binsize))).alias("bin"))
            .groupBy("sample", "chrom", "bin").agg(F.sum("w").alias("v")))


def bin_read_ends(frags: DataFrame, binsize: int = 100, long_fragment: int = 300) -> DataFrame:
    """Paired mode: of fragments longer than 300 bp only the two read regions count.

    Left region start..start+len_f3, right region end-len_f5..end.
    """
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))
    ends = F.array(F.struct(F.col("start").alias("s"), F.least(F.col("start") + F.col("len_f3"), F.col("end")).alias("e")),
                   F.struct(F.greatest(F.col("end") - F.col("len_f5"), F.col("start")).alias("s"), F.col("end").alias("e")))
    part = F.explode(F.when(F.col("end") - F.col("start") > long_fragment, ends).otherwise(whole)).alias("p")
    parts = frags.select("sample", "chrom", *(["weight"] if "weight" in frags.columns else []), part)
    return bin_reads(parts.withColumn("start", F.col("p.s")).withColumn("end", F.col("p.e")), binsize)


# ---- quality ---------------------------------------------------------------

def with_genome_row(per_chrom: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Chromosome rows plus one ``Genome`` row per sample with the sums."""
    out = per_chrom.rollup("sample", "chrom").agg(*[F.sum(c).alias(c) for c in sums], F.grouping_id().alias("_g"))
    return (out.filter(F.col("_g") <= 1)
            .withColumn("chrom", F.when(F.col("_g") == 1, GENOME_ROW).otherwise(F.col("chrom"))).drop("_g"))


def effective_size(genome: DataFrame) -> DataFrame:
    return genome.select("chrom", F.col("length").cast("long").alias("length"),
                         F.coalesce("mappable", F.col("length").cast("long")).alias("mappable"))


def read_depth(counts: DataFrame, flen: int | DataFrame) -> DataFrame:
    """n_nonred x flen / mappable length on rows that carry both."""
    bases = F.col("n_nonred") * F.col("_flen").cast("double")
    return with_length(counts, flen).withColumn("depth", safe_ratio(bases, F.col("mappable"))).drop("_flen")


def read_counts(reads: DataFrame, genome: DataFrame, threshold: int | DataFrame = 1, paired: bool = False) -> DataFrame:
    """Total / nonredundant / redundant reads by strand, per chromosome and genome."""
    def by_strand(c: str) -> list[Column]:
        return [F.sum(c).alias(c), F.sum(F.when(F.col("strand") == "+", F.col(c)).otherwise(0)).alias(c + "_fwd"),
                F.sum(F.when(F.col("strand") == "-", F.col(c)).otherwise(0)).alias(c + "_rev")]
    sites = site_counts(reads, threshold, paired).withColumn("n_red", F.col("n") - F.col("n_nonred"))
    per = sites.groupBy("sample", "chrom").agg(*by_strand("n"), *by_strand("n_nonred"), *by_strand("n_red"))
    per = per.join(effective_size(genome), "chrom")
    sums = [c for c in per.columns if c not in ("sample", "chrom")]
    out = with_genome_row(per, sums)
    # a chromosome without reads still belongs to the genome size
    size = effective_size(genome).agg(F.sum("length").alias("gl"), F.sum("mappable").alias("gm")).first()
    whole = F.col("chrom") == GENOME_ROW
    return (out.withColumn("length", F.when(whole, F.lit(size["gl"])).otherwise(F.col("length")))
            .withColumn("mappable", F.when(whole, F.lit(size["gm"])).otherwise(F.col("mappable"))))


def frip(frags: DataFrame, bed: DataFrame, max_fragment: int | None = None) -> DataFrame:
    """Nonredundant fragments on any peak base, per chromosome and genome.

    ``frags`` are nonredundant fragments, as reads or folded by site. Equal
    fragments are folded to one row with a count before the join.
    """
    n = F.sum("n_nonred") if "n_nonred" in frags.columns else F.count("*")
    folded = frags.groupBy("sample", "chrom", "start", "end").agg(n.alias("n"))
    hit = overlaps_any(folded, bed, max_fragment).groupBy("sample", "chrom").agg(F.sum("n").alias("n_inbed"))
    total = folded.groupBy("sample", "chrom").agg(F.sum("n").alias("n_nonred"))
    per = total.join(hit, ["sample", "chrom"], "left").withColumn(
        "n_inbed", F.coalesce("n_inbed", F.lit(0).cast("long")))
    return with_genome_row(per, ["n_nonred", "n_inbed"]).withColumn(
        "frip", safe_ratio(F.col("n_inbed"), F.col("n_nonred")))


def genome_coverage(frags: DataFrame, considered: DataFrame) -> DataFrame:
    """Covered share of the considered bases, per chromosome and genome.

    ``considered`` are disjoint segments (mappable and outside peaks); each tile
    a sample has reads in is swept against the segments of that tile. They are used
    more than once: pass a stored table. Events are folded per base before the sweep, so a tile holds at most its length in rows.
    """
    by = ["sample", "chrom"]
    seen = (frags.select(*by, F.explode(F.sequence(div("start", TILE_BP), div("end", TILE_BP))).alias("tile"))
            .distinct())
    seg = cut_to_tiles(considered.select("chrom", "start", "end")).join(seen, ["chrom", "tile"])
    both = overlay({"n_cov": frags, "n_seg": seg.select(*by, "start", "end")}, by)
    hit = (both.filter((F.col("n_cov") > 0) & (F.col("n_seg") > 0))
           .groupBy(*by).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered")))
    base = considered.groupBy("chrom").agg(F.sum(F.col("end") - F.col("start") + 1).alias("considered"))
    base = base.unionByName(base.agg(F.lit(GENOME_ROW).alias("chrom"), F.sum("considered").alias("considered")))
    return (with_genome_row(hit, ["covered"]).join(base, "chrom")
            .withColumn("coverage", safe_ratio(F.col("covered"), F.col("considered"))))


def genome_coverage_at(frags: DataFrame, considered: DataFrame, bed: DataFrame | None = None,
                       n_reads: int = COVERAGE_READS, max_fragment: int | None = None) -> DataFrame:
    """Coverage after down-sampling to ``n_reads`` reads outside peaks, by read id.

    ``enough`` is false when the sample had fewer reads than asked for.
    """
    outside = frags if bed is None else overlaps_any(frags, bed, max_fragment, anti=True)
    counts = outside.groupBy("sample").agg(F.count("*").alias("n_outside"))
    counts = derived_lookup(counts.withColumn(
        "_cut", F.least(F.lit(1.0), F.lit(float(n_reads)) / F.col("n_outside")) * 1000003.0))
    kept = (outside.join(counts, "sample").filter(sample_key(F.col("read_id")).cast("double") < F.col("_cut")))
    cov = genome_coverage(kept, considered)
    return cov.join(counts.select("sample", (F.col("n_outside") >= n_reads).alias("enough")), "sample")


def length_distributions(reads: DataFrame) -> DataFrame:
    """Histogram of read and fragment lengths: (sample, kind, len, n)."""
    kinds = F.explode(F.array(
        F.struct(F.lit("read_f3").alias("kind"), F.col("len_f3").cast("int").alias("len")),
        F.struct(F.lit("read_f5").alias("kind"), F.col("len_f5").cast("int").alias("len")),
        F.struct(F.lit("fragment").alias("kind"), F.abs("tlen").cast("int").alias("len"))))
    return (reads.select("sample", kinds.alias("k")).select("sample", "k.kind", "k.len")
            .filter(F.col("len").isNotNull()).groupBy("sample", "kind", "len").agg(F.count("*").alias("n")))


def most_frequent_length(hist: DataFrame) -> DataFrame:
    return hist.groupBy("sample", "kind").agg(
        F.max_by("len", F.struct(F.col("n"), (-F.col("len")).alias("tie"))).alias("len"), F.max("n").alias("n"))


def qc_stats(reads: DataFrame, genome: DataFrame, bed: DataFrame | None = None, flen: int | DataFrame = FIXED_FRAGMENT,
             threshold: int | DataFrame = 1, norm: str = "NONE", nrpm: int = 20_000_000, ndepth: float = 1.0,
             mappable: DataFrame | None = None, weighted: DataFrame | None = None,
             paired: bool = False, rcenter: int = 0, max_insert: int | None = None) -> DataFrame:
    """Quality table: one ``Genome`` row and the chromosome rows of every sample.

    ``paired`` reads are one site per pair of ends, and coverage and peak share take the real fragments
    (``max_insert`` bounds their length).

    ``weighted`` (sample, chrom, strand, weight) gives the read totals after GC weighting.
    """
    from .bins import scale_factors
    counts = read_depth(read_counts(reads, genome, threshold, paired), flen)
    scaled = scale_factors(counts, norm, nrpm, ndepth)
    genome_total = F.max(F.when(F.col("chrom") == GENOME_ROW, F.col("n"))).over(Window.partitionBy("sample"))
    out = (scaled.withColumn("pct_genome", 100.0 * safe_ratio(F.col("n"), genome_total))
           .withColumn("pct_mappable", safe_ratio(F.col("mappable"), F.col("length"))))
    for kind in ("nonred", "red"):
        for suffix in ("", "_fwd", "_rev"):
            out = out.withColumn(f"pct_{kind}{suffix}",
                                 100.0 * safe_ratio(F.col(f"n_{kind}{suffix}"), F.col(f"n{suffix}")))
    frags = site_fragments(reads, genome, flen, threshold, paired, rcenter)
    whole = genome.select("chrom", F.lit(0).alias("start"), (F.col("length") - 1).alias("end"))
    considered = mappable if mappable is not None else whole
    if bed is not None:
        considered = cut(combine(considered, bed, "subtract"))
    cov = genome_coverage(frags, considered).select("sample", "chrom", "covered", "considered", "coverage")
    out = out.join(cov, ["sample", "chrom"], "left")
    if bed is not None:
        longest = max_insert if paired else None if isinstance(flen, DataFrame) else flen
        inbed = frip(frags, bed, longest).select("sample", "chrom", "n_inbed", "frip")
        out = out.join(inbed, ["sample", "chrom"], "left")
    if weighted is not None:
        per = weighted.groupBy("sample", "chrom").agg(
            F.sum("weight").alias("after_gc"),
            F.sum(F.when(F.col("strand") == "+", F.col("weight")).otherwise(0.0)).alias("after_gc_fwd"),
            F.sum(F.when(F.col("strand") == "-", F.col("weight")).otherwise(0.0)).alias("after_gc_rev"))
        per = with_genome_row(per, ["after_gc", "after_gc_fwd", "after_gc_rev"])
        out = out.join(per, ["sample", "chrom"], "left")
        for suffix in ("", "_fwd", "_rev"):
            out = out.withColumn(f"pct_after_gc{suffix}",
                                 100.0 * safe_ratio(F.col(f"after_gc{suffix}"), F.col(f"n{suffix}")))
    return out


def stats_summary(stats: DataFrame, complexity: DataFrame | None = None,
                  threshold: int | DataFrame = 1) -> DataFrame:
    """One line per sample: reads, strands, threshold, nonredundant, complexity, depth, coverage."""
    g = with_threshold(stats.filter(F.col("chrom") == GENOME_ROW), threshold).select(
        "sample", "n", "n_fwd", "n_rev", F.col("_limit").alias("threshold"), "n_nonred", "n_red", "depth", "coverage")
    if complexity is not None:
        g = g.join(complexity.select("sample", "complexity"), "sample", "left")
    return g


