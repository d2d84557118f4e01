"""GC content: windows, distributions, read weights.

A sequence is stored in chunks ``(chrom, chunk, seq)`` of equal length (the last
one may be shorter). Windows need the head of the next chunk only.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from ..functions.tiles import cut_to_tiles, div
from ..session import derived_lookup, lookup
from .reads import with_length

CHUNK = 16384
#: Chunks whose counts are made at a time.
SLICE = 32
GC_LENGTH = 120
EDGE = 5
MIN_GENOME_SHARE = 1e-5
MIN_DEPTH = 1e-3


def window_length(flen: int, flen4gc: int = GC_LENGTH) -> int:
    return min(flen4gc, flen - 2 * EDGE)


def chunk_sequences(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """Whole sequences (chrom, seq) as chunks; the text is walked once."""
    parts = F.regexp_extract_all("seq", F.lit("(.{1,%d})" % size), F.lit(1))
    return sequences.select("chrom", F.posexplode(parts).alias("chunk", "seq"))


def genome_table(chunks: DataFrame) -> DataFrame:
    """Sequence lengths."""
    return chunks.groupBy("chrom").agg(F.sum(F.length("seq").cast("long")).alias("length"))


def _with_halo(chunks: DataFrame, w: int, size: int) -> DataFrame:
    if w > size:
        raise ValueError("the window is longer than a chunk")
    head = chunks.select("chrom", (F.col("chunk") - 1).alias("chunk"), F.substring("seq", 1, w).alias("_next"))
    return (chunks.join(head, ["chrom", "chunk"], "left")
            .select("chrom", "chunk", F.length("seq").alias("n_own"),
                    F.concat("seq", F.coalesce("_next", F.lit(""))).alias("text")))


def _gc_kernel():
    """The window counter as a closure, so that executors get it with the task."""
    is_gc = np.isin(np.arange(256), list(b"GCgc"))
    is_other = ~np.isin(np.arange(256), list(b"ACGTacgt"))

    def track(text: str, n_own: int, w: int) -> np.ndarray:
        """G/C letters in i+1..i+w for the own bases; -1 where another letter than ACGT is inside."""
        b = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
        gc, other = np.zeros((2, len(b) + w + 1), dtype=np.int32)
        for sums, letters in ((gc, is_gc), (other, is_other)):
            np.cumsum(letters[b], out=sums[1: len(b) + 1])
            sums[len(b) + 1:] = sums[len(b)]
        lo, hi = slice(1, n_own + 1), slice(w + 1, n_own + w + 1)
        return np.where(other[hi] > other[lo], -1, gc[hi] - gc[lo]).astype("int32")
    return track


def _by_slices(df: DataFrame, w: int, schema: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of chunks with ``gc``, the counts of the own bases or of those listed in ``at``. A batch of chunks is read and written a few
    chunks at a time, so a task holds the batch and the counts of one slice only."""
    kernel = _gc_kernel()

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                cols = {n: part.column(n) for n in part.schema.names}
                found = []
                for i in range(part.num_rows):
                    track = kernel(cols["text"][i].as_py(), cols["n_own"][i].as_py(), w)
                    found.append(track[cols["at"][i].values.to_numpy()] if "at" in cols else track)
                yield pa.RecordBatch.from_arrays([*[cols[c] for c in columns], pa.array(found, pa.list_(pa.int32()))], [*columns, "gc"])
    return df.mapInArrow(run, schema)


def gc_windows(chunks: DataFrame, w: int, size: int = CHUNK) -> DataFrame:
    """(chrom, pos, gc) for every base."""
    halo = _by_slices(_with_halo(chunks, w, size), w, "chrom string, chunk int, gc array<int>", ["chrom", "chunk"])
    return halo.select("chrom", "chunk", F.posexplode("gc").alias("i", "gc")).select(
        "chrom", (F.col("chunk") * size + F.col("i")).alias("pos"), "gc")


def gc_at_positions(chunks: DataFrame, positions: DataFrame, w: int, size: int = CHUNK) -> DataFrame:
    """Window GC at the distinct (chrom, pos) asked for.

    Positions are gathered per chunk, at most ``size`` of them, so only the
    wanted bases leave the chunk.
    """
    wanted = (positions.select("chrom", div("pos", size).alias("chunk"), (F.col("pos") % size).cast("int").alias("at"))
              .groupBy("chrom", "chunk").agg(F.collect_set("at").alias("at")))
    hit = _with_halo(chunks, w, size).join(wanted, ["chrom", "chunk"])
    hit = hit.withColumn("at", F.filter("at", lambda a: a < F.col("n_own")))
    got = _by_slices(hit, w, "chrom string, chunk int, at array<int>, gc array<int>", ["chrom", "chunk", "at"])
    return got.select("chrom", "chunk", F.explode(F.arrays_zip("at", "gc")).alias("z")).select(
        "chrom", (F.col("chunk") * size + F.col("z.at")).alias("pos"), F.col("z.gc").alias("gc"))


def gc_genome_distribution(chunks: DataFrame, lengths: DataFrame, w: int, unmappable: DataFrame | None = None,
                           size: int = CHUNK) -> DataFrame:
    """Histogram of the window GC over mappable bases, 5+w off both ends (chrom, gc, n).

    Pass the chunks of the longest chromosome to follow the reference. Each chunk
    gives a histogram of w+1 cells; bases do not become rows.
    """
    margin, kernel = EDGE + w, _gc_kernel()

    @F.pandas_udf("array<long>")
    def histogram(text: pd.Series, n_own: pd.Series, chunk: pd.Series, length: pd.Series,
                  off: pd.Series) -> pd.Series:
        out = []
        for t, n, c, ln, gaps in zip(text, n_own, chunk, length, off):
            track = kernel(t, n, w)
            pos = np.arange(n) + c * size
            keep = (track >= 0) & (pos >= margin) & (pos < ln - margin)
            for g in gaps:
                keep[g["s"]: g["e"] + 1] = False
            out.append(np.bincount(track[keep], minlength=w + 1))
        return pd.Series(out)

    halo = _with_halo(chunks, w, size).join(lookup(lengths.select("chrom", "length")), "chrom")
    no_gaps = F.array().cast("array<struct<s:int,e:int>>")
    if unmappable is None:
        halo = halo.withColumn("off", no_gaps)
    else:
        from .intervals import tiled_union
        cut = cut_to_tiles(tiled_union(unmappable).select("chrom", "start", "end"), size)
        gaps = cut.groupBy("chrom", F.col("tile").alias("chunk")).agg(F.collect_list(F.struct(
            (F.col("start") % size).alias("s"), (F.col("end") % size).alias("e"))).alias("off"))
        halo = halo.join(gaps, ["chrom", "chunk"], "left").withColumn("off", F.coalesce("off", no_gaps))
    cells = halo.select("chrom", F.posexplode(histogram("text", "n_own", "chunk", "length", "off")).alias("gc", "n"))
    return cells.groupBy("chrom", "gc").agg(F.sum("n").alias("n"))


def read_window_start(reads: DataFrame, lengths: DataFrame, flen: int | DataFrame) -> DataFrame:
    """First window base of every read: 5 inside the fragment, inside the chromosome."""
    fwd = F.least(F.col("f3") + EDGE, F.col("length") - 1)
    rev = F.greatest(F.col("f3") - F.col("_flen") + EDGE, F.lit(0))
    return (with_length(reads, flen).join(lookup(lengths.select("chrom", "length")), "chrom")
            .withColumn("pos", F.when(F.col("strand") == "+", fwd).otherwise(rev).cast("int")).drop("length", "_flen"))


def _sample_key(df: DataFrame) -> list[str]:
    return ["sample"] if "sample" in df.columns else []


def gc_read_distribution(reads: DataFrame, chunks: DataFrame, lengths: DataFrame, flen: int | DataFrame, w: int,
                         unmappable: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """Histogram of the window GC of reads (chrom, gc, n), of each sample where reads have one;
    windows with an unmappable end are left out."""
    key = _sample_key(reads)
    at = read_window_start(reads, lengths, flen).groupBy(*key, "chrom", "pos").agg(F.count("*").alias("n"))
    if unmappable is not None:
        from .intervals import overlaps_any
        for shift in (0, w):
            at = at.withColumn("_p", F.col("pos") + shift)
            at = overlaps_any(at, unmappable, 0, anti=True, span=("_p", "_p")).drop("_p")
    gc = gc_at_positions(chunks, at, w, size)
    return (at.join(gc, ["chrom", "pos"]).filter(F.col("gc") >= 0)
            .groupBy(*key, "chrom", "gc").agg(F.sum("n").alias("n")))


def gc_weight(genome_hist: DataFrame, read_hist: DataFrame, w: int, ignore_depth: bool = False) -> DataFrame:
    """Shares, depth and weight per GC count 0..w: genome share / read share, with the two floors.

    A read histogram with samples gives w+1 rows for each of them; a sample without a read in it has none.
    """
    key = _sample_key(read_hist)
    g = genome_hist.groupBy("gc").agg(F.sum("n").alias("ng"))
    r = read_hist.groupBy(*key, "gc").agg(F.sum("n").alias("nr"))
    if key:
        grid = r.select(*key).distinct().select(*key, F.explode(F.sequence(F.lit(0), F.lit(w))).alias("gc"))
    else:
        grid = g.sparkSession.range(w + 1).select(F.col("id").cast("int").alias("gc"))
    zero = F.lit(0).cast("long")
    both = (grid.join(g, "gc", "left").join(r, [*key, "gc"], "left")
            .select(*key, "gc", F.coalesce("ng", zero).alias("ng"), F.coalesce("nr", zero).alias("nr")))
    tg, tr = (F.sum(c).over(Window.partitionBy(*key)).cast("double") for c in ("ng", "nr"))  # w+1 rows a sample
    both = both.select(*key, "gc", safe_ratio(F.col("ng"), tg).alias("genome_prop"), safe_ratio(F.col("nr"), tr).alias("reads_prop"),
                       safe_ratio(F.col("nr"), F.col("ng")).alias("depth"))
    few = (F.col("reads_prop") == 0) | (F.col("genome_prop") < MIN_GENOME_SHARE)
    weight = F.when(few, 0.0)
    if not ignore_depth:
        weight = weight.when(F.col("depth") < MIN_DEPTH, 1.0)
    return both.withColumn("weight", weight.otherwise(safe_ratio(F.col("genome_prop"), F.col("reads_prop"))))


def gc_reweight(reads: DataFrame, chunks: DataFrame, lengths: DataFrame, weights: DataFrame, flen: int | DataFrame, w: int,
                size: int = CHUNK) -> DataFrame:
    """Read weight x weight of its window GC (of its sample, where the weights have one); unchanged where the window holds another letter."""
    placed = read_window_start(reads, lengths, flen)
    gc = gc_at_positions(chunks, placed.select("chrom", "pos").distinct(), w, size)
    key = _sample_key(weights)
    table = derived_lookup(weights.select(*key, "gc", F.col("weight").alias("_w")))
    return (placed.join(gc, ["chrom", "pos"], "left").join(table, [*key, "gc"], "left")
            .withColumn("weight", F.col("weight") * F.coalesce("_w", F.lit(1.0))).drop("_w", "gc", "pos"))


def gc_summit(read_hist: DataFrame) -> DataFrame:
    """Most frequent GC count of reads, of each sample where there is one; the lowest on ties."""
    key = _sample_key(read_hist)
    total = read_hist.groupBy(*key, "gc").agg(F.sum("n").alias("n"))
    return total.groupBy(*key).agg(F.max_by("gc", F.struct(F.col("n"), (-F.col("gc")).alias("tie"))).alias("gc"), F.max("n").alias("n"))


def gc_content_track(chunks: DataFrame, window: int, size: int = CHUNK) -> DataFrame:
    """Percent G/C of the ACGT letters per window."""
    lo = F.col("chunk") * size
    parts = chunks.withColumn("win", F.explode(F.sequence(div(lo, window), div(lo + F.length("seq") - 1, window))))
    begin = F.greatest(F.col("win") * window - lo, F.lit(0))
    part = F.upper(F.substring("seq", begin + 1, (F.col("win") + 1) * window - lo - begin))
    parts = parts.select("chrom", (F.col("win") * window).alias("start"), part.alias("p"))
    known = F.length(F.translate("p", "N", ""))
    at = F.length(F.translate("p", "GCN", ""))
    return (parts.groupBy("chrom", "start").agg(F.sum(known - at).alias("gc"), F.sum(known).alias("known"))
            .select("chrom", "start", (100.0 * safe_ratio(F.col("gc"), F.col("known"))).alias("value")))
