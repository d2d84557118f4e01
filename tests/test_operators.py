"""Hand-computed cases."""
import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from peakgrid.functions import scalars as S
from peakgrid.operators import barcodes as BC
from peakgrid.operators import bins as B
from peakgrid.operators import gc as GC
from peakgrid.operators import genes as G
from peakgrid.operators import loops as L
from peakgrid.operators import peaks as P
from peakgrid.operators import profiles as PR
from peakgrid.operators import reads as R
from peakgrid.operators import tracks as T

READ = "sample string, read_id long, chrom string, strand string, f3 int, weight double"
BINS = "sample string, chrom string, bin int, v long"


def test_fragments_are_clamped_and_binned(spark, genome):
    df = spark.createDataFrame([("s", 1, "chr1", "+", 95, 1.0), ("s", 2, "chr1", "-", 50, 1.0), ("s", 3, "chr1", "+", 990, 0.5)], READ)
    f = R.fragments(R.extend(df, 150), genome)
    assert rows(f, "read_id", "start", "end") == [(1, 95, 245), (2, 0, 50), (3, 990, 999)]
    assert rows(R.bin_reads(f, 100), "bin", "v") == [(0, 20000), (1, 10000), (2, 10000), (9, 5000)]


def test_one_bin_fragments_sum_to_the_reads(spark, genome):
    df = spark.createDataFrame([("s", i, "chr1", "+", 10 * i, 1.0) for i in range(50)], READ)
    b = R.bin_reads(R.fragments(R.extend(df, 0), genome), 100)
    assert b.agg(F.sum("v")).first()[0] == 50 * 10000


def test_extra_bin_when_length_is_a_multiple(spark, genome):
    b = spark.createDataFrame([("s", "chr1", 3, 10000)], BINS)
    d = B.densify(b, genome, 100, ["s"], tile=4)
    per = {r["chrom"]: r["n"] for r in d.groupBy("chrom").agg(F.count("*").alias("n")).collect()}
    assert per == {"chr1": 11, "chr2": 6}
    assert d.agg(F.sum("v")).first()[0] == 10000


def test_fixed_point_truncates_toward_zero(spark):
    df = spark.createDataFrame([(1.99999, -1.99999)], "a double, b double")
    assert df.select(S.to_fixed(F.col("a")), S.to_fixed(F.col("b"))).first()[:] == (19999, -19999)
    assert df.select(S.safe_ratio(F.col("a"), F.lit(0))).first()[0] == 0


def test_mappability_above_the_threshold_only(spark):
    b = spark.createDataFrame([("s", "c", 0, 10000), ("s", "c", 1, 10000), ("s", "c", 2, 10000)], BINS)
    m = spark.createDataFrame([("c", 0, 0.5), ("c", 1, 0.3)], "chrom string, bin int, fraction double")
    assert rows(B.mappability_normalise(b, m), "bin", "v") == [(0, 20000), (1, 10000), (2, 10000)]


def test_rebin_takes_the_unweighted_mean(spark):
    r = spark.createDataFrame([("s", "c", 0, 150, 1.0), ("s", "c", 150, 160, 4.0)],
                              "sample string, chrom string, start int, end int, value double")
    assert rows(B.rebin(r, 100), "bin", "v") == [(0, 10000), (1, 25000)]


def test_scaling_types(spark, genome):
    df = spark.createDataFrame([("s", i, c, "+", i, 1.0) for i, c in enumerate(["chr1"] * 3 + ["chr2"])], READ)
    d = R.read_depth(R.read_counts(df, genome), 150)
    w = {k: {r["chrom"]: r["w"] for r in B.scale_factors(d, k, 100, 1.0).collect()} for k in ("GR", "GD", "CR", "CD", "NONE")}
    assert w["GR"] == {"chr1": 25.0, "chr2": 25.0, "Genome": 25.0}
    assert w["CR"]["chr1"] == pytest.approx(100 * (1000 / 1500) / 3) and w["CR"]["chr2"] == pytest.approx(100 * (500 / 1500))
    assert w["GD"]["chr1"] == pytest.approx(1 / (4 * 150 / 1500)) and w["CD"]["chr2"] == pytest.approx(500 / 150)
    assert w["NONE"]["Genome"] == 1


def test_presets():
    assert P.peak_presets("SHARP") == P.PeakParams(5, 4, 0, 0, 5)
    assert P.peak_presets("BROAD").smooth == 20 and P.peak_presets("ENRICH").height == 5 and P.peak_presets("GV").ratio == 2


def test_peaks_refuse_thresholds_that_take_empty_bins(spark, genome):
    pairs = spark.createDataFrame([("S", "a", "b")], "label string, chip string, input string")
    b = spark.createDataFrame([("a", "chr1", 0, 10000)], BINS)
    with pytest.raises(ValueError):
        P.call_peaks(b, pairs, genome, 100, P.PeakParams(0, 0, 0, 0, 0))


def test_shared_input_serves_several_pairs(spark, genome):
    pairs = spark.createDataFrame([("A", "a", "in"), ("B", "b", "in"), ("C", "a", None)], "label string, chip string, input string")
    b = spark.createDataFrame([("a", "chr1", 1, 40000), ("b", "chr1", 1, 60000), ("in", "chr1", 1, 20000)], BINS)
    s = P.scored_bins(b, pairs, genome, 100)
    assert rows(s, "label", "bin", "enrichment") == [("A", 1, 2.0), ("B", 1, 3.0), ("C", 1, 0.0)]
    r = B.chip_input_ratio(b, pairs, 1)
    assert rows(r, "label", "chrom", "ratio") == [("A", "chr1", 2.0), ("B", "chr1", 3.0), ("C", "chr1", 1.0)]


def test_totals_of_the_storing_pass(spark, genome, monkeypatch):
    """The same totals from the pass that stores, from the stored table, and from a pass of its own; empty chromosomes count 0."""
    b = spark.createDataFrame([("a", "chr1", i, 10000 * i + 9999) for i in range(9)] + [("a", "chr2", 1, 5000), ("b", "chr1", 3, 70000)], BINS)
    want = sorted([("a", "chr1", 44), ("a", "chr2", 0), ("a", "Genome", 44), ("b", "chr1", 7), ("b", "chr2", 0), ("b", "Genome", 7)])
    for limit in (100, 0):
        monkeypatch.setattr(B, "OBSERVED_SUMS", limit)
        kept, totals = B.stored_with_totals(b, genome, ["a", "b"])
        assert rows(totals, "sample", "chrom", "total") == want
        assert rows(kept, "sample", "chrom", "bin", "v") == rows(b, "sample", "chrom", "bin", "v")
    pairs = spark.createDataFrame([("S", "a", "b")], "label string, chip string, input string")
    assert rows(B.chip_input_ratio(None, pairs, 1, totals), "chrom", "ratio") == [("chr1", 44 / 7), ("chr2", 44 / 7)]
    assert rows(B.chip_input_ratio(b, pairs, 1), "chrom", "ratio") == [("chr1", 44 / 7), ("chr2", 44 / 7)]
    none, empty = B.stored_with_totals(b.limit(0), genome, ["a"])
    assert none.count() == 0 and {r["total"] for r in empty.collect()} == {0}


GENE = "chrom string, tid string, gid string, tname string, gname string, strand string, tx_start int, tx_end int, gtype string, tag string"


def test_profile_reverses_the_minus_strand(spark, genome):
    genes = spark.createDataFrame([("chr1", "f", "g", "f", "g", "+", 500, 600, "x", ""), ("chr1", "r", "g", "r", "g", "-", 400, 500, "x", ""),
                                   ("chr1", "out", "g", "o", "g", "+", 150, 300, "x", ""),
                                   ("chr1", "no", "g", "n", "g", "+", 500, 600, "retained_intron", "")], GENE)
    bins = spark.createDataFrame([("a", "chr1", 4, 10000), ("a", "chr1", 6, 30000)], BINS)
    pairs = spark.createDataFrame([("S", "a", "b")], "label string, chip string, input string")
    p = PR.profile_tss(genes, bins, pairs, genome, 100, 200)
    assert rows(p.filter("value <> 0"), "site", "offset", "value") == [("f", -1, 1.0), ("f", 1, 3.0), ("r", -1, 3.0), ("r", 1, 1.0)]
    assert p.select("site").distinct().count() == 2 and p.count() == 10
    with pytest.raises(ValueError):
        PR.profile_tss(genes, bins, pairs, genome, 100, 100)


def test_gene_body_skips_genes_that_leave_the_chromosome(spark):
    genome = spark.createDataFrame([("c", 10000, None, 0)], "chrom string, length int, mappable long, ord int")
    genes = spark.createDataFrame([("c", "in", "g", "f", "g", "+", 3000, 5000, "x", ""), ("c", "out", "g", "r", "g", "-", 900, 5000, "x", "")], GENE)
    bins = spark.createDataFrame([("a", "c", i, 10000 * (1 + (30 <= i < 50))) for i in range(101)], BINS)
    pairs = spark.createDataFrame([("S", "a", "b")], "label string, chip string, input string")
    for p in (PR.profile_gene_body(genes, bins, pairs, genome, 100), PR.profile_gene_body_fixed(genes, bins, pairs, genome, 100, 1000)):
        got = {r["offset"]: r["value"] for r in p.collect()}
        assert p.select("site").distinct().count() == 1 and sorted(got) == list(range(-100, 200))
        assert got[-50] == 1 and got[0] == 2 and got[99] == 2 and got[150] == 1


def test_aggregate_uses_the_row_count(spark):
    p = spark.createDataFrame([("S", "a", 0, 1.0), ("S", "b", 0, 3.0)], "label string, site string, offset int, value double")
    r = PR.aggregate_profile(p).first()
    assert (r["mean"], r["n"]) == (2.0, 2) and r["ci"] == pytest.approx(1.96 * math.sqrt(2) / math.sqrt(2))


def test_gc_windows_with_other_letters(spark):
    seq = spark.createDataFrame([("c", "GCATNGGCA")], "chrom string, seq string")
    chunks = GC.chunk_sequences(seq, 4)
    assert rows(chunks, "chunk", "seq") == [(0, "GCAT"), (1, "NGGC"), (2, "A")]
    got = [g for _, g in rows(GC.gc_windows(chunks, 3, 4), "pos", "gc")]
    assert got == [1, -1, -1, -1, 3, 2, 1, 0, 0]
    pos = spark.createDataFrame([("c", 4), ("c", 1), ("c", 8), ("c", 99)], "chrom string, pos int")
    assert rows(GC.gc_at_positions(chunks, pos, 3, 4), "pos", "gc") == [(1, -1), (4, 3), (8, 0)]


def test_gc_weight_rules(spark):
    h = "gc int, n long"
    g = spark.createDataFrame([(0, 500), (1, 500000), (2, 499500)], h)
    r = spark.createDataFrame([(1, 100), (2, 900)], h)
    got = [r["weight"] for r in GC.gc_weight(g, r, 3).orderBy("gc").collect()]
    assert got[0] == 0 and got[1] == 1 and got[2] == pytest.approx(0.4995 / 0.9) and got[3] == 0
    free = [x["weight"] for x in GC.gc_weight(g, r, 3, ignore_depth=True).orderBy("gc").collect()]
    assert free[1] == pytest.approx(0.5 / 0.1)


def test_masked_gc_distribution(spark):
    seq = spark.createDataFrame([("c", "ACGT" * 20)], "chrom string, seq string")
    chunks = GC.chunk_sequences(seq, 16)
    lengths = GC.genome_table(chunks)
    full = GC.gc_genome_distribution(chunks, lengths, 4, size=16).agg(F.sum("n")).first()[0]
    assert full == 80 - 2 * 9
    gap = spark.createDataFrame([("c", 20, 35), ("c", 30, 40)], "chrom string, start int, end int")
    assert GC.gc_genome_distribution(chunks, lengths, 4, gap, 16).agg(F.sum("n")).first()[0] == full - 21


def test_loops(spark):
    a = "struct<chrom:string,start:int,end:int>"
    loops = spark.createDataFrame([(1, ("c", 0, 10), ("c", 100, 110), 2.0), (2, ("c", 0, 10), ("c", 500, 510), float("inf")),
                                   (3, ("c", 500, 510), ("d", 0, 10), 4.0)], f"loop_id int, first {a}, second {a}, val double")
    assert rows(L.loops_in_window(loops, "c", 5, 200), "loop_id", "side") == [(1, "both"), (2, "head")]
    got = {r["loop_id"]: r["intensity"] for r in L.loop_intensity(loops).collect()}
    assert got[1] == 1.5 and got[3] == 3
    b = "chrom string, start int, end int"
    bed1, bed2 = spark.createDataFrame([("c", 5, 6)], b), spark.createDataFrame([("c", 110, 120)], b)
    res = {r["kind"]: r["n"] for r in L.compare_loops_with_beds(loops, bed1, bed2).collect()}
    assert res == {"bed1-bed2": 1, "bed1-bed1": 0, "bed2-bed2": 0, "bed1-none": 1, "bed2-none": 0, "none": 1}
    assert rows(L.loops_between_beds(loops, bed1, bed2), "loop_id") == [(1,)]
    assert rows(L.beds_hit_by_loops(bed2, loops), "start") == [(110,)]


def test_barcode_view(spark):
    data = [("one", 5), ("in", 100), ("in", 150), ("in2", 100), ("in2", 150), ("span", 1), ("span", 999), ("left", 10), ("left", 120)]
    df = spark.createDataFrame([(b, "c", p) for b, p in data], "barcode string, chrom string, pos int")
    pos = BC.barcode_positions(BC.multi_hit_barcodes(df))
    view = BC.barcodes_in_window(pos, "c", 50, 500, 10_000)
    assert rows(view.select("barcode").distinct(), "barcode") == [("in",), ("in2",), ("left",)]
    groups = BC.collapse_identical(view, 50).collect()
    assert [(r["first"], r["last"], r["n_same"]) for r in groups] == [(10, 120, 1), (100, 150, 2)]
    assert rows(BC.largest_group(BC.collapse_identical(view, 50)), "max_count", "n_lines") == [(2, 2)]


def test_representative_transcript(spark):
    tx = spark.createDataFrame([("c", "a", "g", "", "", "+", 0, 900, "x", ""), ("c", "b", "g", "", "", "+", 0, 100, "x", "CCDS"),
                                ("c", "d", "g", "", "", "+", 0, 200, "x", "CCDS"), ("c", "e", "h", "", "", "+", 0, 50, "x", "basic"),
                                ("c", "f", "h", "", "", "+", 0, 500, "x", "other")], GENE)
    assert rows(G.representative_transcript(tx), "gid", "tid") == [("g", "d"), ("h", "e")]


def test_tracks(spark):
    v = spark.createDataFrame([("S", "c", 0, 1.0), ("S", "c", 1, -3.0), ("S", "c", 2, 3.0), ("S", "c", 4, 2.0), ("S", "c", 6, 9.0)],
                              "label string, chrom string, bin int, value double")
    assert rows(T.downsample_track(v, 0, 7, 3), "grp", "value") == [(0, -3.0), (1, 2.0)]
    assert T.thin_factor(500_000, 100) == 5 and T.thin_factor(50_000, 100) == 1 and T.thin_factor(10**7, 100) == 20
    assert T.line_count(0, 1_000_000, 500_000) == (2, 2) and T.line_count(0, 1_000_001, 500_000, 2) == (3, 2)
    g = spark.createDataFrame([("c", 10.0)], "chrom string, value double")
    assert rows(T.graph_range(g), "ymax", "scaled") == [(20.0, 0.5)]
    assert rows(T.graph_range(g, 20, 70), "scaled") == [(-0.2,)]


def test_gv_layout(genome):
    assert rows(T.gv_layout(genome), "chrom", "end", "width") == [("chr1", 1000, 1001), ("chr2", 555, 1001)]


def test_track_view_layers_and_overlay(spark, genome):
    pairs = spark.createDataFrame([("A", "a", "in", "A", 0), ("B", "b", "in", "A", 1)],
                                  "label string, chip string, input string, panel string, layer_no int")
    b = spark.createDataFrame([("a", "chr1", 1, 400000), ("b", "chr1", 1, 60000), ("in", "chr1", 1, 20000)], BINS)
    v = T.track_view(b, pairs, genome, 100, "chr1", 0, 1000, ["chip", "input", "ratio"], width=1000, input_of_first="A")
    got = rows(v, "label", "panel", "layer_no", "layer", "value", "drawn", "marked")
    assert got == [("A", "A", 0, "chip", 40.0, 40.0, False), ("A", "A", 0, "input", 2.0, 2.0, False), ("A", "A", 0, "ratio", 20.0, 10.0, True),
                   ("B", "A", 1, "chip", 6.0, 6.0, False), ("B", "A", 1, "ratio", 3.0, 3.0, True)]


def test_autosomes_and_chromosomes(spark, genome):
    assert rows(S.autosomes(genome), "chrom") == [("chr1",), ("chr2",)]
    odd = spark.createDataFrame([("X",), ("Mt",)], "chrom string")
    with pytest.raises(ValueError):
        S.autosomes(odd)
    assert S.autosomes(odd, True).count() == 2 and rows(S.drop_sex_mito(odd), "chrom") == [("X",)]
    with pytest.raises(ValueError):
        S.only_chrom(odd, genome, "chr9")


def test_after_gc_columns(spark, genome):
    df = spark.createDataFrame([("s", 1, "chr1", "+", 10, 0.5), ("s", 2, "chr1", "-", 300, 2.0)], READ)
    s = R.qc_stats(df, genome, norm="CR", weighted=df)
    r = {x["chrom"]: x for x in s.collect()}
    assert r["chr1"]["after_gc"] == 2.5 and r["Genome"]["after_gc_fwd"] == 0.5 and r["chr1"]["pct_after_gc"] == 125
    assert r["Genome"]["normalised"] == r["chr1"]["normalised"]
