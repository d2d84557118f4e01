"""Workflows over files, end to end."""
import random
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from peakgrid.operators import bins as B
from peakgrid.operators import gc as GC
from peakgrid.operators import reads as R
from peakgrid.plans import commands as C
from peakgrid.sources import alignments, intervals, samples, sequence, signals, sinks, tables


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A 60 kb genome with three enriched places in the ChIP sample, as TagAlign files and a FASTA file."""
    d = tmp_path_factory.mktemp("run")
    rnd = random.Random(6)
    (d / "genome.txt").write_text("chr1\t60000\nchr2\t20000\nchrY\t5000\n")

    def write(name, places, n):
        out = []
        for _ in range(n):
            c, top = rnd.choice([("chr1", 60000), ("chr1", 60000), ("chr2", 20000), ("chrY", 5000)])
            p = rnd.choice(places) + rnd.randrange(-100, 100) if places and c == "chr1" and rnd.random() < 0.7 else rnd.randrange(200, top - 200)
            strand = rnd.choice("+-")
            s = p - 75 if strand == "+" else p + 39
            out.append(f"{c}\t{s}\t{s + 36}\tN\t1\t{strand}")
        (d / name).write_text("\n".join(out) + "\n")

    write("chip.tagAlign", [10000, 30000, 45050], 4000)
    write("input.tagAlign", [], 4000)
    for c, n in (("chr1", 60000), ("chr2", 20000), ("chrY", 5000)):
        (d / f"{c}.fa").write_text(f">{c}\n" + "\n".join("".join(rnd.choice("ACGT") for _ in range(100)) for _ in range(n // 100)) + "\n")
    (d / "peaks.bed").write_text("chr1\t9900\t10100\nchr1\t29900\t30100\n")
    return d


def load(spark, d):
    genome = tables.read_genome_table(spark, str(d / "genome.txt"))
    reads = [alignments.read_alignments(spark, str(d / f"{s}.tagAlign"), s) for s in ("chip", "input")]
    return genome, alignments.union_alignments(reads)


def test_reads_to_peaks(spark, files, tmp_path):
    genome, reads = load(spark, files)
    bed = intervals.read_bed(spark, str(files / "peaks.bed")).withColumn("chrom", F.concat(F.lit("chr"), "chrom"))
    got = C.count_reads(reads, genome, 100, 150, bed=bed, threshold=2, ncmp=1000)
    stats = {(r["sample"], r["chrom"]): r for r in got.stats.collect()}
    assert stats["chip", "Genome"]["n"] == 4000 and stats["chip", "chr1"]["frip"] > 0.4 > stats["input", "chr1"]["frip"]
    assert {r["sample"]: r["enough"] for r in got.complexity.collect()} == {"chip": True, "input": True}
    files = {}
    for s in ("chip", "input"):
        part = got.bins.filter(F.col("sample") == s)
        out = tmp_path / f"out-{s}"
        (sinks.write_bedgraph if s == "chip" else sinks.write_wig)(part, genome, str(out), 100)
        text = "".join(p.read_text() for p in sorted((out / f"sample={s}").glob("part-*")))
        files[s] = str(tmp_path / f"{s}.100.{'bedGraph' if s == 'chip' else 'wig'}")
        Path(files[s]).write_text(text)
    sheet = samples.sample_sheet(spark, [f"{files['chip']},{files['input']},S", f"{files['chip']},,alone"])
    bins, pairs = C.load_signals(spark, sheet), samples.pairs_of(sheet)
    assert rows(bins.withColumn("sample", F.element_at(F.split("sample", "/"), -1)), "sample", "chrom", "bin", "v") == sorted(
        (f"{r['sample']}.100.{'bedGraph' if r['sample'] == 'chip' else 'wig'}", r["chrom"], r["bin"], r["v"] // 10000 * 10000)
        for r in got.bins.collect() if r["v"] >= 5000)
    peaks = C.peak_command(bins, pairs, genome, 100)
    with_input = [r for r in peaks.orderBy("peak_no").collect() if r["sample"] == "S"]
    assert [r["peak_no"] for r in with_input] == list(range(len(with_input))) and {r["chrom"] for r in with_input} == {"chr1"}
    for centre in (10000, 30000, 45050):
        assert any(abs(r["summit"] - centre) <= 150 for r in with_input)
    assert {r["sample"] for r in peaks.select("sample").distinct().collect()} == {"S", "alone"}
    near = C.peak_command(bins, pairs, genome, 100, regions=bed, norm=1)
    assert 0 < near.filter("sample = 'S'").count() < len(with_input)
    _, agg = C.profile_command(bins, pairs, genome, 100, "SITES", bed.withColumn("name", F.col("start").cast("string")), width=1000)
    means = {r["offset"]: r["mean"] for r in agg.filter("label = 'S'").collect()}
    assert means[0] > 5 * means[-9]
    m = C.matrix_command(bins, pairs, genome, 100, bed.withColumn("name", F.lit("x")), "max")
    assert m.count() == 2 and m.filter("S > 10").count() == 2
    v = C.signal_command(bins, pairs, genome, 100, 1)
    assert v.count() == 601 + 201 + 51 and v.select("sample").distinct().count() == 1
    view = C.view_command(bins, pairs, genome, 100, "GV", "chr1", layers=("ratio",))
    assert view.filter("marked").count() > 0 and view.select("line").distinct().count() == 1


def test_totals_of_statistics_files(spark, files, tmp_path):
    """A signal with a statistics file takes its numbers, another one is summed while it is stored."""
    genome, reads = load(spark, files)
    got = C.count_reads(reads, genome, 100, 150, threshold=2, norm="GR", nrpm=3000)
    sinks.write_stats(got.stats, genome, str(tmp_path / "stats"))
    own = {(r["sample"], r["chrom"]): r["normalised"] for r in got.stats.collect()}
    summed = {(r["sample"], r["chrom"]): r["total"] for r in B.signal_total(got.bins).collect()}
    paths = {s: str(tmp_path / "stats" / f"sample={s}") for s in ("chip", "input")}
    same, totals = C.signal_totals(got.bins, genome, ["chip", "input"], paths)
    assert same is got.bins
    assert {(r["sample"], r["chrom"]): r["total"] for r in totals.collect()} == own
    stored, mixed = C.signal_totals(got.bins, genome, ["chip", "input"], {"chip": paths["chip"]})
    want = {k: (own if k[0] == "chip" else summed)[k] for k in own}
    assert {(r["sample"], r["chrom"]): r["total"] for r in mixed.collect()} == want
    assert stored.count() == got.bins.count()
    pairs = spark.createDataFrame([("S", "chip", "input")], "label string, chip string, input string")
    for norm in (1, 2):
        cols = ("chrom", "start", "end", "enrichment")
        assert (rows(C.peak_command(got.bins, pairs, genome, 100, norm=norm, totals=C.signal_totals(got.bins, genome, ["chip", "input"])[1]), *cols)
                == rows(C.peak_command(got.bins, pairs, genome, 100, norm=norm), *cols))
    short = tmp_path / "short.tsv"
    short.write_text("".join(f"{line}\n" for line in ("\ttotal reads\tread depth", "Genome\t80\t1.0", "1\t80\t1.0")))
    _, gap = C.signal_totals(got.bins, genome, ["chip"], {"chip": str(short)})
    assert {r["chrom"]: r["total"] for r in gap.collect()} == {"Genome": 80, "chr1": 80, "chr2": 0, "chrY": 0}


def test_estimated_length_and_gc(spark, files):
    genome, reads = load(spark, files)
    est = {r["sample"]: r["fragment_length"] for r in R.estimate_fragment_length(reads, genome, 36, 5, 0, 300).collect()}
    assert 50 < est["chip"] < 250
    got = C.count_reads(reads, genome, 100, None, 36)
    assert got.stats.filter("chrom = 'Genome'").count() == 2
    chunks = sequence.read_fasta(spark, str(files / "*.fa"), 4096)
    assert rows(GC.genome_table(chunks), "chrom", "length") == [("chr1", 60000), ("chr2", 20000), ("chrY", 5000)]
    kept = R.nonredundant(reads.filter("sample = 'input'"), 1)
    out, weights = C.gc_normalise(kept, chunks, genome, 150, size=4096)
    assert weights.count() == 121 and out.count() == kept.count()
    share = out.filter("chrom = 'chr1'").agg(F.avg("weight")).first()[0]
    assert 0.8 < share < 1.2
    full = C.count_reads(reads.filter("sample = 'input'"), genome, 100, 150, multimap=True, chunks=sequence.read_fasta(spark, str(files / "*.fa")))
    assert "after_gc" in full.stats.columns and full.gc_weights is not None
    assert full.bins.count() > 0


def test_gc_weights_are_of_one_sample(spark, files):
    """Two samples in one table get what each gets alone; estimated lengths give each its own window."""
    genome, reads = load(spark, files)
    chunks = sequence.read_fasta(spark, str(files / "*.fa"), 4096)
    kept = R.nonredundant(reads, 1)
    lengths = spark.createDataFrame([("chip", 150), ("input", 60)], "sample string, fragment_length int")
    for flen, windows in ((150, {"chip": 121, "input": 121}), (lengths, {"chip": 121, "input": 51})):
        out, weights = C.gc_normalise(kept, chunks, genome, flen, size=4096)
        assert {r["sample"]: r["count"] for r in weights.groupBy("sample").count().collect()} == windows
        assert out.count() == kept.count()
        for s, alone_flen in (("chip", 150), ("input", 150 if flen == 150 else 60)):
            alone, own = C.gc_normalise(kept.filter(F.col("sample") == s), chunks, genome, alone_flen, size=4096)
            same = F.col("sample") == s
            assert rows(weights.filter(same), "gc", "weight") == rows(own, "gc", "weight")
            assert rows(out.filter(same), "read_id", "weight") == rows(alone, "read_id", "weight")


def test_paired_and_unfiltered_statistics(spark):
    """Coverage takes the real fragments of pairs; without the filter no read is redundant."""
    from peakgrid.schemas import GENOME, READS
    genome = spark.createDataFrame([("c", 1000, 1000, 0)], GENOME)
    ends = [(100, 399), (100, 399), (100, 299), (500, 599)]
    reads = spark.createDataFrame([("s", i, "c", "+", a, b, 36, 36, 1, "c", b - a + 1, 1.0) for i, (a, b) in enumerate(ends)], READS)

    def row(**how):
        out = C.count_reads(reads, genome, 100, flen=150, threshold=1, **how).stats
        return out.filter("chrom = 'c'").select("n", "n_nonred", "n_red", "coverage").first()
    pairs, plain, whole = row(paired=True), row(), row(keep_duplicates=True)
    assert (pairs.n, pairs.n_nonred) == (4, 3) and pairs.coverage == 0.4
    assert (plain.n, plain.n_nonred) == (4, 2) and plain.coverage == 0.302  # extended ends are closed: 151 bases
    assert (whole.n, whole.n_nonred, whole.n_red) == (4, 4, 0)


def test_one_sample_of_a_folder(spark, tmp_path):
    kind = "sample string, chrom string, bin int, v long"
    root = str(tmp_path / "bins")
    sinks.write_bins(spark.createDataFrame([("chip", "chr1", 0, 10000), ("input", "chr1", 0, 30000)], kind), root)
    sheet = "chip string, input string, binsize int"
    got = C.load_signals(spark, spark.createDataFrame([(f"{root}#chip", f"{root}#input", 100)], sheet))
    assert rows(got, "sample", "bin", "v") == [(f"{root}#chip", 0, 10000), (f"{root}#input", 0, 30000)]
    with pytest.raises(ValueError, match="several samples"):
        C.load_signals(spark, spark.createDataFrame([(root, None, 100)], sheet))


def test_sample_without_an_estimated_length_stays(spark, files):
    """A sample on chrX only has no strand shift on numbered chromosomes; it is counted with the fixed length."""
    from peakgrid.schemas import GENOME, READS
    genome = spark.createDataFrame([("chr1", 5000, 5000, 0), ("chrX", 5000, 5000, 1)], GENOME)
    sites = [("a", "chr1", st, p + (80 if st == "-" else 0)) for p in range(300, 4500, 97) for st in "+-"] + [("b", "chrX", "+-"[p % 2], p) for p in range(300, 4500, 131)]
    reads = spark.createDataFrame([(s, i, c, st, p, None, 36, 36, 1, None, None, 1.0) for i, (s, c, st, p) in enumerate(sites)], READS)
    got, fixed = C.count_reads(reads, genome, 100, None, threshold=1), C.count_reads(reads.filter("sample = 'b'"), genome, 100, R.FIXED_FRAGMENT, threshold=1)
    assert rows(got.bins.filter("sample = 'b'"), "chrom", "bin", "v") == rows(fixed.bins, "chrom", "bin", "v") != []
    assert got.stats.filter("chrom = 'Genome'").count() == 2
    lengths = spark.createDataFrame([("a", 80)], "sample string, fragment_length int")
    assert R.extend(reads, lengths).filter("sample = 'b' AND abs(f5 - f3) = 150").count() == sum(s[0] == "b" for s in sites)
    limits = spark.createDataFrame([("a", 2.0)], "sample string, threshold double")
    assert R.nonredundant(reads.union(reads), limits).groupBy("sample").count().filter("sample = 'b'").first()["count"] == sum(s[0] == "b" for s in sites)


def test_view_reads_its_neighbourhood_only(spark, tmp_path):
    """Bins far from the region change nothing, and the bin range is pushed to the files."""
    from peakgrid.operators import tracks as T
    genome = spark.createDataFrame([("c", 10_000_000, None, 0), ("d", 5000, None, 1)], "chrom string, length int, mappable long, ord int")
    near = [(s, "c", b, 10000 * (1 + b * (7 if s == "chip" else 5) % 13)) for s in ("chip", "input") for b in range(48_000, 53_000, 3)]
    far = [(s, "c", b, 5_000_000) for s in ("chip", "input") for b in (*range(0, 9000, 10), *range(90_000, 99_000, 10))] + [("chip", "d", 3, 90000)]
    kind = "sample string, chrom string, bin int, v long"
    sinks.write_bins(spark.createDataFrame(near + far, kind), str(tmp_path / "bins"))
    pairs = spark.createDataFrame([("S1", "chip", "input")], "label string, chip string, input string")
    stored = spark.read.schema(kind).parquet(str(tmp_path / "bins"))
    for smooth in (0, 3):
        view = T.track_view(stored, pairs, genome, 100, "c", 5_000_000, 5_100_000, width=20_000, smooth=smooth)
        alone = T.track_view(spark.createDataFrame(near, kind), pairs, genome, 100, "c", 5_000_000, 5_100_000, width=20_000, smooth=smooth)
        assert rows(view, "layer", "line", "grp", "value", "drawn") == rows(alone, "layer", "line", "grp", "value", "drawn") != []
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(bin," in plan and "LessThanOrEqual(bin," in plan
