"""Readers on small files and write-read round trips."""
import glob
import gzip
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from peakgrid.operators import bins as B
from peakgrid.operators import gc as GC
from peakgrid.operators import peaks as P
from peakgrid.operators import profiles as PR
from peakgrid.operators import reads as R
from peakgrid.sources import alignments, genes, intervals, lines, samples, sequence, signals, sinks, tables

BINS = "sample string, chrom string, bin int, v long"


def put(path, text, gz=False):
    data = text.encode()
    path.write_bytes(gzip.compress(data) if gz else data)
    return str(path)


def test_genome_tables(spark, tmp_path):
    g = tables.read_genome_table(spark, put(tmp_path / "g.txt", "# head\nchr2\t500\n\nchr1\t1000\n"))
    assert rows(g, "ord", "chrom", "length") == [(0, "chr2", 500), (1, "chr1", 1000)]
    m = tables.read_mappable_table(spark, put(tmp_path / "m.txt", "chr1\t800\n"))
    assert rows(tables.with_mappable(g, m), "chrom", "mappable") == [("chr1", 800), ("chr2", 500)]


SAM = """@SQ\tSN:chr1\tLN:1000
r1\t0\tchr1\t101\t30\t36M\t*\t0\t0\tACGTACGTACGTACGTACGTACGTACGTACGTACGT\t*\tNH:i:2
r2\t16\tchr1\t201\t30\t10M2D24M\t*\t0\t0\tACGTACGTACGTACGTACGTACGTACGTACGTAC\t*
r3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*
r4\t256\tchr1\t5\t0\t2M\t*\t0\t0\tAC\t*
p1\t99\tchr1\t301\t30\t4M\t=\t397\t100\tACGT\t*
p1\t147\tchr1\t397\t30\t4M\t=\t301\t-100\tACGT\t*
"""


def test_alignments(spark, tmp_path):
    p = put(tmp_path / "a.sam", SAM)
    df = alignments.read_alignments(spark, p, "s")
    assert rows(df, "strand", "f3", "len_f3", "nh") == sorted(
        [("+", 100, 36, 2), ("-", 235, 34, None), ("+", 300, 4, None), ("-", 399, 4, None)], key=lambda r: r[:2])
    pair = alignments.read_alignments(spark, p, "s", paired=True)
    assert rows(pair, "f3", "f5", "tlen", "mate_chrom") == [(300, 399, 100, "chr1")]
    assert rows(R.pair_filter(pair), "flen") == [(100,)]
    tag = put(tmp_path / "a.tagAlign.gz", "chr1\t10\t46\tN\t1\t+\nchr1\t50\t86\tN\t1\t-\n", gz=True)
    bow = put(tmp_path / "b.txt", "r\t-\tchr2\t7\tACGT\tIIII\t0\t\n")
    assert rows(alignments.read_alignments(spark, tag, "s"), "strand", "f3") == [("+", 10), ("-", 85)]
    assert rows(alignments.read_alignments(spark, bow, "s", fmt="BOWTIE"), "chrom", "f3") == [("chr2", 10)]
    pooled = alignments.read_alignments(spark, f"{p},{tag}", "s")
    assert pooled.count() == 6 and pooled.select("read_id").distinct().count() == 6
    both = alignments.union_alignments([df, df])
    assert both.select("read_id").distinct().count() == 8
    with pytest.raises(ValueError):
        alignments.format_of("x.bam")


def signal(spark, lengths):
    rnd = random.Random(4)
    data = [("s", c, i, 10000 * rnd.randrange(1, 50)) for c, n in lengths for i in range(n // 100 + 1) if rnd.random() < 0.4]
    return spark.createDataFrame(data, BINS)


@pytest.mark.parametrize("gz", [False, True])
def test_wig_and_bedgraph_round_trip(spark, genome, tmp_path, gz):
    b = signal(spark, [("chr1", 1000), ("chr2", 555)])
    want = rows(b, "sample", "chrom", "bin", "v")
    sinks.write_wig(b, genome, str(tmp_path / "w"), 100, gzip=gz, tile=4)
    assert rows(signals.read_wig(spark, str(tmp_path / "w" / "sample=s"), "s", 100), "sample", "chrom", "bin", "v") == want
    sinks.write_bedgraph(b, genome, str(tmp_path / "g"), 100, gzip=gz)
    assert rows(signals.read_bedgraph(spark, str(tmp_path / "g" / "sample=s"), "s", 100), "sample", "chrom", "bin", "v") == want


def test_parts_of_a_written_signal_are_in_order(spark, genome, tmp_path):
    b = signal(spark, [("chr1", 1000), ("chr2", 555)])
    sinks.write_bedgraph(b, genome, str(tmp_path / "g"), 100)
    text = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "g" / "sample=s" / "part-*"))))
    got = [(r.split("\t")[0], int(r.split("\t")[1])) for r in text.splitlines()]
    assert got == sorted(got)
    dense = B.densify(b, genome, 100, ["s"])
    sinks.write_bedgraph(dense, genome, str(tmp_path / "z"), 100, zeros=True)
    text = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "z" / "sample=s" / "part-*"))))
    assert "chr2\t500\t554\t" in text and "chr1\t1000\t999\t0" in text and len(text.splitlines()) == 17


def test_wig_blocks_in_any_order(spark, tmp_path):
    text = ("track type=wiggle_0\nvariableStep\tchrom=chr10\tspan=100\n1\t5\n101\t7\nvariableStep\tchrom=chr1\tspan=100\n"
            "1\t2\n201\t3\n201\t4\n")
    got = signals.read_wig(spark, put(tmp_path / "a.wig", text), "s", 100)
    assert rows(got, "chrom", "bin", "v") == [("chr1", 0, 20000), ("chr1", 2, 40000), ("chr10", 0, 50000), ("chr10", 1, 70000)]


def test_blocks_run_over_file_splits(spark, tmp_path):
    text = "variableStep chrom=a\n" + "".join(f"{i * 10 + 1}\t{i % 7 + 1}\n" for i in range(3000))
    text += "variableStep chrom=b\n" + "".join(f"{i * 10 + 1}\t2\n" for i in range(3000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        p = put(tmp_path / "a.wig", text)
        assert lines.ordered_lines(spark, p).select("block").distinct().count() > 5
        got = signals.read_wig(spark, p, "s", 10)
        per = {r["chrom"]: (r["n"], r["v"]) for r in got.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()}
        seq = "".join(random.Random(1).choice("ACGTN") for _ in range(30000))
        fa = put(tmp_path / "chr1.fa", ">x\n" + "\n".join(seq[i:i + 61] for i in range(0, 30000, 61)) + "\n>second\nAAAA\n")
        chunks = sequence.read_fasta(spark, fa, 1000).orderBy("chunk").collect()
        every = sequence.read_fasta(spark, fa, 1000, all_records=True)
        assert rows(GC.genome_table(every), "chrom", "length") == [("second", 4), ("x", 30000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert per == {"a": (3000, sum((i % 7 + 1) * 10000 for i in range(3000))), "b": (3000, 60000000)}
    assert "".join(c["seq"] for c in chunks) == seq and {c["chrom"] for c in chunks} == {"chr1"}


def test_bedgraph_reader(spark, tmp_path):
    p = put(tmp_path / "a.bedGraph", "browser hide all\ntrack type=bedGraph\nchr1 0 150 2\nchr1\t150\t200\t4\nchr1\t300\t400\t\n")
    assert rows(signals.read_bedgraph(spark, p, "s", 100), "bin", "v") == [(0, 20000), (1, 30000)]
    with pytest.raises(Exception, match="four fields"):
        signals.read_bedgraph(spark, put(tmp_path / "b.bedGraph", "chr1\t0\t10\n"), "s", 100).collect()


def test_bins_parquet(spark, tmp_path):
    b = signal(spark, [("chr1", 1000), ("chr2", 555)])
    sinks.write_bins(b, str(tmp_path / "p"), tile=4)
    back = signals.read_bins(spark, str(tmp_path / "p"))
    assert rows(back, *back.columns) == rows(b, *b.columns)
    plan = back.filter("chrom = 'chr1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan


def test_beds(spark, tmp_path):
    p = put(tmp_path / "a.bed", "#x\nchromosome\tstart\tend\nchr7\t100\t200\tpeak1\t5\t+\t100\t150\t255,0,10\t1\t100\t0\n7\tstart\tend\nchr8\t1\t4\n")
    assert rows(intervals.read_bed(spark, p), "chrom", "start", "end", "summit", "name") == [("7", 100, 200, 150, "peak1"), ("8", 1, 4, 2, None)]
    got = {r["chrom"]: r for r in intervals.read_bed12(spark, p).collect()}
    assert got["7"]["rgb"].asDict() == {"r": 255, "g": 0, "b": 10} and got["7"]["score"] == 5
    assert got["8"]["rgb"].asDict() == {"r": -1, "g": -1, "b": -1} and got["8"]["strand"] is None
    x = put(tmp_path / "m.xls", "# macs\n\nchr\tstart\tend\tlength\tabs_summit\tpileup\t-log10(pvalue)\tfold\t-log10(qvalue)\tname\nchr1\t10\t60\t50\t33\t4.5\t7.1\t2\t3.5\tn1\n")
    assert rows(intervals.read_macs_xls(spark, x), "chrom", "summit", "q", "name") == [("1", 33, 3.5, "n1")]
    with pytest.raises(Exception, match="three fields"):
        intervals.read_bed(spark, put(tmp_path / "b.bed", "chr1 5 9\n")).collect()


def test_interactions(spark, tmp_path):
    base = "chr1\t1\t5\tchr1\t11\t15"
    m = put(tmp_path / "m", f"chrom1\tx\n{base}\tn\t0.01\n{base}\tn\t0\n" + base + "\t" + "\t".join(["q"] * 9) + "\t0.001\nchr1\t2\n")
    got = intervals.read_interactions(spark, m, "mango", "L")
    assert sorted(round(r["val"], 6) for r in got.collect()) == [2, 3, 12]
    assert intervals.count_short_interactions(spark, m) == 1
    h = put(tmp_path / "h", base + "\tcolor\n" + base + "\t" + "\t".join(["1"] * 11) + "\t0.1\t9\n")
    assert rows(intervals.read_interactions(spark, h, "hiccups"), "val") == [(1.0,)]
    b = intervals.read_interactions(spark, put(tmp_path / "b", base + "\n"), "bedpe").first()
    assert b["val"] == 1 and b["first"]["chrom"] == "1" and b["second"]["start"] == 11
    c = intervals.read_chiadrop(spark, put(tmp_path / "c", "#h\nbc1,chr1,500\n"))
    assert rows(c, "barcode", "chrom", "pos") == [("bc1", "1", 500)]


def test_refflat(spark, tmp_path):
    row = "{g}\t{t}\tchr1\t+\t100\t900\t200\t800\t2\t100,500,\t300,900,"
    p = put(tmp_path / "r", "#h\n" + row.format(g="A", t="NM_1") + "\n" + row.format(g="B", t="X_1") + "\n" + row.format(g="C", t="NM_1") + "\tlincRNA\n")
    got = {r["tname"]: r for r in genes.read_refflat(spark, p).collect()}
    assert got["NM_1"]["gname"] == "C" and got["NM_1"]["gtype"] == "lincRNA" and got["X_1"]["gtype"] == "noncoding RNA"
    assert [tuple(x) for x in got["X_1"]["exon"]] == [(100, 300), (500, 900)]


def test_gtf_and_gff(spark, tmp_path):
    a = 'gene_id "G"; transcript_id "T"; gene_name "N"; gene_biotype "protein_coding"; tag "basic"; tag "CCDS";'
    gtf = "".join(f"chr1\ts\t{f}\t{s}\t{e}\t.\t-\t.\t{a}\n" for f, s, e in
                  [("gene", 1, 999), ("exon", 500, 600), ("exon", 100, 200), ("start_codon", 590, 592), ("stop_codon", 110, 112)])
    r = genes.read_gtf(spark, put(tmp_path / "a.gtf", "#!h\n" + gtf + "chr1\ts\texon\t1\t2\t.\t+\t.\tgene_id \"Q\";\n")).collect()
    assert len(r) == 1
    assert r[0][("tx_start")] == 100 and r[0]["tx_end"] == 600 and r[0]["cds_start"] == 110 and r[0]["cds_end"] == 592
    assert [tuple(x) for x in r[0]["exon"]] == [(100, 200), (500, 600)] and r[0]["tag"] == "CCDS"
    assert (r[0]["gname"], r[0]["tname"], r[0]["gid"], r[0]["exon_count"]) == ("N", "T", "G", 2)
    gff = "chr2\ts\texon\t5\t9\t.\t+\t.\tID=x;transcript_id=T2;gene_id=G2;tag=basic,CCDS\n"
    r = genes.read_gtf(spark, put(tmp_path / "a.gff3", gff)).first()
    assert (r["tid"], r["cds_start"], r["cds_end"], r["tag"], r["gname"]) == ("T2", 5, 9, "CCDS", "G2")


def test_yeast_features(spark, tmp_path):
    def row(i, kind, name, gene, s, e, strand):
        return "\t".join([i, kind, "", name, gene, "", "rep", "", "4", str(s), str(e), strand])
    p = put(tmp_path / "s.tab", "\n".join([row("S1", "ORF", "YA", "ABC", 10, 90, "W"), row("S2", "ORF", "YB", "", 90, 10, "C"),
                                           row("S3", "centromere", "C", "", 5, 6, "W"), row("S4", "intron", "x", "", 1, 2, "W")]) + "\n")
    assert rows(genes.read_sgd(spark, p), "tid", "chrom", "gname", "strand", "tx_start", "tx_end") == [
        ("S1", "IV", "ABC", "+", 10, 90), ("S2", "IV", "YB", "-", 10, 90), ("S3", "IV", "CEN_chrIV", "", 5, 6)]
    a = put(tmp_path / "ars", "Status\tx\nConfirmed ARS\tI-1\tARS102\tp\t1\t650\t1791\nLikely\tI-2\t7\tp\tchr16\t1\t2\n")
    assert rows(genes.read_ars(spark, a), "chrom", "gname", "tx_start") == [("I", "ARS102", 650), ("XVI", "ARS_7", 1)]
    t = put(tmp_path / "ter", "Name\tc\ts\te\nTER1\t2\t5\t9\n")
    assert rows(genes.read_ter(spark, t), "chrom", "gname", "gtype") == [("II", "TER1", "TER")]


def test_small_tables(spark, tmp_path):
    c = tables.read_cytoband(spark, put(tmp_path / "c.tsv", "chr1\t0\t8840440\tqA1\tgpos100\n"))
    assert rows(c, "chrom", "end", "stain") == [("1", 8840440, "gpos100")]
    n = put(tmp_path / "n", "A\tx\n\nB\n")
    assert rows(tables.read_gene_list(spark, n), "name") == [("A\tx",), ("B",)]
    assert rows(tables.read_gene_list(spark, n, True), "name") == [("A",), ("B",)]
    (tmp_path / "w").mkdir()
    put(tmp_path / "w" / "chr1-bs500", "0\t42.40\n500 \t50.14\n")
    put(tmp_path / "w" / "chr10-bs500", "500\t1\n")
    assert rows(tables.read_window_track(spark, str(tmp_path / "w"), 500), "chrom", "start", "value") == [
        ("chr1", 0, 42.4), ("chr1", 500, 50.14), ("chr10", 500, 1.0)]
    with pytest.raises(Exception, match="multiple"):
        tables.read_window_track(spark, str(tmp_path / "w"), 300).collect()
    (tmp_path / "m").mkdir()
    put(tmp_path / "m" / "map_chr1.100.wig.gz", "0\t0.5000\n100\t1.0000\n", gz=True)
    assert rows(tables.read_bin_mappability(spark, str(tmp_path / "m"), 100), "chrom", "bin", "fraction") == [("chr1", 0, 0.5), ("chr1", 1, 1.0)]
    b = put(tmp_path / "map_chr1_binary.txt.gz", "0011 1\n100111", gz=True)
    assert rows(sequence.read_bp_mappability(spark, b, 3), "chrom", "start", "end") == [("chr1", 2, 5), ("chr1", 8, 10)]


def test_sample_sheet(spark):
    s = samples.sample_sheet(spark, ["d/a.100.bw,d/i.100.bw,A,,,30,,5", "d/b.100.wig.gz,d/i.100.bw"], ["d/c.100.bw,,C"])
    got = {r["label"]: r for r in s.collect()}
    assert got["A"]["binsize"] == 100 and got["A"]["scale_tag"] == 30 and got["A"]["scale_ratio"] is None
    assert got["b.100.wig.gz"]["input"] == "d/i.100.bw" and got["C"]["overlay_of"] == "A"
    assert samples.signal_paths(s) == ["d/a.100.bw", "d/b.100.wig.gz", "d/c.100.bw", "d/i.100.bw"]
    assert rows(samples.pairs_of(s), "label", "panel", "layer_no")[0] == ("A", "A", 0)
    for bad in (["a.100.bw,i.50.bw"], [",x"], ["a.bw"], ["a,b,c,d,1,2,3,4,5"]):
        with pytest.raises(ValueError):
            samples.sample_sheet(spark, bad)


def test_stats_round_trip(spark, genome, tmp_path):
    df = spark.createDataFrame([("s", i, c, "+", i * 20, 1.0) for i, c in enumerate(["chr1"] * 3 + ["chr2"])],
                               "sample string, read_id long, chrom string, strand string, f3 int, weight double")
    bed = spark.createDataFrame([("chr1", 0, 30)], "chrom string, start int, end int")
    for norm in ("NONE", "GR"):
        st = R.qc_stats(df, genome, bed, norm=norm, nrpm=100, weighted=df)
        sinks.write_stats(st, genome, str(tmp_path / norm), after_gc=True)
        back = tables.read_stats(spark, str(tmp_path / norm / "sample=s"))
        want = rows(st.selectExpr("regexp_replace(chrom, '^chr', '') AS chrom", "normalised"), "chrom", "normalised")
        assert rows(back, "chrom", "total") == want
    b = spark.createDataFrame([("s", "chr1", 1, 25000), ("s", "chr1", 2, 26000)], BINS)
    sinks.write_light_stats(B.light_stats(b, genome), genome, str(tmp_path / "l"))
    assert rows(tables.read_stats(spark, str(tmp_path / "l" / "sample=s")), "chrom", "total") == [("1", 5), ("Genome", 5)]


def test_tables_out(spark, genome, tmp_path):
    pairs = spark.createDataFrame([("S", "a", "b")], "label string, chip string, input string")
    b = spark.createDataFrame([("a", "chr1", i, 10000 * (1 + 20 * (i == 5))) for i in range(10)] + [("b", "chr1", 5, 10000)], BINS)
    peaks = P.number_peaks(P.call_peaks(b, pairs, genome, 100, P.PeakParams(1, 0, 0, 0, 0)), genome)
    sinks.write_peaks(peaks, str(tmp_path / "p"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "p" / "tsv" / "sample=S" / "part-*")))
    assert text.splitlines()[0].startswith("chromosome\tstart\tend\tlength\tsummit\tpileup (ChIP)")
    assert text.splitlines()[1].split("\t")[:8] == ["chr1", "500", "599", "99", "549", "21.00", "1.00", "21.00"]
    again = intervals.read_bed(spark, str(tmp_path / "p" / "bed" / "sample=S"))
    assert rows(again, "chrom", "start", "end") == [("1", 500, 599)]
    sinks.write_bin_distribution(B.bin_value_distribution(b, genome, 100), genome, str(tmp_path / "d"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "d" / "sample=a" / "part-*")))
    assert len(text.splitlines()) == 201 and text.splitlines()[2].startswith("1\t9\t")
    bed = spark.createDataFrame([("chr1", 400, 600, "x"), ("chr1", 400, 600, "x"), ("chr2", 0, 900, "out")], "chrom string, start int, end int, name string")
    m = PR.site_matrix(bed, b, pairs, genome, 100)
    sinks.write_site_matrix(m, str(tmp_path / "m"), True)
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "m" / "part-*")))
    assert text.splitlines() == ["chromosome\tstart\tend\tname\tS"] + ["chr1\t400\t600\tx\t11.0"] * 2
    prof = PR.profile_sites(bed.filter("name = 'x'"), b, pairs, genome, 100, 200)
    sinks.write_profile_matrix(PR.profile_wide(prof, range(-2, 3)), str(tmp_path / "w"), 100)
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "w" / "label=S" / "part-*")))
    assert text.splitlines() == ["site\t-200\t-100\t0\t100\t200"] + ["chr1-400-600\t1.0\t1.0\t21.0\t1.0\t1.0"] * 2
    w = GC.gc_weight(spark.createDataFrame([(0, 5), (1, 5)], "gc int, n long"), spark.createDataFrame([(1, 5)], "gc int, n long"), 1)
    sinks.write_gc_distribution(w, str(tmp_path / "gc"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "gc" / "part-*")))
    assert text.splitlines()[0] == "GC\tgenome prop\treads prop\tdepth\tweight" and text.splitlines()[2] == "1\t0.5\t1.0\t1.0\t0.5"
