"""Read queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import reads as R
from ..operators.bins import scale_factors
from ..session import cut
from . import commands
from .adapters import BIN, FLEN
from .registry import query, r6

SMP = "sample AS smp"
PAIR_FRAGS = """+ pfrags AS (SELECT *, greatest(least(f3, f5), 0) AS s, least(greatest(f3, f5), 999999) AS e FROM paired
 WHERE chrom = mate_chrom AND tlen <= 500)"""


@query("reads_pairs", "paired", "SELECT smp, chrom, count(*) AS n, sum(tlen)::BIGINT AS bases FROM paired "
       "WHERE chrom = mate_chrom AND tlen <= 500 GROUP BY ALL")
def reads_pairs(t):
    return (R.pair_filter(t.paired).groupBy("sample", "chrom")
            .agg(F.count("*").alias("n"), F.sum("flen").alias("bases")).selectExpr(SMP, "chrom", "n", "bases"))


@query("reads_fragments", "frags", "SELECT smp, read_id, chrom, s AS \"start\", e AS \"end\" FROM frags")
def reads_fragments(t):
    return t.unique_frags.selectExpr(SMP, "read_id", "chrom", "start", "end")


@query("reads_centred", "paired", PAIR_FRAGS + """
SELECT smp, read_id, chrom, greatest((least(f3, f5) + greatest(f3, f5) - 50) // 2, 0) AS "start",
 least((least(f3, f5) + greatest(f3, f5) - 50) // 2 + 50, 999999) AS "end" FROM pfrags""")
def reads_centred(t):
    f = R.fragments(R.pair_filter(t.paired), t.genome, rcenter=50)
    return f.selectExpr(SMP, "read_id", "chrom", "start", "end")


@query("reads_multimap", "reads", "SELECT smp, chrom, strand, round(sum(1.0::DOUBLE / nh), 6) AS weight FROM reads GROUP BY ALL")
def reads_multimap(t):
    return (R.multimap_weight(t.reads).groupBy("sample", "chrom", "strand").agg(F.sum("weight").alias("weight"))
            .selectExpr(SMP, "chrom", "strand", "round(weight, 6) AS weight"))


@query("reads_duplicates", "reads", """SELECT smp, read_id, row_number() OVER (PARTITION BY smp, chrom, strand, f3
 ORDER BY read_id) > 1 AS duplicate FROM reads""")
def reads_duplicates(t):
    return R.mark_duplicates(t.reads).selectExpr(SMP, "read_id", "duplicate")


@query("reads_duplicates_paired", "paired", """SELECT smp, chrom, count(*) AS n, count(*) FILTER (WHERE r <= 1) AS n_nonred
 FROM (SELECT *, row_number() OVER (PARTITION BY smp, chrom, strand, f3, f5 ORDER BY read_id) AS r FROM paired) GROUP BY ALL""")
def reads_duplicates_paired(t):
    return (R.site_counts(t.paired, 1, True).groupBy("sample", "chrom")
            .agg(F.sum("n").alias("n"), F.sum("n_nonred").alias("n_nonred")).selectExpr(SMP, "chrom", "n", "n_nonred"))


@query("reads_nonredundant_two", "reads", """SELECT smp, read_id FROM reads
 QUALIFY row_number() OVER (PARTITION BY smp, chrom, strand, f3 ORDER BY read_id) <= 2""")
def reads_nonredundant_two(t):
    return R.nonredundant(t.reads, 2).selectExpr(SMP, "read_id")


@query("reads_duplicate_threshold", "reads", """SELECT smp, round(greatest(1.0::DOUBLE, count(*) * 10.0::DOUBLE / 5000000), 6) AS threshold
 FROM reads GROUP BY smp""")
def reads_duplicate_threshold(t):
    return R.duplicate_threshold(t.reads, t.genome).selectExpr(SMP, "round(threshold, 6) AS threshold")


@query("reads_complexity", "reads", """+ n AS (SELECT smp, count(*) AS n FROM reads GROUP BY smp),
sub AS (SELECT reads.*, n.n AS total FROM reads JOIN n USING (smp)
 WHERE ((read_id % 1000000007) * 2654435761 % 1000003)::DOUBLE < least(1.0::DOUBLE, 10000::DOUBLE / n.n) * 1000003),
k AS (SELECT smp, total, chrom, strand, f3, count(*) AS c FROM sub GROUP BY ALL)
SELECT smp, sum(c)::BIGINT AS n_sampled, count(*) AS n_nonred, round(count(*)::DOUBLE / sum(c)::DOUBLE, 6) AS complexity,
 total >= 10000 AS enough FROM k GROUP BY smp, total""")
def reads_complexity(t):
    return R.library_complexity(t.reads, 10_000).selectExpr(
        SMP, "n_sampled", "n_nonred", "round(complexity, 6) AS complexity", "enough")


SHIFT_SQL = """+ f AS (SELECT DISTINCT smp, chrom, f3 FROM reads WHERE strand = '+'),
r AS (SELECT DISTINCT smp, chrom, f3 FROM reads WHERE strand = '-'),
m AS (SELECT smp, chrom, d AS "shift", count(*) AS n_match FROM (SELECT f.smp, f.chrom, d FROM
 (SELECT *, unnest(range(0, 301)) AS d FROM f) f JOIN r ON f.smp = r.smp AND f.chrom = r.chrom AND r.f3 = f.f3 + f.d) GROUP BY ALL),
g AS (SELECT a.smp, a.chrom, n_fwd, n_rev, unnest(range(0, 301)) AS "shift" FROM
 (SELECT smp, chrom, count(*) AS n_fwd FROM f GROUP BY ALL) a JOIN (SELECT smp, chrom, count(*) AS n_rev FROM r GROUP BY ALL) b
 USING (smp, chrom)),
prof AS (SELECT g.*, coalesce(n_match, 0) AS n_match FROM g LEFT JOIN m USING (smp, chrom, "shift"))"""


@query("reads_strand_shift", "reads", SHIFT_SQL + """
SELECT smp, chrom, "shift", n_match, round(n_match::DOUBLE / (n_fwd + n_rev - n_match), 6) AS jaccard FROM prof""")
def reads_strand_shift(t):
    p = R.strand_shift_profile(t.reads, 0, 300)
    return p.selectExpr(SMP, "chrom", "shift", "n_match", "round(jaccard, 6) AS jaccard")


@query("reads_fragment_length", "reads", SHIFT_SQL + """,
pool AS (SELECT smp, "shift", sum(n_match)::BIGINT AS n, sum(n_match)::DOUBLE / (sum(n_fwd) + sum(n_rev) - sum(n_match))::DOUBLE AS j
 FROM prof GROUP BY ALL)
SELECT smp, arg_max("shift", n * 1000 - "shift") AS fragment_length, round(max(j), 6) AS jaccard FROM pool
WHERE abs("shift" - 36) > 5 GROUP BY smp""")
def reads_fragment_length(t):
    p = R.estimate_fragment_length(t.reads, t.genome, 36, 5, 0, 300)
    return p.selectExpr(SMP, "fragment_length", "round(jaccard, 6) AS jaccard")


@query("reads_bins", "bins", "SELECT smp, chrom, bin, v FROM bins")
def reads_bins(t):
    return t.bins.selectExpr(SMP, "chrom", "bin", "v")


@query("reads_bins_weighted", "frags", """SELECT smp, chrom, bin, sum(w)::BIGINT AS v FROM
 (SELECT smp, chrom, trunc(1.0::DOUBLE / nh * 10000)::BIGINT AS w, unnest(range(s // 100, e // 100 + 1)) AS bin FROM frags) GROUP BY ALL""")
def reads_bins_weighted(t):
    return R.bin_reads(R.multimap_weight(t.unique_frags), BIN).selectExpr(SMP, "chrom", "bin", "v")


@query("reads_bin_ends", "paired", PAIR_FRAGS + """,
parts AS (SELECT smp, chrom, s AS ps, e AS pe FROM pfrags WHERE e - s <= 300
 UNION ALL SELECT smp, chrom, s, least(s + len_f3, e) FROM pfrags WHERE e - s > 300
 UNION ALL SELECT smp, chrom, greatest(e - len_f5, s), e FROM pfrags WHERE e - s > 300)
SELECT smp, chrom, bin, count(*) * 10000 AS v FROM
 (SELECT smp, chrom, unnest(range(ps // 100, pe // 100 + 1)) AS bin FROM parts) GROUP BY ALL""")
def reads_bin_ends(t):
    return R.bin_read_ends(R.fragments(R.pair_filter(t.paired), t.genome), BIN).selectExpr(SMP, "chrom", "bin", "v")


BED_MASK = """,
base AS (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS p FROM sites)"""
FRIP_SQL = """+ inbed AS (SELECT DISTINCT f.smp, f.chrom, f.read_id FROM frags f JOIN sites b
 ON f.chrom = b.chrom AND f.s <= b.e AND b.s <= f.e),
per AS (SELECT smp, chrom, count(*) AS n_nonred, count(i.read_id) AS n_inbed FROM frags LEFT JOIN inbed i USING (smp, chrom, read_id)
 GROUP BY GROUPING SETS ((smp, chrom), (smp)))"""


@query("reads_frip", "frags sites", FRIP_SQL + """
SELECT smp, coalesce(chrom, 'Genome') AS chrom, n_nonred, n_inbed, round(n_inbed::DOUBLE / n_nonred, 6) AS frip FROM per""")
def reads_frip(t):
    return R.frip(t.frags, t.sites, FLEN).selectExpr(
        SMP, "chrom", "n_nonred", "n_inbed", "round(frip, 6) AS frip")


COVER = """covered AS (SELECT DISTINCT smp, chrom, unnest(range(s, e + 1)) AS p FROM {frags}),
masked AS (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS p FROM bed2),
cov AS (SELECT c.smp, c.chrom, count(*) AS covered FROM covered c ANTI JOIN masked USING (chrom, p)
 GROUP BY GROUPING SETS ((smp, chrom), (smp))),
base AS (SELECT chrom, 1000000 - count(p) AS considered FROM genome LEFT JOIN masked USING (chrom) GROUP BY chrom
 UNION ALL SELECT NULL, 5000000 - (SELECT count(*) FROM masked))"""
COVER_OUT = """SELECT smp, coalesce(cov.chrom, 'Genome') AS chrom, covered, considered,
 round(covered::DOUBLE / considered, 6) AS coverage"""


def considered(t):
    whole = t.genome.select("chrom", F.lit(0).alias("start"), (F.col("length") - 1).alias("end"))
    return cut(I.combine(whole, t.part_bed, "subtract"))


@query("reads_coverage", "frags bed2 genome", "+ " + COVER.format(frags="frags") + COVER_OUT +
       " FROM cov JOIN base ON cov.chrom IS NOT DISTINCT FROM base.chrom")
def reads_coverage(t):
    return R.genome_coverage(t.frags, considered(t)).selectExpr(
        SMP, "chrom", "covered", "considered", "round(coverage, 6) AS coverage")


@query("reads_coverage_sampled", "frags bed2 genome", """+ outside AS (SELECT * FROM frags f WHERE NOT EXISTS
 (SELECT 1 FROM bed2 b WHERE b.chrom = f.chrom AND f.s <= b.e AND b.s <= f.e)),
n AS (SELECT smp, count(*) AS n FROM outside GROUP BY smp),
sub AS (SELECT o.*, n.n FROM outside o JOIN n USING (smp)
 WHERE ((read_id % 1000000007) * 2654435761 % 1000003)::DOUBLE < least(1.0::DOUBLE, 5000::DOUBLE / n.n) * 1000003),
""" + COVER.format(frags="sub") + COVER_OUT + """, n.n >= 5000 AS enough
 FROM cov JOIN base ON cov.chrom IS NOT DISTINCT FROM base.chrom JOIN n USING (smp)""")
def reads_coverage_sampled(t):
    return R.genome_coverage_at(t.unique_frags, considered(t), t.part_bed, 5000, FLEN).selectExpr(
        SMP, "chrom", "covered", "considered", "round(coverage, 6) AS coverage", "enough")


@query("reads_lengths", "paired", """SELECT smp, kind, len, count(*) AS n FROM (SELECT smp, 'read_f3' AS kind, len_f3 AS len FROM paired
 UNION ALL SELECT smp, 'read_f5', len_f5 FROM paired UNION ALL SELECT smp, 'fragment', tlen FROM paired) GROUP BY ALL""")
def reads_lengths(t):
    return R.length_distributions(t.paired).selectExpr(SMP, "kind", "len", "n")


@query("reads_common_length", "paired", """SELECT smp, kind, arg_max(len, n * 10000 - len) AS len, max(n) AS n FROM
 (SELECT smp, kind, len, count(*) AS n FROM (SELECT smp, 'read_f3' AS kind, len_f3 AS len FROM paired
 UNION ALL SELECT smp, 'read_f5', len_f5 FROM paired UNION ALL SELECT smp, 'fragment', tlen FROM paired) GROUP BY ALL) GROUP BY ALL""")
def reads_common_length(t):
    return R.most_frequent_length(R.length_distributions(t.paired)).selectExpr(SMP, "kind", "len", "n")


COUNTS = """counts AS (SELECT smp, chrom, sum(c)::BIGINT AS n, sum(c) FILTER (WHERE strand = '+')::BIGINT AS n_fwd,
 sum(c) FILTER (WHERE strand = '-')::BIGINT AS n_rev, count(*) AS n_nonred, count(*) FILTER (WHERE strand = '+') AS n_nonred_fwd,
 count(*) FILTER (WHERE strand = '-') AS n_nonred_rev
 FROM (SELECT smp, chrom, strand, f3, count(*) AS c FROM reads GROUP BY ALL) GROUP BY GROUPING SETS ((smp, chrom), (smp))),
depths AS (SELECT *, CASE WHEN chrom IS NULL THEN 5000000 ELSE 1000000 END AS len,
 n_nonred * 150.0::DOUBLE / CASE WHEN chrom IS NULL THEN 5000000 ELSE 1000000 END AS depth FROM counts)"""


@query("reads_qc_stats", "frags reads sites genome", FRIP_SQL + ",\n" + COUNTS + """,
covered AS (SELECT DISTINCT smp, chrom, unnest(range(s, e + 1)) AS p FROM frags),
masked AS (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS p FROM sites),
cov AS (SELECT c.smp, c.chrom, count(*) AS covered FROM covered c ANTI JOIN masked USING (chrom, p)
 GROUP BY GROUPING SETS ((smp, chrom), (smp))),
base AS (SELECT chrom, 1000000 - count(p) AS considered FROM genome LEFT JOIN masked USING (chrom) GROUP BY chrom
 UNION ALL SELECT NULL, 5000000 - (SELECT count(*) FROM masked)),
g AS (SELECT smp, n AS gn, n_nonred AS gnr FROM depths WHERE chrom IS NULL),
w AS (SELECT d.*, gn, 20000000::DOUBLE / gnr AS w FROM depths d JOIN g USING (smp)),
wn AS (SELECT *, trunc(n_nonred_fwd * w)::BIGINT + trunc(n_nonred_rev * w)::BIGINT AS norm1 FROM w)
SELECT a.smp, coalesce(a.chrom, 'Genome') AS chrom, len AS length, a.n, n_fwd, n_rev, round(100.0::DOUBLE * a.n / gn, 6) AS pct_genome,
 a.n_nonred, n_nonred_fwd, n_nonred_rev, a.n - a.n_nonred AS n_red, round(100.0::DOUBLE * a.n_nonred / a.n, 6) AS pct_nonred,
 round(100.0::DOUBLE * (n_rev - n_nonred_rev) / n_rev, 6) AS pct_red_rev,
 round(depth, 6) AS depth, round(w, 6) AS w, CASE WHEN a.chrom IS NULL THEN (SELECT sum(b.norm1) FROM wn b WHERE b.smp = a.smp
  AND b.chrom IS NOT NULL)::BIGINT ELSE norm1 END AS normalised, w > 2 AS noisy,
 round(covered::DOUBLE / considered, 6) AS coverage, n_inbed, round(n_inbed::DOUBLE / a.n_nonred, 6) AS frip
FROM wn a JOIN per ON a.smp = per.smp AND a.chrom IS NOT DISTINCT FROM per.chrom
JOIN cov ON a.smp = cov.smp AND a.chrom IS NOT DISTINCT FROM cov.chrom
JOIN base ON a.chrom IS NOT DISTINCT FROM base.chrom""")
def reads_qc_stats(t):
    s = R.qc_stats(t.reads, t.genome, t.sites, FLEN, norm="GR")
    return s.select(F.col("sample").alias("smp"), "chrom", "length", "n", "n_fwd", "n_rev", r6("pct_genome"),
                    "n_nonred", "n_nonred_fwd", "n_nonred_rev", "n_red", r6("pct_nonred"), r6("pct_red_rev"), r6("depth"),
                    r6("w"), "normalised", "noisy", r6("coverage"), "n_inbed", r6("frip"))


@query("reads_stats_summary", "reads", "+ " + COUNTS + """,
cov AS (SELECT smp, count(DISTINCT (chrom, p)) AS covered FROM (SELECT smp, chrom, unnest(range(
 greatest(least(f3, o), 0), least(greatest(f3, o), 999999) + 1)) AS p FROM
 (SELECT *, CASE WHEN strand = '+' THEN f3 + 150 ELSE f3 - 150 END AS o FROM reads)) GROUP BY smp)
SELECT smp, n, n_fwd, n_rev, 1 AS threshold, n_nonred, n - n_nonred AS n_red, round(depth, 6) AS depth,
 round(covered / 5e6, 6) AS coverage FROM depths JOIN cov USING (smp) WHERE chrom IS NULL""")
def reads_stats_summary(t):
    s = R.stats_summary(R.qc_stats(t.reads, t.genome))
    return s.select(F.col("sample").alias("smp"), "n", "n_fwd", "n_rev", "threshold", "n_nonred", "n_red", r6("depth"),
                    r6("coverage"))


@query("reads_scale_factors", "reads", "+ " + COUNTS + """,
g AS (SELECT smp, n_nonred AS gnr, depth AS gd FROM depths WHERE chrom IS NULL)
SELECT smp, coalesce(chrom, 'Genome') AS chrom, round(20000000::DOUBLE / gnr, 6) AS gr, round(1.0::DOUBLE / gd, 6) AS gd,
 CASE WHEN chrom IS NULL THEN 0 ELSE round(20000000::DOUBLE * (len::DOUBLE / 5000000) / n_nonred, 6) END AS cr,
 CASE WHEN chrom IS NULL THEN 0 ELSE round(1.0::DOUBLE / depth, 6) END AS cd FROM depths JOIN g USING (smp)""")
def reads_scale_factors(t):
    d = R.read_depth(R.read_counts(t.reads, t.genome), FLEN)
    for kind in ("GR", "GD", "CR", "CD"):
        d = scale_factors(d, kind).drop("normalised", "noisy").withColumnRenamed("w", kind.lower())
    return d.select(F.col("sample").alias("smp"), "chrom", r6("gr"), r6("gd"), r6("cr"), r6("cd"))


# ---- the counting workflow, paired and unfiltered -----------------------------------

#: ``folded``: one row per site with its reads ``c``, the reads ``kept`` by the filter and the fragment ``s``..``e``.
PAIRED_SITES = """+ folded AS (SELECT smp, chrom, strand, f3, f5, count(*) AS c, 1 AS kept, greatest(least(f3, f5), 0) AS s,
 least(greatest(f3, f5), 999999) AS e FROM paired WHERE chrom = mate_chrom AND tlen <= 500 GROUP BY ALL)"""
ALL_READS = """+ ended AS (SELECT *, CASE WHEN strand = '+' THEN f3 + 150 ELSE f3 - 150 END AS f5 FROM reads),
folded AS (SELECT smp, chrom, strand, f3, f5, count(*) AS c, count(*) AS kept, greatest(least(f3, f5), 0) AS s,
 least(greatest(f3, f5), 999999) AS e FROM ended GROUP BY ALL)"""
STATS = """,
hit AS (SELECT DISTINCT f.smp, f.chrom, f.strand, f.f3, f.f5 FROM folded f JOIN sites b ON f.chrom = b.chrom AND f.s <= b.e AND b.s <= f.e),
flagged AS (SELECT f.*, CASE WHEN h.smp IS NULL THEN 0 ELSE kept END AS inbed FROM folded f LEFT JOIN hit h USING (smp, chrom, strand, f3, f5)),
counts AS (SELECT smp, chrom, sum(c)::BIGINT AS n, sum(kept)::BIGINT AS n_nonred, sum(kept) FILTER (WHERE strand = '+')::BIGINT AS fwd,
 sum(kept) FILTER (WHERE strand = '-')::BIGINT AS rev, sum(inbed)::BIGINT AS n_inbed FROM flagged GROUP BY GROUPING SETS ((smp, chrom), (smp))),
covered AS (SELECT DISTINCT smp, chrom, unnest(range(s, e + 1)) AS p FROM folded),
masked AS (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS p FROM sites),
cov AS (SELECT c.smp, c.chrom, count(*) AS covered FROM covered c ANTI JOIN masked USING (chrom, p) GROUP BY GROUPING SETS ((smp, chrom), (smp))),
base AS (SELECT chrom, 1000000 - count(p) AS considered FROM genome LEFT JOIN masked USING (chrom) GROUP BY chrom
 UNION ALL SELECT NULL, 5000000 - (SELECT count(*) FROM masked)),
scaled AS (SELECT k.*, 20000000::DOUBLE / g.n_nonred AS w FROM counts k JOIN counts g ON g.smp = k.smp AND g.chrom IS NULL)
SELECT a.smp, coalesce(a.chrom, 'Genome') AS chrom, n, n_nonred, n - n_nonred AS n_red, round(w, 6) AS w,
 CASE WHEN a.chrom IS NOT NULL THEN trunc(fwd * w)::BIGINT + trunc(rev * w)::BIGINT ELSE (SELECT sum(trunc(b.fwd * b.w)::BIGINT + trunc(b.rev * b.w)::BIGINT)
  FROM scaled b WHERE b.smp = a.smp AND b.chrom IS NOT NULL)::BIGINT END AS normalised,
 round(covered::DOUBLE / considered, 6) AS coverage, n_inbed, round(n_inbed::DOUBLE / n_nonred, 6) AS frip
FROM scaled a JOIN cov ON a.smp = cov.smp AND a.chrom IS NOT DISTINCT FROM cov.chrom JOIN base ON a.chrom IS NOT DISTINCT FROM base.chrom"""


def _workflow_stats(counted):
    return counted.stats.select(F.col("sample").alias("smp"), "chrom", "n", "n_nonred", "n_red", r6("w"), "normalised", r6("coverage"),
                                "n_inbed", r6("frip"))


@query("reads_qc_stats_paired", "paired sites genome", PAIRED_SITES + STATS)
def reads_qc_stats_paired(t):
    return _workflow_stats(commands.count_reads(t.paired, t.genome, BIN, FLEN, paired=True, threshold=1, norm="GR", bed=t.sites))


@query("reads_qc_stats_unfiltered", "reads sites genome", ALL_READS + STATS)
def reads_qc_stats_unfiltered(t):
    return _workflow_stats(commands.count_reads(t.reads, t.genome, BIN, FLEN, threshold=1, keep_duplicates=True, norm="GR", bed=t.sites))


@query("bins_scaled_paired", "paired", PAIRED_SITES + """,
g AS (SELECT smp, sum(kept)::BIGINT AS n FROM folded GROUP BY smp),
b AS (SELECT smp, chrom, bin, sum(kept)::BIGINT * 10000 AS v FROM
 (SELECT smp, chrom, kept, unnest(range(s // 100, e // 100 + 1)) AS bin FROM folded) GROUP BY ALL)
SELECT smp, chrom, bin, trunc(v * (20000000::DOUBLE / n))::BIGINT AS v FROM b JOIN g USING (smp)""")
def bins_scaled_paired(t):
    return commands.count_reads(t.paired, t.genome, BIN, FLEN, paired=True, threshold=1, norm="GR").bins.selectExpr(SMP, "chrom", "bin", "v")
