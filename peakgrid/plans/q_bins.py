"""Bin, score and track queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import scores as X
from ..operators import bins as B
from ..operators import intervals as I
from ..operators import peaks as P
from ..operators import reads as R
from ..operators import tracks as T
from .adapters import BIN, FLEN
from .q_peaks import SCORES, gauss_sql, sided_sql
from .registry import query, r6

SMP = "sample AS smp"
ONE = SCORES.replace("ratio", "1.0::DOUBLE")


@query("bins_dense", "dense", "SELECT smp, chrom, bin, v FROM dense")
def bins_dense(t):
    return B.densify(t.bins, t.genome, BIN, ["chip", "input"]).selectExpr(SMP, "chrom", "bin", "v")


@query("bins_mappability", "bins mappability", """SELECT smp, chrom, bin,
 CASE WHEN fraction > 0.3::DOUBLE THEN trunc(v * (1.0::DOUBLE / fraction))::BIGINT ELSE v END AS v FROM bins LEFT JOIN mappability USING (chrom, bin)""")
def bins_mappability(t):
    return B.mappability_normalise(t.bins, t.mappability).selectExpr(SMP, "chrom", "bin", "v")


@query("bins_total_read_normalised", "bins reads", """+ n AS (SELECT smp, count(DISTINCT (chrom, strand, f3)) AS n FROM reads GROUP BY smp)
SELECT smp, chrom, bin, trunc(v * (100000::DOUBLE / n))::BIGINT AS v FROM bins JOIN n USING (smp)""")
def bins_total_read_normalised(t):
    f = B.scale_factors(R.read_depth(R.read_counts(t.reads, t.genome), FLEN), "GR", 100_000)
    return B.total_read_normalise(t.bins, f).selectExpr(SMP, "chrom", "bin", "v")


@query("bins_depth_normalised", "bins reads", """+ n AS (SELECT smp, chrom, count(DISTINCT (strand, f3)) AS n FROM reads GROUP BY ALL)
SELECT smp, chrom, bin, trunc(v * (1.0::DOUBLE / (n * 150.0::DOUBLE / 1000000)))::BIGINT AS v FROM bins JOIN n USING (smp, chrom)""")
def bins_depth_normalised(t):
    f = B.scale_factors(R.read_depth(R.read_counts(t.reads, t.genome), FLEN), "CD", ndepth=1.0)
    return B.total_read_normalise(t.bins, f).selectExpr(SMP, "chrom", "bin", "v")


@query("bins_smooth_average", "dense", """+ a AS (SELECT smp, chrom, bin, trunc((sum(v) OVER w)::DOUBLE / (count(*) OVER w))::BIGINT AS v FROM dense
 WINDOW w AS (PARTITION BY smp, chrom ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT * FROM a WHERE v <> 0""")
def bins_smooth_average(t):
    return B.smooth_average(t.bins, t.genome, BIN, 3).selectExpr(SMP, "chrom", "bin", "v")


@query("bins_smooth_gaussian", "dense", f"""+ a AS (SELECT smp, chrom, bin, {gauss_sql('v', 5)} AS v FROM dense
 WINDOW w AS (PARTITION BY smp, chrom ORDER BY bin)) SELECT * FROM a WHERE v <> 0""")
def bins_smooth_gaussian(t):
    return B.smooth_gaussian(t.bins, t.genome, BIN, 5).selectExpr(SMP, "chrom", "bin", "v")


@query("bins_local_lambda", "dense", """+ a AS (SELECT smp, chrom, bin, v, (sum(v) OVER (PARTITION BY smp, chrom ORDER BY bin
 ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING))::BIGINT // (least(bin + 500, 10001) - greatest(bin - 500, 0)) AS lam FROM dense)
SELECT * FROM a WHERE v <> 0""")
def bins_local_lambda(t):
    return B.local_lambda(t.bins, t.genome, BIN).selectExpr(SMP, "chrom", "bin", "v", "lam")


@query("bins_percentile", "bins", """SELECT smp, chrom, v AS percentile FROM (SELECT *, row_number() OVER (PARTITION BY smp, chrom ORDER BY v) - 1 AS r,
 floor(count(*) OVER (PARTITION BY smp, chrom) * 0.95::DOUBLE) AS k FROM bins WHERE v <> 0) WHERE r = k""")
def bins_percentile(t):
    return B.nonzero_percentile(t.bins, 0.95).selectExpr(SMP, "chrom", "percentile")


@query("bins_signal_total", "bins", """+ c AS (SELECT smp, chrom, sum(v)::BIGINT // 10000 AS total FROM bins GROUP BY ALL)
SELECT smp, coalesce(chrom, 'Genome') AS chrom, sum(total)::BIGINT AS total FROM c GROUP BY GROUPING SETS ((smp, chrom), (smp))""")
def bins_signal_total(t):
    return B.signal_total(t.bins).selectExpr(SMP, "chrom", "total")


@query("bins_light_stats", "bins", """+ c AS (SELECT smp, chrom, sum(v)::BIGINT // 10000 AS total FROM bins GROUP BY ALL),
s AS (SELECT smp, chrom, sum(total)::BIGINT AS total FROM c GROUP BY GROUPING SETS ((smp, chrom), (smp)))
SELECT smp, coalesce(chrom, 'Genome') AS chrom, total, round(total * 150::DOUBLE / CASE WHEN chrom IS NULL THEN 5000000 ELSE 1000000 END, 6) AS depth FROM s""")
def bins_light_stats(t):
    return B.light_stats(t.bins, t.genome).selectExpr(SMP, "chrom", "total", "round(depth, 6) AS depth")


@query("bins_chip_input_ratio", "bins", """+ c AS (SELECT smp, chrom, sum(v)::BIGINT // 10000 AS t FROM bins GROUP BY ALL)
SELECT 'S1' AS label, a.chrom, round(a.t::DOUBLE / b.t, 6) AS ratio FROM c a JOIN c b USING (chrom) WHERE a.smp = 'chip' AND b.smp = 'input'""")
def bins_chip_input_ratio(t):
    return B.chip_input_ratio(t.bins, t.pairs, 2).select("label", "chrom", r6("ratio"))


@query("bins_value_distribution", "dense", """+ p AS (SELECT smp, chrom, v AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY smp, chrom ORDER BY v) - 1 AS r,
 floor(count(*) OVER (PARTITION BY smp, chrom) * 0.95::DOUBLE) AS k FROM dense WHERE v <> 0) WHERE r = k),
d AS (SELECT smp, chrom, v // 10000 AS value, count(*) AS n FROM dense JOIN p USING (smp, chrom)
 WHERE (v // 10000) * 10000 < p95 AND v // 10000 < 200 GROUP BY ALL)
SELECT smp, coalesce(chrom, 'Genome') AS chrom, value, sum(n)::BIGINT AS n_bins,
 round(sum(n)::DOUBLE / CASE WHEN chrom IS NULL THEN 50005 ELSE 10001 END, 6) AS prop
FROM d GROUP BY GROUPING SETS ((smp, chrom, value), (smp, value))""")
def bins_value_distribution(t):
    return B.bin_value_distribution(t.bins, t.genome, BIN).selectExpr(
        SMP, "chrom", "value", "n_bins", "round(prop, 6) AS prop")


@query("bins_rebin", "bins", """SELECT smp, chrom, nb AS bin, trunc(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM
 (SELECT smp, chrom, v, unnest(range(bin * 100 // 250, (bin * 100 + 99) // 250 + 1)) AS nb FROM bins) GROUP BY ALL""")
def bins_rebin(t):
    return B.rebin(B.bins_to_rows(t.bins, BIN), 250).selectExpr(SMP, "chrom", "bin", "v")


@query("bins_mappable_fraction", "mapseg", """+ p AS (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS p FROM mapseg)
SELECT chrom, p // 100 AS bin, round(count(*) / 100::DOUBLE, 4) AS fraction FROM p GROUP BY ALL""")
def bins_mappable_fraction(t):
    return B.bin_mappability(t.mappable_segments, BIN)


@query("bins_in_regions", "bins bed2", """SELECT smp, chrom, bin, v FROM bins SEMI JOIN
 (SELECT DISTINCT chrom, unnest(range(s // 100, e // 100 + 1)) AS bin FROM bed2) USING (chrom, bin)""")
def bins_in_regions(t):
    return I.restrict_bins(t.bins, t.part_bed, BIN).selectExpr(SMP, "chrom", "bin", "v")


@query("bins_one_chrom", "bins", "SELECT smp, bin, v FROM bins WHERE chrom = 'chr2'")
def bins_one_chrom(t):
    return S.only_chrom(t.bins, t.genome, "chr2").selectExpr(SMP, "bin", "v")


# ---- scores --------------------------------------------------------------------

@query("scores_poisson", "dense", sided_sql(0) + ONE + """
SELECT chrom, bin, round(pint, 6) AS score FROM scores WHERE c > 0""")
def scores_poisson(t):
    s = P.scored_bins(t.bins, t.pairs, t.genome, BIN)
    return s.select("chrom", "bin", r6("p_internal", "score"))


@query("scores_binomial", "dense", sided_sql(0) + """, r AS (SELECT *, ceil(c / 1e4 / 1.7::DOUBLE) AS n1, ceil(i / 1e4) AS n2 FROM sided WHERE c > 0)
SELECT chrom, bin, round(CASE WHEN n1 < n2 THEN 0 ELSE -(lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1)
 - (n1 + n2) * ln(2)) / ln(10) END, 6) AS score FROM r""")
def scores_binomial(t):
    side = P.pair_bins(t.bins, t.pairs).groupBy("chrom", "bin").agg(F.sum("c").alias("c"), F.sum("i").alias("i"))
    s = X.with_binomial_score(side.filter("c > 0"), S.from_fixed(F.col("c")), S.from_fixed(F.col("i")), F.lit(1.7), "score")
    return s.select("chrom", "bin", r6("score"))


@query("scores_ratio", "dense", sided_sql(0) + """
SELECT chrom, bin, round(CASE WHEN i <> 0 THEN c::DOUBLE / i * 1.5::DOUBLE ELSE 0 END, 6) AS scaled,
 round(CASE WHEN i <> 0 THEN c::DOUBLE / i ELSE 0 END, 6) AS plain,
 round(CASE WHEN i <> 0 AND c <> 0 THEN ln(c::DOUBLE / i) / ln(5) ELSE 0 END, 6) AS logr FROM sided WHERE c <> 0 OR i <> 0""")
def scores_ratio(t):
    side = P.pair_bins(t.bins, t.pairs).groupBy("chrom", "bin").agg(F.sum("c").alias("c"), F.sum("i").alias("i"))
    plain = S.safe_ratio(F.col("c"), F.col("i"))
    scaled = X.scaled_ratio(S.from_fixed(F.col("c")), S.from_fixed(F.col("i")), F.lit(1.5))
    return side.select("chrom", "bin", r6(scaled, "scaled"), r6(plain, "plain"), r6(X.log_ratio(plain, 5.0), "logr"))


@query("scores_genwig_ratio", "dense", sided_sql(0) + """
SELECT chrom, bin, trunc(CASE WHEN i <> 0 THEN c::DOUBLE / i ELSE 0 END * 10000)::BIGINT AS v FROM sided""")
def scores_genwig_ratio(t):
    return T.genwig(t.bins, t.pairs, t.genome, BIN, ["S1"], 0).select("chrom", "bin", "v")


@query("scores_genwig_internal", "dense", sided_sql(0) + ONE + """
SELECT chrom, bin, round(trunc(pint * 10000 + 1e-7) / 10000, 2) AS value FROM scores""")
def scores_genwig_internal(t):
    g = T.genwig(t.bins, t.pairs, t.genome, BIN, ["S1"], 1)
    return g.select("chrom", "bin", F.round(S.from_fixed(F.col("v")), 2).alias("value"))


@query("scores_genwig_enrichment", "dense", sided_sql(0) + ONE + """
SELECT chrom, bin, round(trunc(penr * 10000 + 1e-7) / 10000, 2) AS value FROM scores""")
def scores_genwig_enrichment(t):
    g = T.genwig(t.bins, t.pairs, t.genome, BIN, ["S1"], 2)
    return g.select("chrom", "bin", F.round(S.from_fixed(F.col("v")), 2).alias("value"))


# ---- tracks --------------------------------------------------------------------

@query("tracks_thinned", "bins", """+ g AS (SELECT smp, chrom, (bin - 7) // 5 AS grp, bin, v / 1e4 AS value FROM bins
 WHERE bin >= 7 AND bin < 9990 AND ((bin - 7) // 5) * 5 + 7 < 9986)
SELECT smp, chrom, grp, first(value ORDER BY abs(value) DESC, bin) AS value FROM g GROUP BY ALL""")
def tracks_thinned(t):
    values = t.bins.select("sample", "chrom", "bin", S.from_fixed(F.col("v")).alias("value"))
    return T.downsample_track(values, 7, 9990, T.thin_factor(500_000, BIN), ["sample", "chrom"]).selectExpr(
        SMP, "chrom", "grp", "value")


VIEW = sided_sql(0) + ONE + """, long AS (SELECT bin, 'pinter' AS layer, pint AS value FROM v UNION ALL SELECT bin, 'penrich', penr FROM v
 UNION ALL SELECT bin, 'ratio', enr FROM v UNION ALL SELECT bin, 'logratio', CASE WHEN enr > 0 THEN ln(enr) / ln(5) ELSE 0 END FROM v
 UNION ALL SELECT bin, 'chip', cv FROM v UNION ALL SELECT bin, 'input', iv FROM v),
placed AS (SELECT *, (bin * 100 - 100000) // 200000 AS line FROM long WHERE bin * 100 >= 100000 AND bin * 100 <= 750000 AND value <> 0),
grouped AS (SELECT *, (bin - (line * 200000 + 100000) // 100) // 2 AS grp, (line * 200000 + 100000) // 100 AS b0,
 least((line + 1) * 200000 + 100000, 750000) // 100 AS b1 FROM placed),
thin AS (SELECT layer, line, line // 2 AS page, grp, first(value ORDER BY abs(value) DESC, bin) AS value FROM grouped
 WHERE bin < b1 AND grp * 2 + b0 < b1 - 1 GROUP BY ALL),
lim AS (SELECT *, CASE WHEN layer IN ('pinter', 'penrich', 'ratio') THEN 10 WHEN layer = 'logratio' THEN 2 ELSE 60 END AS m FROM thin)
SELECT layer, line, page, grp, round(value, 6) AS value, round(CASE WHEN layer = 'logratio' THEN greatest(least(value, m), -m)
 ELSE greatest(least(value, m), 0) END, 6) AS drawn, CASE layer WHEN 'pinter' THEN value >= 5 WHEN 'penrich' THEN value >= 4
 WHEN 'ratio' THEN value >= 2 WHEN 'logratio' THEN value >= 0 ELSE false END AS marked FROM lim"""


@query("tracks_view", "dense", VIEW.replace(", long AS", ", v AS (SELECT * FROM scores WHERE chrom = 'chr3'), long AS"))
def tracks_view(t):
    v = T.track_view(t.bins, t.pairs, t.genome, BIN, "chr3", 100_000, 750_000, width=200_000, per_page=2)
    return v.select("layer", "line", "page", "grp", r6("value"), r6("drawn"), "marked")


@query("tracks_lines", "bed2", """+ r AS (SELECT chrom, s, e, name, unnest(range(0, (e - s - 1) // 300 + 1)) AS line FROM bed2)
SELECT chrom, name, line, line // 2 AS page, s + line * 300 AS line_start, least(s + line * 300 + 300, e) AS line_end FROM r""")
def tracks_lines(t):
    return T.line_table(t.part_bed, 300, 2).select("chrom", "name", "line", "page", "line_start", "line_end")


@query("tracks_clipped", "dense", sided_sql(0) + """
SELECT chrom, bin, round(greatest(least(c / 1e4 - i / 1e4, 4), -2), 6) AS drawn, c / 1e4 - i / 1e4 >= 3 AS marked FROM sided WHERE c <> 0 OR i <> 0""")
def tracks_clipped(t):
    side = P.pair_bins(t.bins, t.pairs).groupBy("chrom", "bin").agg(F.sum("c").alias("c"), F.sum("i").alias("i"))
    side = side.withColumn("value", S.from_fixed(F.col("c")) - S.from_fixed(F.col("i")))
    out = T.clipped(side, 2.0, 2, True, 1)
    return out.select("chrom", "bin", r6("drawn"), T.highlight(F.col("value"), 3.0).alias("marked"))


@query("tracks_graph_range", "", """WITH w AS (SELECT event_type AS chrom, (event_id * 104729) % 1000000 // 100000 * 100000 AS "start", count(*)::DOUBLE AS value FROM events GROUP BY ALL),
m AS (SELECT greatest(max(value), 20) AS top FROM w)
SELECT chrom, "start", value, 0.0::DOUBLE AS ymin, top AS ymax, round(value / top, 6) AS scaled FROM w, m""")
def tracks_graph_range(t):
    win = t.barcodes.groupBy("chrom", (T.div("pos", 100_000) * 100_000).alias("start")).agg(
        F.count("*").cast("double").alias("value"))
    return T.graph_range(win).select("chrom", "start", "value", "ymin", "ymax", r6("scaled"))
