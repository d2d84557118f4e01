"""Profile, matrix and site queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import intervals as I
from ..operators import profiles as PR
from .adapters import BIN
from .registry import query, r6

WIDTH = 1000


def window_sql(sites: str, value: str = "v / 1e4", source: str = "chipbins") -> str:
    """Profile of the CTE ``sites`` (site, chrom, strand, pos)."""
    return f"""{sites},
valid AS (SELECT * FROM sites0 WHERE pos - {WIDTH} >= 0 AND pos + {WIDTH} < 1000000),
cells AS (SELECT site, chrom, strand, pos // 100 AS centre, unnest(range(-10, 11)) AS k FROM valid),
prof AS (SELECT site, CASE WHEN strand = '-' THEN -k ELSE k END AS "offset", coalesce({value}, 0) AS value
 FROM cells LEFT JOIN {source} b ON b.chrom = cells.chrom AND b.bin = centre + k)"""


CHIP = "+ chipbins AS (SELECT chrom, bin, v FROM bins WHERE smp = 'chip'),\n"
RATIO = """+ chipbins AS (SELECT a.chrom, a.bin, a.v::DOUBLE / b.v AS r FROM bins a JOIN bins b USING (chrom, bin)
 WHERE a.smp = 'chip' AND b.smp = 'input'),
"""
CANON = "gtype NOT IN ('nonsense_mediated_decay', 'processed_transcript', 'retained_intron')"
TSS = f"sites0 AS (SELECT tid AS site, chrom, strand, CASE WHEN strand = '+' THEN tx_start ELSE tx_end END AS pos FROM genes WHERE {CANON})"
TES = f"sites0 AS (SELECT tid AS site, chrom, strand, CASE WHEN strand = '+' THEN tx_end ELSE tx_start END AS pos FROM genes WHERE {CANON})"
MID = "sites0 AS (SELECT chrom || '-' || s || '-' || e AS site, chrom, '+' AS strand, (s + e) // 2 AS pos FROM sites)"
AGG = """
SELECT 'S1' AS label, "offset", round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(*) AS n,
 round(1.96::DOUBLE * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS ci FROM prof GROUP BY "offset\""""


@query("sites_profile_tss", "bins genes", CHIP + window_sql(TSS) + """
SELECT 'S1' AS label, site, "offset", round(value, 6) AS value FROM prof""")
def sites_profile_tss(t):
    return PR.profile_tss(t.genes, t.bins, t.pairs, t.genome, BIN, WIDTH).select("label", "site", "offset", r6("value"))


@query("sites_profile_tes_ratio", "bins genes", RATIO + window_sql(TES, "r") + """
SELECT site, "offset", round(value, 6) AS value FROM prof""")
def sites_profile_tes_ratio(t):
    return PR.profile_tes(t.genes, t.bins, t.pairs, t.genome, BIN, WIDTH, 1).select("site", "offset", r6("value"))


@query("sites_profile_bed", "bins sites", CHIP + window_sql(MID) + """
SELECT "offset", round(sum(value), 6) AS total, count(*) AS n FROM prof GROUP BY "offset\"""")
def sites_profile_bed(t):
    p = PR.profile_sites(t.sites, t.bins, t.pairs, t.genome, BIN, WIDTH)
    return p.groupBy("offset").agg(r6(F.sum("value"), "total"), F.count("*").alias("n"))


@query("sites_aggregate", "bins sites", CHIP + window_sql(MID) + AGG)
def sites_aggregate(t):
    p = PR.profile_sites(t.sites, t.bins, t.pairs, t.genome, BIN, WIDTH)
    return PR.aggregate_profile(p).select("label", "offset", r6("mean"), r6("sd"), "n", r6("ci"))


@query("sites_profile_limits", "bins genes", CHIP + window_sql(TSS) + """
SELECT 0.0::DOUBLE AS ymin, ceil(max(m))::DOUBLE AS ymax FROM (SELECT avg(value) AS m FROM prof GROUP BY "offset")""")
def sites_profile_limits(t):
    p = PR.profile_tss(t.genes, t.bins, t.pairs, t.genome, BIN, WIDTH)
    return PR.profile_limits(PR.aggregate_profile(p))


@query("sites_counts", "genes", "+ " + TSS + f"""
SELECT count(*) AS n_sites, count(*) FILTER (WHERE NOT (pos - {WIDTH} >= 0 AND pos + {WIDTH} < 1000000)) AS n_skipped FROM sites0""")
def sites_counts(t):
    return PR.site_counts(PR._gene_sites(t.genes, True), t.genome, WIDTH)


BODY = """blocks0 AS (SELECT tid AS site, chrom, strand, tx_start::DOUBLE AS ts, tx_end::DOUBLE AS te, (tx_end - tx_start)::DOUBLE AS len,
 {flank}::DOUBLE AS fl, unnest(range(0, 300)) AS i FROM genes WHERE """ + CANON + """
 AND tx_end + {flank} < 1000000 AND tx_start - {flank} >= 0),
"""
BODY_VALUES = """,
ranges AS (SELECT site, chrom, i, trunc(a / 100)::BIGINT AS sb, trunc(b / 100)::BIGINT AS eb FROM blocks),
cells AS (SELECT site, i, chrom, sb, eb, unnest(range(sb, eb + 1)) AS bin FROM ranges),
sums AS (SELECT site, i, sum(v) / 1e4 AS total FROM cells JOIN chipbins USING (chrom, bin) GROUP BY ALL)
SELECT site, i - 100 AS "offset", round(CASE WHEN eb >= sb THEN coalesce(total, 0) / (eb - sb + 1) ELSE 0 END, 6) AS value
FROM ranges LEFT JOIN sums USING (site, i)"""


@query("sites_gene_body", "bins genes", CHIP + BODY.format(flank="(tx_end - tx_start)") + """blocks AS (SELECT site, chrom, i,
 CASE WHEN strand = '+' THEN ts - len + len / 100 * i ELSE te + len - len / 100 * (i + 1) END AS a,
 CASE WHEN strand = '+' THEN ts - len + len / 100 * (i + 1) - 1 ELSE te + len - len / 100 * i - 1 END AS b FROM blocks0)""" + BODY_VALUES)
def sites_gene_body(t):
    return PR.profile_gene_body(t.genes, t.bins, t.pairs, t.genome, BIN).select("site", "offset", r6("value"))


@query("sites_gene_body_fixed", "bins genes", CHIP + BODY.format(flank="2500") + """blocks AS (SELECT site, chrom, i,
 CASE WHEN strand = '+' THEN CASE WHEN i < 100 THEN ts - fl + fl / 100 * i WHEN i < 200 THEN ts + len / 100 * (i - 100)
   ELSE te + fl / 100 * (i - 200) END
  ELSE CASE WHEN i < 100 THEN te + fl - fl / 100 * (i + 1) WHEN i < 200 THEN te - len / 100 * (i + 1 - 100)
   ELSE ts - fl / 100 * (i + 1 - 200) END END AS a,
 CASE WHEN strand = '+' THEN CASE WHEN i < 100 THEN ts - fl + fl / 100 * (i + 1) - 1 WHEN i < 200 THEN ts + len / 100 * (i + 1 - 100) - 1
   ELSE te + fl / 100 * (i + 1 - 200) - 1 END
  ELSE CASE WHEN i < 100 THEN te + fl - fl / 100 * i - 1 WHEN i < 200 THEN te - len / 100 * (i - 100) - 1
   ELSE ts - fl / 100 * (i - 200) - 1 END END AS b FROM blocks0)""" + BODY_VALUES)
def sites_gene_body_fixed(t):
    return PR.profile_gene_body_fixed(t.genes, t.bins, t.pairs, t.genome, BIN).select("site", "offset", r6("value"))


def matrix_sql(agg: str) -> str:
    return f"""+ inside AS (SELECT *, s // 100 AS sb, (e - 1) // 100 AS eb FROM sites WHERE e < 1000000),
cells AS (SELECT name, chrom, unnest(range(sb, eb + 1)) AS bin FROM inside),
vals AS (SELECT name, sum(v) / 1e4 AS total, max(v) / 1e4 AS top FROM cells JOIN bins USING (chrom, bin) WHERE smp = 'chip' GROUP BY name)
SELECT chrom, s AS "start", e AS "end", name, round({agg}, 6) AS "S1" FROM inside LEFT JOIN vals USING (name)"""


@query("sites_matrix_mean", "bins sites", matrix_sql("coalesce(total, 0) / (eb - sb + 1)"))
def sites_matrix_mean(t):
    m = PR.site_matrix(t.sites, t.bins, t.pairs, t.genome, BIN, "mean")
    return m.select("chrom", "start", "end", "name", r6("S1"))


@query("sites_matrix_max", "bins sites", matrix_sql("coalesce(top, 0)"))
def sites_matrix_max(t):
    m = PR.site_matrix(t.sites, t.bins, t.pairs, t.genome, BIN, "max")
    return m.select("chrom", "start", "end", "name", r6("S1"))


@query("sites_matrix_log1p", "bins sites", matrix_sql("ln(1 + coalesce(total, 0) / (eb - sb + 1))"))
def sites_matrix_log1p(t):
    m = PR.log1p_matrix(PR.site_matrix(t.sites, t.bins, t.pairs, t.genome, BIN, "mean"), ["S1"])
    return m.select("chrom", "start", "end", "name", r6("S1"))


@query("sites_heatmap", "bins sites", CHIP + window_sql(MID) + """,
k AS (SELECT site, row_number() OVER (ORDER BY value DESC, site) - 1 AS row_rank FROM (SELECT DISTINCT site, value FROM prof WHERE "offset" = 0))
SELECT site, "offset", row_rank, round(least(greatest(value, 0), 3), 6) AS value FROM prof JOIN k USING (site)""")
def sites_heatmap(t):
    p = PR.profile_sites(t.sites, t.bins, t.pairs, t.genome, BIN, WIDTH, packed=True)
    return PR.heatmap_order(p, "S1", 3.0, 0).select("site", "offset", "row_rank", r6("value"))


@query("sites_gene_loci", "genes", """SELECT chrom, greatest(tx_start - 50000, 0) AS "start", least(tx_end + 50000, 999999) AS "end", gname AS name
 FROM genes WHERE gname IN (SELECT 'G' || (o_custkey % 300) FROM orders)""")
def sites_gene_loci(t):
    names = t.raw("orders").selectExpr("concat('G', o_custkey % 300) AS name")
    return PR.gene_loci_regions(t.genes, names, t.genome)


@query("sites_no_sex_mito", "", """SELECT chrom, count(*) AS n FROM (SELECT CASE p_partkey % 7 WHEN 0 THEN 'chrY' WHEN 1 THEN 'chrM' WHEN 2 THEN 'Mt'
 ELSE 'chr' || (p_partkey % 7) END AS chrom FROM part) WHERE chrom NOT IN ('chrY', 'chrM', 'Mt') GROUP BY chrom""")
def sites_no_sex_mito(t):
    k = F.col("p_partkey") % 7
    c = F.when(k == 0, "chrY").when(k == 1, "chrM").when(k == 2, "Mt").otherwise(F.concat(F.lit("chr"), k.cast("string")))
    return S.drop_sex_mito(t.raw("part").select(c.alias("chrom"))).groupBy("chrom").agg(F.count("*").alias("n"))


@query("sites_in_regions", "sites bed2", """+ m AS (SELECT chrom, p, p - row_number() OVER (PARTITION BY chrom ORDER BY p) AS g FROM
 (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS p FROM bed2)),
r AS (SELECT chrom, min(p) AS rs, max(p) AS re FROM m GROUP BY chrom, g)
SELECT sites.chrom, name, greatest(s, rs) AS "start", least(e, re) AS "end" FROM sites JOIN r ON r.chrom = sites.chrom AND s <= re AND rs <= e""")
def sites_in_regions(t):
    return I.restrict_to_regions(t.sites, t.part_bed).select("chrom", "name", "start", "end")
