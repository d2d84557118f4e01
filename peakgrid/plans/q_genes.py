"""Gene, interval, loop, barcode and GC queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import barcodes as BC
from ..operators import bins as B
from ..operators import gc as GC
from ..operators import genes as G
from ..operators import intervals as I
from ..operators import loops as L
from ..session import cut, lookup
from .registry import query, r6

# ---- intervals -----------------------------------------------------------------


def union_sql(name: str, table: str, where: str = "") -> str:
    """Merged intervals of a CTE by a running maximum."""
    return f"""{name}0 AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
 FROM {table} {where}),
{name}1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e
 ROWS UNBOUNDED PRECEDING) AS g FROM {name}0),
{name} AS (SELECT chrom, min(s) AS s, max(e) AS e FROM {name}1 GROUP BY chrom, g)"""


@query("intervals_union", "sites", "+ " + union_sql("u", "sites") + ' SELECT chrom, s AS "start", e AS "end" FROM u')
def intervals_union(t):
    return I.merge_intervals(t.sites)


@query("intervals_overlap_join", "sites bed2", """SELECT a.name AS site, b.name AS bed, a.chrom FROM sites a JOIN bed2 b
 ON a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e""")
def intervals_overlap_join(t):
    b = t.part_bed.selectExpr("chrom", "start AS b_start", "end AS b_end", "name AS bed")
    return I.overlap_join(t.sites, b, right_span=("b_start", "b_end")).selectExpr("name AS site", "bed", "chrom")


@query("intervals_semi", "sites bed2", """SELECT name, chrom FROM sites a WHERE EXISTS (SELECT 1 FROM bed2 b
 WHERE a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e)""")
def intervals_semi(t):
    return I.overlaps_any(t.sites, t.part_bed).select("name", "chrom")


@query("intervals_anti", "sites bed2", """SELECT name, chrom FROM sites a WHERE NOT EXISTS (SELECT 1 FROM bed2 b
 WHERE a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e)""")
def intervals_anti(t):
    return I.overlaps_any(t.sites, t.part_bed, 1000, anti=True).select("name", "chrom")


def base_sql(name: str, body: str) -> str:
    """Runs of single bases as intervals."""
    return f"""{name}0 AS ({body}),
{name} AS (SELECT chrom, min(p) AS "start", max(p) AS "end" FROM (SELECT chrom, p, p - row_number() OVER (PARTITION BY chrom ORDER BY p) AS g
 FROM {name}0) GROUP BY chrom, g)"""


@query("intervals_subtract", "sites bed2", "+ " + base_sql("d", """SELECT DISTINCT chrom, p FROM (SELECT chrom, unnest(range(s, e + 1)) AS p FROM sites)
 ANTI JOIN (SELECT chrom, unnest(range(s, e + 1)) AS p FROM bed2) USING (chrom, p)""") + " SELECT * FROM d")
def intervals_subtract(t):
    return I.combine(t.sites, t.part_bed, "subtract")


@query("intervals_intersect", "sites bed2", "+ " + base_sql("d", """SELECT DISTINCT chrom, p FROM (SELECT chrom, unnest(range(s, e + 1)) AS p FROM sites)
 SEMI JOIN (SELECT chrom, unnest(range(s, e + 1)) AS p FROM bed2) USING (chrom, p)""") + " SELECT * FROM d")
def intervals_intersect(t):
    return I.combine(t.sites, t.part_bed, "intersect")


@query("intervals_depth", "sites", """+ d AS (SELECT chrom, p, count(*) AS depth FROM (SELECT chrom, unnest(range(s, e + 1)) AS p FROM sites) GROUP BY ALL)
SELECT chrom, depth, count(*) AS bases FROM d GROUP BY ALL""")
def intervals_depth(t):
    return (I.overlay({"depth": t.sites}).groupBy("chrom", "depth")
            .agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases")))


@query("intervals_status", "mapseg sites genome", """+ st AS (SELECT chrom, p, CASE WHEN i.p IS NOT NULL THEN 'INBED' WHEN m.p IS NOT NULL THEN 'MAPPABLE'
 ELSE 'UNMAPPABLE' END AS status FROM (SELECT chrom, unnest(range(0, 1000000)) AS p FROM genome)
 LEFT JOIN (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS p FROM mapseg) m USING (chrom, p)
 LEFT JOIN (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS p FROM sites) i USING (chrom, p))
SELECT chrom, min(p) AS "start", max(p) AS "end", status FROM (SELECT *, p - row_number() OVER (PARTITION BY chrom, status ORDER BY p) AS g FROM st)
GROUP BY chrom, status, g""")
def intervals_status(t):
    return I.status_segments(t.genome, t.mappable_segments, t.sites)


@query("intervals_mappable_table", "mapseg", """SELECT chrom, count(DISTINCT p) AS mappable FROM
 (SELECT chrom, unnest(range(s, e + 1)) AS p FROM mapseg) GROUP BY chrom""")
def intervals_mappable_table(t):
    return I.mappability_table(t.mappable_segments)


@query("intervals_longest_chrom", "mapseg", """SELECT arg_max(chrom, mappable * 10 - o) AS chrom, max(mappable) AS mappable FROM
 (SELECT chrom, count(DISTINCT p) AS mappable, CAST(substr(chrom, 4) AS INT) AS o FROM
 (SELECT chrom, unnest(range(s, e + 1)) AS p FROM mapseg) GROUP BY chrom)""")
def intervals_longest_chrom(t):
    m = I.mappability_table(t.mappable_segments)
    return B.longest_chrom(t.genome.drop("mappable").join(m, "chrom", "left"))


# ---- genes ---------------------------------------------------------------------

@query("genes_representative", "genes", """SELECT chrom, gid, tid FROM genes QUALIFY row_number() OVER (PARTITION BY chrom, gid
 ORDER BY CASE tag WHEN 'CCDS' THEN 0 WHEN 'basic' THEN 1 ELSE 2 END, tx_end - tx_start DESC, tid) = 1""")
def genes_representative(t):
    return G.representative_transcript(t.genes).select("chrom", "gid", "tid")


@query("genes_transcripts", "", """WITH e AS (SELECT 'chr' || (l_orderkey % 5 + 1) AS chrom, CAST(l_orderkey AS VARCHAR) AS tid, l_orderkey * 613 % 900000 + l_linenumber * 1000 AS s,
 l_orderkey * 613 % 900000 + l_linenumber * 1000 + 100 + l_suppkey AS e, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
 CASE WHEN l_linenumber = 1 THEN 'start_codon' WHEN l_linenumber = 7 THEN 'stop_codon' WHEN l_linenumber = 6 THEN 'transcript' ELSE 'exon' END AS f,
 CASE l_partkey % 4 WHEN 0 THEN 'CCDS' WHEN 1 THEN 'basic' WHEN 2 THEN 'x' ELSE '' END AS tag FROM lineitem WHERE l_linenumber <> 6)
SELECT chrom, tid, coalesce(min(s) FILTER (WHERE f = 'exon'), 0) AS tx_start, coalesce(max(e) FILTER (WHERE f = 'exon'), 0) AS tx_end,
 coalesce(min(s) FILTER (WHERE (f = 'start_codon' AND strand = '+') OR (f = 'stop_codon' AND strand = '-')), min(s) FILTER (WHERE f = 'exon'), 0) AS cds_start,
 coalesce(max(e) FILTER (WHERE (f = 'stop_codon' AND strand = '+') OR (f = 'start_codon' AND strand = '-')), max(e) FILTER (WHERE f = 'exon'), 0) AS cds_end,
 count(*) FILTER (WHERE f = 'exon') AS exon_count,
 arg_max(tag, CASE tag WHEN 'CCDS' THEN 3 WHEN 'basic' THEN 2 WHEN 'x' THEN 1 ELSE 0 END) AS tag FROM e GROUP BY ALL""")
def genes_transcripts(t):
    rows = t.raw("lineitem").selectExpr(
        "concat('chr', l_orderkey % 5 + 1) AS chrom", "CAST(l_orderkey AS STRING) AS tid", "CAST(l_orderkey AS STRING) AS gid",
        "'' AS tname", "'' AS gname", "CAST(l_orderkey * 613 % 900000 + l_linenumber * 1000 AS INT) AS start",
        "CAST(l_orderkey * 613 % 900000 + l_linenumber * 1000 + 100 + l_suppkey AS INT) AS end",
        "CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand",
        "CASE WHEN l_linenumber = 1 THEN 'start_codon' WHEN l_linenumber = 7 THEN 'stop_codon' WHEN l_linenumber = 6 THEN 'transcript' ELSE 'exon' END AS feature",
        "CASE l_partkey % 4 WHEN 0 THEN 'CCDS' WHEN 1 THEN 'basic' WHEN 2 THEN 'x' ELSE '' END AS tag",
        "'' AS gtype", "'' AS ttype")
    return G.assemble_transcripts(rows).select("chrom", "tid", "tx_start", "tx_end", "cds_start", "cds_end", "exon_count", "tag")


@query("genes_in_window", "genes", """SELECT tid, tx_start, tx_end FROM genes WHERE chrom = 'chr2' AND tx_start <= 400000 AND tx_end >= 100000""")
def genes_in_window(t):
    return G.genes_in_window(t.genes, "chr2", 100_000, 400_000).select("tid", "tx_start", "tx_end")


@query("genes_classes", "", """SELECT p_partkey, CASE WHEN g LIKE '%protein_coding%' THEN 'protein_coding' WHEN g LIKE '%noncoding RNA%' THEN 'noncoding RNA'
 WHEN g LIKE '%lincRNA%' THEN 'lincRNA' WHEN g LIKE '%antisense%' THEN 'antisense' WHEN g LIKE '%RNA%' THEN 'RNA'
 WHEN g LIKE '%pseudo%' THEN 'pseudo' ELSE 'other' END AS cls,
 CASE WHEN r <= 3 THEN ['I', 'II', 'III'][r] WHEN r = 16 THEN 'XVI' ELSE 'z' END AS roman,
 CASE WHEN st IN ('gpos25', 'gpos33', 'stalk') THEN 'gpos25' WHEN st IN ('gpos66', 'gpos75') THEN 'gpos75' ELSE 'unknown' END AS stain
 FROM (SELECT p_partkey, ['protein_coding_x', 'noncoding RNA', 'lincRNA', 'antisense', 'snRNA', 'pseudogene', 'IG_gene'][p_partkey % 7 + 1] AS g,
 p_partkey % 20 + 1 AS r, ['gpos33', 'stalk', 'gpos66', 'n/a'][p_partkey % 4 + 1] AS st FROM part)""")
def genes_classes(t):
    k = F.col("p_partkey")

    def pick(names: list[str]):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))

    g = pick(["protein_coding_x", "noncoding RNA", "lincRNA", "antisense", "snRNA", "pseudogene", "IG_gene"])
    roman = S.roman_chrom((k % 20 + 1).cast("string"))
    shown = F.when(roman.isin("I", "II", "III", "XVI"), roman).otherwise("z")
    return t.raw("part").select("p_partkey", S.biotype_class(g).alias("cls"), shown.alias("roman"),
                                S.stain_class(pick(["gpos33", "stalk", "gpos66", "n/a"])).alias("stain"))


@query("genes_picked", "genes", """SELECT tid, gname FROM genes WHERE gname IN (SELECT 'G' || (o_custkey % 200) FROM orders)""")
def genes_picked(t):
    return G.pick_genes(t.genes, t.raw("orders").selectExpr("concat('G', o_custkey % 200) AS name")).select("tid", "gname")


@query("genes_names", "genes", "SELECT DISTINCT gname FROM genes")
def genes_names(t):
    return G.gene_names(t.genes)


@query("genes_overview", "genes", """SELECT count(*) AS n_genes, bool_or(tname LIKE '%ENS%') AS is_ensembl FROM genes""")
def genes_overview(t):
    n = G.count_genes(t.genes).first()["n_genes"]
    return G.is_ensembl(t.genes).select(F.lit(n).alias("n_genes"), "is_ensembl")


HITS = """+ g AS (SELECT *, greatest(tx_start - CASE WHEN strand = '+' THEN 5000 ELSE 2000 END, 0) AS gs,
 tx_end + CASE WHEN strand = '+' THEN 2000 ELSE 5000 END AS ge FROM genes),
hits AS (SELECT name, a.chrom, s, e, tid, CASE WHEN s <= tx_end AND tx_start <= e THEN 'GENIC'
 WHEN (strand = '+') = (e < tx_start) THEN 'UPSTREAM' ELSE 'DOWNSTREAM' END AS status
 FROM sites a JOIN g ON a.chrom = g.chrom AND s <= ge AND gs <= e)"""


@query("genes_hits", "sites genes", HITS + " SELECT name, tid, status FROM hits")
def genes_hits(t):
    return G.interval_gene_hits(t.sites, t.genes, 5000, 2000).select("name", "tid", "status")


@query("genes_annotation", "sites genes", HITS + """, best AS (SELECT name, count(*) AS n_hits, first(status ORDER BY CASE status WHEN 'UPSTREAM' THEN 5 WHEN 'DOWNSTREAM' THEN 4 ELSE 1 END DESC, tid DESC) AS status,
 first(tid ORDER BY CASE status WHEN 'UPSTREAM' THEN 5 WHEN 'DOWNSTREAM' THEN 4 ELSE 1 END DESC, tid DESC) AS tid FROM hits GROUP BY name)
SELECT name, coalesce(status, 'INTERGENIC') AS status, coalesce(tid, '') AS tid, coalesce(n_hits, 0) AS n_hits FROM sites LEFT JOIN best USING (name)""")
def genes_annotation(t):
    return G.annotate_intervals(t.sites, t.genes, 5000, 2000).select("name", "status", "tid", "n_hits")


@query("genes_nearest_tss", "sites genes", """+ p AS (SELECT DISTINCT chrom, CASE WHEN strand = '+' THEN tx_start ELSE tx_end END AS pos FROM genes),
m AS (SELECT name, chrom, (s + e) // 2 AS pos FROM sites),
l AS (SELECT name, m.pos - p.pos AS d FROM m ASOF JOIN p ON m.chrom = p.chrom AND m.pos >= p.pos),
r AS (SELECT name, p.pos - m.pos AS d FROM m ASOF JOIN p ON m.chrom = p.chrom AND m.pos <= p.pos)
SELECT name, min(d) AS tss_distance FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY name""")
def genes_nearest_tss(t):
    return G.nearest_tss(t.sites, t.genes, 1 << 16).select("name", "tss_distance")


@query("genes_density", "genes", """SELECT chrom, w * 100000 AS "start", count(*) AS n_genes FROM
 (SELECT chrom, unnest(range(tx_start // 100000, tx_end // 100000 + 1)) AS w FROM genes) GROUP BY ALL""")
def genes_density(t):
    return G.gene_density(t.genes, 100_000)


# ---- loops ---------------------------------------------------------------------

@query("loops_intra", "loops", "SELECT loop_id FROM loops WHERE c1 = 'chr4' AND c2 = 'chr4'")
def loops_intra(t):
    return L.intra_loops(t.interactions, "chr4").select("loop_id")


@query("loops_in_window", "loops", """SELECT loop_id, CASE WHEN h AND t THEN 'both' WHEN h THEN 'head' ELSE 'tail' END AS side FROM
 (SELECT loop_id, (s1 + e1) // 2 BETWEEN 200000 AND 350000 AS h, (s2 + e2) // 2 BETWEEN 200000 AND 350000 AS t FROM loops
 WHERE c1 = 'chr1' AND c2 = 'chr1') WHERE h OR t""")
def loops_in_window(t):
    return L.loops_in_window(t.interactions, "chr1", 200_000, 350_000).select("loop_id", "side")


@query("loops_intensity", "loops", "SELECT loop_id, round(val / (SELECT max(val) FROM loops) * 3, 6) AS intensity FROM loops")
def loops_intensity(t):
    return L.loop_intensity(t.interactions).select("loop_id", r6("intensity"))


FLAGS = """+ h1 AS (SELECT DISTINCT loop_id, side FROM anchors a JOIN bed2 b ON a.c = b.chrom AND a.s <= b.e AND b.s <= a.e),
h2 AS (SELECT DISTINCT loop_id, side FROM anchors a JOIN tssbed b ON a.c = b.chrom AND a.s <= b.e AND b.s <= a.e),
flags AS (SELECT loop_id, bool_or(h1.side = 1) AS a1, bool_or(h1.side = 2) AS b1, bool_or(h2.side = 1) AS a2, bool_or(h2.side = 2) AS b2
 FROM loops LEFT JOIN h1 USING (loop_id) LEFT JOIN h2 USING (loop_id) GROUP BY loop_id),
f AS (SELECT loop_id, coalesce(a1, false) AS a1, coalesce(b1, false) AS b1, coalesce(a2, false) AS a2, coalesce(b2, false) AS b2 FROM flags),
k AS (SELECT *, (a1 AND b2) OR (a2 AND b1) AS ab, a1 AND b1 AS aa, a2 AND b2 AS bb FROM f)""".replace("+ h1", """+ anchors AS (SELECT loop_id, 1 AS side, c1 AS c, s1 AS s, e1 AS e FROM loops
 UNION ALL SELECT loop_id, 2, c2, s2, e2 FROM loops),
tssbed AS (SELECT chrom, tx_start AS s, tx_start + 1000 AS e FROM genes),
h1""")


def tss_bed(t):
    return t.genes.select("chrom", F.col("tx_start").alias("start"), (F.col("tx_start") + 1000).alias("end"))


@query("loops_against_beds", "loops bed2 genes", FLAGS + """, n AS (SELECT 'bed1-bed2' AS kind, count(*) FILTER (WHERE ab) AS n FROM k
 UNION ALL SELECT 'bed1-bed1', count(*) FILTER (WHERE aa) FROM k UNION ALL SELECT 'bed2-bed2', count(*) FILTER (WHERE bb) FROM k
 UNION ALL SELECT 'bed1-none', count(*) FILTER (WHERE NOT (ab OR aa OR bb) AND (a1 OR b1)) FROM k
 UNION ALL SELECT 'bed2-none', count(*) FILTER (WHERE NOT (ab OR aa OR bb) AND NOT (a1 OR b1) AND (a2 OR b2)) FROM k
 UNION ALL SELECT 'none', count(*) FILTER (WHERE NOT (a1 OR b1 OR a2 OR b2)) FROM k)
SELECT kind, n, round(100.0::DOUBLE * n / (SELECT count(*) FROM k), 6) AS pct FROM n""")
def loops_against_beds(t):
    return L.compare_loops_with_beds(t.interactions, t.part_bed, tss_bed(t)).select("kind", "n", r6("pct"))


@query("loops_between_beds", "loops bed2 genes", FLAGS + " SELECT loop_id FROM k WHERE ab")
def loops_between_beds(t):
    return L.loops_between_beds(t.interactions, t.part_bed, tss_bed(t)).select("loop_id")


@query("loops_hit_beds", "loops bed2", """SELECT name FROM bed2 b WHERE EXISTS (SELECT 1 FROM loops WHERE c1 = b.chrom AND s1 <= b.e AND b.s <= e1)
 OR EXISTS (SELECT 1 FROM loops WHERE c2 = b.chrom AND s2 <= b.e AND b.s <= e2)""")
def loops_hit_beds(t):
    return L.beds_hit_by_loops(t.part_bed, t.interactions).select("name")


# ---- barcodes ------------------------------------------------------------------

MULTI = "+ multi AS (SELECT * FROM barcodes SEMI JOIN (SELECT barcode FROM barcodes GROUP BY barcode HAVING count(*) > 1) USING (barcode))"
SPLIT = MULTI + """,
st AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 100000 OR lag(pos) OVER w IS NULL THEN pos END AS o FROM multi
 WINDOW w AS (PARTITION BY chrom, barcode ORDER BY pos)),
frags AS (SELECT chrom, barcode, pos, max(o) OVER (PARTITION BY chrom, barcode ORDER BY pos) AS frag FROM st)"""


@query("barcodes_multi_hit", "barcodes", MULTI + " SELECT barcode, chrom, pos FROM multi")
def barcodes_multi_hit(t):
    return BC.multi_hit_barcodes(t.barcodes).select("barcode", "chrom", "pos")


@query("barcodes_positions", "barcodes", "SELECT chrom, barcode, pos, count(*) AS n FROM barcodes GROUP BY ALL")
def barcodes_positions(t):
    return BC.barcode_positions(t.barcodes)


@query("barcodes_fragments", "barcodes", SPLIT + """
SELECT chrom, barcode, frag, min(pos) AS first, max(pos) AS last, count(*) AS size FROM frags GROUP BY ALL""")
def barcodes_fragments(t):
    p = BC.split_by_gap(BC.barcode_positions(BC.multi_hit_barcodes(t.barcodes)), tile=1 << 18)
    return p.groupBy("chrom", "barcode", "frag").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("n").alias("size"))


WINDOW = SPLIT.replace("FROM multi\n", "FROM multi SEMI JOIN whole USING (chrom, barcode)\n").replace(
    ",\nst AS", """,
whole AS (SELECT chrom, barcode FROM multi WHERE chrom = 'click' GROUP BY ALL HAVING count(*) > 1 AND max(pos) >= 100000 AND min(pos) <= 900000
 AND NOT (min(pos) < 100000 AND max(pos) > 900000)),
st AS""") + """,
keep AS (SELECT chrom, barcode, frag, min(pos) AS f, max(pos) AS l, count(*) AS size FROM frags GROUP BY ALL
 HAVING count(*) > 1 AND max(pos) >= 100000 AND min(pos) <= 900000 AND NOT (min(pos) < 100000 AND max(pos) > 900000))"""


def _view(t):
    return BC.barcodes_in_window(BC.barcode_positions(BC.multi_hit_barcodes(t.barcodes)), "click", 100_000, 900_000)


@query("barcodes_in_window", "barcodes", WINDOW + " SELECT barcode, frag, pos FROM frags SEMI JOIN keep USING (chrom, barcode, frag)")
def barcodes_in_window(t):
    return _view(t).select("barcode", "frag", "pos")


@query("barcodes_collapsed", "barcodes", """+ shifted AS (SELECT CAST(user_id AS VARCHAR) || '-' || k AS barcode, pos FROM
 (SELECT user_id, event_id % 40 * 2000 AS pos, unnest([0, 1, 2]) AS k FROM events)),
m AS (SELECT barcode, list(pos ORDER BY pos) AS l FROM shifted GROUP BY barcode HAVING count(*) > 1)
SELECT l[1] AS first, l[-1] AS last, len(l) AS size, l[1] < 10000 AS before_view, count(*) AS n_same FROM m GROUP BY l""")
def barcodes_collapsed(t):
    k = F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("k")
    e = t.raw("events").select("user_id", "event_id", k).select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), "k").alias("barcode"), F.lit("chr1").alias("chrom"),
        (F.col("event_id") % 40 * 2000).cast("int").alias("pos"))
    frags = BC.split_by_gap(BC.barcode_positions(BC.multi_hit_barcodes(e)))
    return BC.collapse_identical(frags, 10_000).select("first", "last", "size", "before_view", "n_same")


# ---- GC ------------------------------------------------------------------------

W = 20
GCW = f"""+ base AS (SELECT chrom, len, i, substr(seq, i + 1, 1) AS b FROM (SELECT chrom, seq, length(seq) AS len, unnest(range(0, length(seq))) AS i FROM sequences)),
win AS (SELECT chrom, len, i AS pos, CASE WHEN coalesce(sum(CASE WHEN b = 'N' THEN 1 ELSE 0 END) OVER w, 0) > 0 THEN -1
 ELSE coalesce(sum(CASE WHEN b IN ('G', 'C') THEN 1 ELSE 0 END) OVER w, 0)::INT END AS gc FROM base
 WINDOW w AS (PARTITION BY chrom ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {W} FOLLOWING)),
lens AS (SELECT chrom, length(seq) AS len FROM sequences WHERE length(seq) > 0),
longest AS (SELECT chrom FROM lens ORDER BY len DESC, CAST(chrom AS BIGINT) LIMIT 1)"""
GREADS = """,
greads AS (SELECT chrom, len, k, (k * 7919 + CAST(chrom AS BIGINT) * 31) % len AS f3, CASE WHEN (k + CAST(chrom AS BIGINT)) % 2 = 0 THEN '+' ELSE '-' END AS strand
 FROM (SELECT chrom, len, unnest(range(0, len // 20)) AS k FROM lens)),
placed AS (SELECT *, CASE WHEN strand = '+' THEN least(f3 + 5, len - 1) ELSE greatest(f3 - 40 + 5, 0) END AS pos FROM greads)"""
HIST = f""",
gh AS (SELECT gc, count(*) AS ng FROM win SEMI JOIN longest USING (chrom) WHERE gc >= 0 AND pos >= {W + 5} AND pos < len - {W + 5} GROUP BY gc),
rh AS (SELECT gc, count(*) AS nr FROM placed SEMI JOIN longest USING (chrom) JOIN win USING (chrom, pos) WHERE gc >= 0 GROUP BY gc),
wt AS (SELECT gc, coalesce(ng, 0) AS ng, coalesce(nr, 0) AS nr, coalesce(ng, 0)::DOUBLE / (SELECT sum(ng) FROM gh)::DOUBLE AS gp,
 coalesce(nr, 0)::DOUBLE / (SELECT sum(nr) FROM rh)::DOUBLE AS rp FROM (SELECT unnest(range(0, {W + 1})) AS gc) LEFT JOIN gh USING (gc) LEFT JOIN rh USING (gc)),
weights AS (SELECT *, CASE WHEN nr = 0 OR gp < 1e-5 THEN 0 WHEN ng > 0 AND nr::DOUBLE / ng < 1e-3 THEN 1 WHEN ng = 0 THEN 1 ELSE gp / rp END AS weight FROM wt)"""


def gc_inputs(t):
    chunks = cut(GC.chunk_sequences(t.sequences, 4096))
    lengths = lookup(GC.genome_table(chunks))
    best = lengths.agg(F.max_by("chrom", F.struct(F.col("length"), (-F.col("chrom").cast("long")).alias("t")))).first()[0]
    k = F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / 20).cast("int") - 1))
    doc = F.col("chrom").cast("long")
    reads = lengths.filter("length >= 20").select("chrom", "length", k.alias("k")).select(
        "chrom", ((F.col("k") * 7919 + doc * 31) % F.col("length")).cast("int").alias("f3"),
        F.when((F.col("k") + doc) % 2 == 0, "+").otherwise("-").alias("strand"), "k", F.lit(1.0).alias("weight"))
    return chunks, lengths, reads, F.col("chrom") == best


def gc_weights(t):
    chunks, lengths, reads, longest = gc_inputs(t)
    g = GC.gc_genome_distribution(chunks.filter(longest), lengths, W, size=4096)
    r = GC.gc_read_distribution(reads.filter(longest), chunks.filter(longest), lengths, 40, W, size=4096)
    return chunks, lengths, reads, r, GC.gc_weight(g, r, W)


@query("gc_windows", "sequences", GCW + " SELECT chrom, gc, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM win GROUP BY ALL")
def gc_windows(t):
    w = GC.gc_windows(GC.chunk_sequences(t.sequences, 4096), W, 4096)
    return w.groupBy("chrom", "gc").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query("gc_genome_distribution", "sequences", GCW + f""" SELECT chrom, gc, count(*) AS n FROM win WHERE gc >= 0 AND pos >= {W + 5} AND pos < len - {W + 5} GROUP BY ALL""")
def gc_genome_distribution(t):
    chunks, lengths, _, _ = gc_inputs(t)
    return GC.gc_genome_distribution(chunks, lengths, W, size=4096).filter("n > 0")


@query("gc_read_distribution", "sequences", GCW + GREADS + " SELECT chrom, gc, count(*) AS n FROM placed JOIN win USING (chrom, pos) WHERE gc >= 0 GROUP BY ALL")
def gc_read_distribution(t):
    chunks, lengths, reads, _ = gc_inputs(t)
    return GC.gc_read_distribution(reads, chunks, lengths, 40, W, size=4096)


@query("gc_weights", "sequences", GCW + GREADS + HIST + """
SELECT gc, round(gp, 6) AS genome_prop, round(rp, 6) AS reads_prop, round(CASE WHEN ng > 0 THEN nr::DOUBLE / ng ELSE 0 END, 6) AS depth,
 round(weight, 6) AS weight FROM weights""")
def gc_weights_query(t):
    return gc_weights(t)[4].select("gc", r6("genome_prop"), r6("reads_prop"), r6("depth"), r6("weight"))


@query("gc_reweighted", "sequences", GCW + GREADS + HIST + """
SELECT p.chrom, strand, round(sum(coalesce(weight, 1)), 6) AS after_gc FROM placed p LEFT JOIN win USING (chrom, pos)
 LEFT JOIN weights USING (gc) GROUP BY ALL""")
def gc_reweighted(t):
    chunks, lengths, reads, _, weights = gc_weights(t)
    out = GC.gc_reweight(reads, chunks, lengths, weights, 40, W, size=4096)
    return out.groupBy("chrom", "strand").agg(r6(F.sum("weight"), "after_gc"))


SAMPLES = """,
splaced AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'input' ELSE 'chip' END AS smp FROM placed)"""
SHIST = f""",
srh AS (SELECT smp, gc, count(*) AS nr FROM splaced SEMI JOIN longest USING (chrom) JOIN win USING (chrom, pos) WHERE gc >= 0 GROUP BY smp, gc),
sgrid AS (SELECT smp, unnest(range(0, {W + 1})) AS gc FROM (SELECT DISTINCT smp FROM srh)),
swt AS (SELECT smp, gc, coalesce(ng, 0) AS ng, coalesce(nr, 0) AS nr, coalesce(ng, 0)::DOUBLE / (SELECT sum(ng) FROM gh)::DOUBLE AS gp,
 coalesce(nr, 0)::DOUBLE / (sum(nr) OVER (PARTITION BY smp))::DOUBLE AS rp FROM sgrid LEFT JOIN gh USING (gc) LEFT JOIN srh USING (smp, gc)),
sweights AS (SELECT *, CASE WHEN nr = 0 OR gp < 1e-5 THEN 0 WHEN ng > 0 AND nr::DOUBLE / ng < 1e-3 THEN 1 WHEN ng = 0 THEN 1 ELSE gp / rp END AS weight FROM swt)"""


def sampled(t):
    """As :func:`gc_weights` with the reads dealt to two samples."""
    chunks, lengths, reads, longest = gc_inputs(t)
    reads = reads.withColumn("sample", F.when(F.col("k") % 3 == 0, "input").otherwise("chip"))
    g = GC.gc_genome_distribution(chunks.filter(longest), lengths, W, size=4096)
    r = GC.gc_read_distribution(reads.filter(longest), chunks.filter(longest), lengths, 40, W, size=4096)
    return chunks, lengths, reads, r, GC.gc_weight(g, r, W)


@query("gc_weights_by_sample", "sequences", GCW + GREADS + HIST + SAMPLES + SHIST + """
SELECT smp, gc, round(gp, 6) AS genome_prop, round(rp, 6) AS reads_prop, round(CASE WHEN ng > 0 THEN nr::DOUBLE / ng ELSE 0 END, 6) AS depth,
 round(weight, 6) AS weight FROM sweights""")
def gc_weights_by_sample(t):
    return sampled(t)[4].select(F.col("sample").alias("smp"), "gc", r6("genome_prop"), r6("reads_prop"), r6("depth"), r6("weight"))


@query("gc_reweighted_by_sample", "sequences", GCW + GREADS + HIST + SAMPLES + SHIST + """
SELECT p.smp, p.chrom, strand, round(sum(coalesce(weight, 1)), 6) AS after_gc FROM splaced p LEFT JOIN win USING (chrom, pos)
 LEFT JOIN sweights w ON w.smp = p.smp AND w.gc = win.gc GROUP BY ALL""")
def gc_reweighted_by_sample(t):
    chunks, lengths, reads, _, weights = sampled(t)
    out = GC.gc_reweight(reads, chunks, lengths, weights, 40, W, size=4096)
    return out.groupBy(F.col("sample").alias("smp"), "chrom", "strand").agg(r6(F.sum("weight"), "after_gc"))


@query("gc_summit_by_sample", "sequences", GCW + GREADS + HIST + SAMPLES + SHIST + " SELECT smp, arg_max(gc, nr * 1000 - gc) AS gc, max(nr) AS n FROM srh GROUP BY smp")
def gc_summit_by_sample(t):
    return GC.gc_summit(sampled(t)[3]).selectExpr("sample AS smp", "gc", "n")


@query("gc_summit", "sequences", GCW + GREADS + HIST + " SELECT arg_max(gc, nr * 1000 - gc) AS gc, max(nr) AS n FROM rh")
def gc_summit(t):
    return GC.gc_summit(gc_weights(t)[3])


@query("gc_content", "sequences", """+ w AS (SELECT chrom, i * 500 AS "start", substr(seq, i * 500 + 1, 500) AS p FROM
 (SELECT chrom, seq, unnest(range(0, (length(seq) - 1) // 500 + 1)) AS i FROM sequences WHERE length(seq) > 0))
SELECT chrom, "start", round(CASE WHEN length(replace(p, 'N', '')) > 0 THEN 100.0::DOUBLE * (length(replace(p, 'N', '')) -
 length(translate(p, 'GCN', ''))) / length(replace(p, 'N', '')) ELSE 0 END, 6) AS value FROM w""")
def gc_content(t):
    return GC.gc_content_track(GC.chunk_sequences(t.sequences, 4096), 500, 4096).select("chrom", "start", r6("value"))


@query("gc_genome_table", "sequences", "SELECT chrom, length(seq) AS length FROM sequences WHERE length(seq) > 0")
def gc_genome_table(t):
    return GC.genome_table(GC.chunk_sequences(t.sequences, 4096))
