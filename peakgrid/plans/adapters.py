"""Driver tables as domain tables (integer arithmetic only).

The genome is chr1..chr5 with 1,000,000 bases each; ``SQL`` holds the same
adapters for the check queries.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads as R
from ..session import lookup

LENGTH = 1_000_000
BIN = 100
FLEN = 150


class Tables:
    """Adapters over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def genome(self) -> DataFrame:
        g = self.spark.range(1, 6).select(
            F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.lit(LENGTH).alias("length"),
            F.lit(None).cast("long").alias("mappable"), (F.col("id") - 1).cast("int").alias("ord"))
        return lookup(g)

    @property
    def reads(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "CASE WHEN l_returnflag = 'R' THEN 'input' ELSE 'chip' END AS sample",
            "(((l_orderkey * 1000000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber) * 100"
            " + CAST(l_quantity AS INT) AS read_id",
            "concat('chr', l_partkey % 5 + 1) AS chrom",
            "CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand",
            "CAST((l_partkey * 7919) % 998000 + 1000 + (l_orderkey * 31 + l_linenumber * 17) % 400 AS INT) AS f3",
            "1.0D AS weight", "CAST(l_linenumber % 3 + 1 AS INT) AS nh")

    @property
    def paired(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "CASE WHEN l_returnflag = 'R' THEN 'input' ELSE 'chip' END AS sample",
            "(((l_orderkey * 1000000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber) * 100"
            " + CAST(l_quantity AS INT) AS read_id",
            "concat('chr', l_partkey % 5 + 1) AS chrom",
            "CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand",
            "CAST((l_partkey * 7919) % 998000 + 1000 + (l_orderkey * 31 + l_linenumber * 17) % 400 AS INT) AS f3",
            "CASE WHEN l_suppkey % 10 = 0 THEN 'chr0' ELSE concat('chr', l_partkey % 5 + 1) END AS mate_chrom",
            "CAST((l_suppkey * 37 + l_linenumber * 53) % 700 + 40 AS INT) AS tlen",
            "CAST(36 + l_linenumber % 5 AS INT) AS len_f3", "CAST(36 + l_suppkey % 7 AS INT) AS len_f5",
            "1.0D AS weight").withColumn(
            "f5", F.when(F.col("strand") == "+", F.col("f3") + F.col("tlen")).otherwise(F.col("f3") - F.col("tlen")))

    @property
    def unique_frags(self) -> DataFrame:
        return R.fragments(R.extend(R.nonredundant(self.reads), FLEN), self.genome)

    @property
    def frags(self) -> DataFrame:
        return R.site_fragments(self.reads, self.genome, FLEN)

    @property
    def bins(self) -> DataFrame:
        return R.bin_reads(self.frags, BIN)

    @property
    def pairs(self) -> DataFrame:
        return lookup(self.spark.createDataFrame(
            [("S1", "chip", "input")], "label string, chip string, input string"))

    @property
    def sites(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "concat('chr', o_orderkey % 5 + 1) AS chrom", "CAST((o_orderkey * 613) % 990000 AS INT) AS start",
            "CAST((o_orderkey * 613) % 990000 + 200 + o_custkey % 800 AS INT) AS end",
            "CAST(o_orderkey AS STRING) AS name")

    @property
    def part_bed(self) -> DataFrame:
        """A second interval set, from part."""
        return self.raw("part").selectExpr(
            "concat('chr', p_partkey % 5 + 1) AS chrom", "CAST((p_partkey * 4243) % 990000 AS INT) AS start",
            "CAST((p_partkey * 4243) % 990000 + 100 + p_size * 20 AS INT) AS end",
            "CAST(p_partkey AS STRING) AS name")

    @property
    def genes(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "concat('chr', p_partkey % 5 + 1) AS chrom", "CAST(p_partkey AS STRING) AS tid", "p_brand AS gid",
            "concat('T', p_partkey) AS tname", "concat('G', p_partkey % 977) AS gname",
            "CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand",
            "CAST((p_partkey * 7919) % 980000 + 1000 AS INT) AS tx_start",
            "CAST((p_partkey * 7919) % 980000 + 1500 + p_size * 200 AS INT) AS tx_end",
            "p_type AS gtype", "CASE p_partkey % 3 WHEN 0 THEN 'CCDS' WHEN 1 THEN 'basic' ELSE '' END AS tag")

    @property
    def interactions(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS loop_id",
            "named_struct('chrom', concat('chr', o_orderkey % 5 + 1), 'start', CAST((o_orderkey * 613) % 990000 AS INT),"
            " 'end', CAST((o_orderkey * 613) % 990000 + 200 + o_custkey % 800 AS INT)) AS first",
            "named_struct('chrom', CASE WHEN o_orderkey % 10 = 0 THEN concat('chr', (o_orderkey + 1) % 5 + 1)"
            " ELSE concat('chr', o_orderkey % 5 + 1) END,"
            " 'start', CAST(((o_orderkey * 613) % 990000 + 5000 + (o_custkey * 97) % 200000) % 990000 AS INT),"
            " 'end', CAST(((o_orderkey * 613) % 990000 + 5000 + (o_custkey * 97) % 200000) % 990000 + 1000 AS INT)) AS second",
            "-log10((1 + o_orderkey % 1000) / 1e6D) AS val")

    @property
    def barcodes(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "CAST(user_id AS STRING) AS barcode", "event_type AS chrom",
            "CAST((event_id * 104729) % 1000000 AS INT) AS pos")

    @property
    def mappability(self) -> DataFrame:
        return self.raw("part").selectExpr("CAST(p_partkey % 10001 AS INT) AS bin", "p_size % 10 / 10.0D AS fraction",
                                           "p_partkey").groupBy("bin").agg(
            F.max_by("fraction", "p_partkey").alias("fraction")).select(
            F.explode(F.array(*[F.lit(f"chr{k}") for k in range(1, 6)])).alias("chrom"), "bin", "fraction")

    @property
    def mappable_segments(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "concat('chr', p_partkey % 5 + 1) AS chrom", "CAST((p_partkey * 6151) % 980000 AS INT) AS start",
            "CAST((p_partkey * 6151) % 980000 + 500 + p_size * 150 AS INT) AS end")

    @property
    def sequences(self) -> DataFrame:
        """One sequence per document: (chrom, seq) over A, C, G, T, N."""
        letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
        return self.raw("documents").select(
            F.col("doc_id").cast("string").alias("chrom"),
            F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTANCGTACGNACGTACNTN").alias("seq"))


_GENOME = "genome AS (SELECT 'chr' || i AS chrom, 1000000 AS length, i - 1 AS ord FROM range(1, 6) t(i))"
_READS = """reads AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'input' ELSE 'chip' END AS smp,
 (((l_orderkey * 1000000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS INT) AS read_id,
 'chr' || (l_partkey % 5 + 1) AS chrom, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
 (l_partkey * 7919) % 998000 + 1000 + (l_orderkey * 31 + l_linenumber * 17) % 400 AS f3,
 l_linenumber % 3 + 1 AS nh FROM lineitem)"""
_PAIRED = """paired0 AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'input' ELSE 'chip' END AS smp,
 (((l_orderkey * 1000000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS INT) AS read_id,
 'chr' || (l_partkey % 5 + 1) AS chrom, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
 (l_partkey * 7919) % 998000 + 1000 + (l_orderkey * 31 + l_linenumber * 17) % 400 AS f3,
 CASE WHEN l_suppkey % 10 = 0 THEN 'chr0' ELSE 'chr' || (l_partkey % 5 + 1) END AS mate_chrom,
 (l_suppkey * 37 + l_linenumber * 53) % 700 + 40 AS tlen,
 36 + l_linenumber % 5 AS len_f3, 36 + l_suppkey % 7 AS len_f5 FROM lineitem),
paired AS (SELECT *, CASE WHEN strand = '+' THEN f3 + tlen ELSE f3 - tlen END AS f5 FROM paired0)"""
_NONRED = "nonred AS (SELECT * FROM reads QUALIFY row_number() OVER (PARTITION BY smp, chrom, strand, f3 ORDER BY read_id) <= 1)"
_FRAGS = """frags AS (SELECT *, greatest(least(f3, f5), 0) AS s, least(greatest(f3, f5), 999999) AS e
 FROM (SELECT *, CASE WHEN strand = '+' THEN f3 + 150 ELSE f3 - 150 END AS f5 FROM nonred))"""
_BINS = """bins AS (SELECT smp, chrom, bin, count(*) * 10000 AS v FROM
 (SELECT smp, chrom, unnest(range(s // 100, e // 100 + 1)) AS bin FROM frags) GROUP BY ALL)"""
_DENSE = """dense AS (SELECT g.smp, g.chrom, g.bin, coalesce(b.v, 0) AS v FROM
 (SELECT smp, chrom, unnest(range(0, 10001)) AS bin FROM (VALUES ('chip'), ('input')) t(smp), genome) g
 LEFT JOIN bins b USING (smp, chrom, bin))"""
_SITES = """sites AS (SELECT 'chr' || (o_orderkey % 5 + 1) AS chrom, (o_orderkey * 613) % 990000 AS s,
 (o_orderkey * 613) % 990000 + 200 + o_custkey % 800 AS e, CAST(o_orderkey AS VARCHAR) AS name FROM orders)"""
_BED2 = """bed2 AS (SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, (p_partkey * 4243) % 990000 AS s,
 (p_partkey * 4243) % 990000 + 100 + p_size * 20 AS e, CAST(p_partkey AS VARCHAR) AS name FROM part)"""
_GENES = """genes AS (SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, CAST(p_partkey AS VARCHAR) AS tid, p_brand AS gid,
 'T' || p_partkey AS tname, 'G' || (p_partkey % 977) AS gname, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
 (p_partkey * 7919) % 980000 + 1000 AS tx_start, (p_partkey * 7919) % 980000 + 1500 + p_size * 200 AS tx_end,
 p_type AS gtype, CASE p_partkey % 3 WHEN 0 THEN 'CCDS' WHEN 1 THEN 'basic' ELSE '' END AS tag FROM part)"""
_LOOPS = """loops AS (SELECT o_orderkey AS loop_id, 'chr' || (o_orderkey % 5 + 1) AS c1, (o_orderkey * 613) % 990000 AS s1,
 (o_orderkey * 613) % 990000 + 200 + o_custkey % 800 AS e1,
 CASE WHEN o_orderkey % 10 = 0 THEN 'chr' || ((o_orderkey + 1) % 5 + 1) ELSE 'chr' || (o_orderkey % 5 + 1) END AS c2,
 ((o_orderkey * 613) % 990000 + 5000 + (o_custkey * 97) % 200000) % 990000 AS s2,
 ((o_orderkey * 613) % 990000 + 5000 + (o_custkey * 97) % 200000) % 990000 + 1000 AS e2,
 -log10((1 + o_orderkey % 1000)::DOUBLE / 1e6) AS val FROM orders)"""
_BARCODES = """barcodes AS (SELECT CAST(user_id AS VARCHAR) AS barcode, event_type AS chrom,
 (event_id * 104729) % 1000000 AS pos FROM events)"""
_MAPPABILITY = """mappability AS (SELECT 'chr' || i AS chrom, bin, fraction FROM
 (SELECT p_partkey % 10001 AS bin, arg_max(p_size % 10 / 10::DOUBLE, p_partkey) AS fraction FROM part GROUP BY 1), range(1, 6) t(i))"""
_MAPSEG = """mapseg AS (SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, (p_partkey * 6151) % 980000 AS s,
 (p_partkey * 6151) % 980000 + 500 + p_size * 150 AS e FROM part)"""
_SEQUENCES = """sequences AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'),
 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTANCGTACGNACGTACNTN') AS seq FROM documents)"""

SQL = {
    "genome": (_GENOME, []), "reads": (_READS, []), "paired": (_PAIRED, []), "nonred": (_NONRED, ["reads"]),
    "frags": (_FRAGS, ["nonred"]), "bins": (_BINS, ["frags"]), "dense": (_DENSE, ["genome", "bins"]),
    "sites": (_SITES, []), "bed2": (_BED2, []), "genes": (_GENES, []), "loops": (_LOOPS, []),
    "barcodes": (_BARCODES, []), "mappability": (_MAPPABILITY, []), "mapseg": (_MAPSEG, []),
    "sequences": (_SEQUENCES, []),
}


def with_tables(names: str, body: str) -> str:
    """``WITH`` clause for the named adapters (and what they need) before ``body``."""
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        for d in SQL[n][1]:
            add(d)
        done.append(n)

    for n in names.split():
        add(n)
    tail = body.strip()
    sep = ",\n" if tail.startswith("+") else "\n"
    return "WITH " + ",\n".join(SQL[n][0] for n in done) + sep + tail.lstrip("+")
