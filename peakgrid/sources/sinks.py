"""Writers. Ordered text goes out range partitioned: the part files, in order, are the file."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import TILE_BINS, div
from ..operators.reads import GENOME_ROW
from ..session import lookup


def _number(v: Column, is_float: bool) -> Column:
    return F.format_string("%.3f" if is_float else "%.0f", v / 10000.0)


def write_wig(bins: DataFrame, genome: DataFrame, path: str, binsize: int, is_float: bool = False, zeros: bool = False,
              gzip: bool = False, tile: int = TILE_BINS) -> None:
    """variableStep wig per sample. Every tile has its own header, so tiles are written in parallel.

    ``zeros`` keeps zero rows; the signal must then be dense.
    """
    data = bins if zeros else bins.filter(F.col("v") != 0)
    rows = data.join(lookup(genome).select("chrom", "ord"), "chrom").withColumn("tile", div("bin", tile))
    header = rows.select("sample", "ord", "tile", "chrom").distinct().select(
        "sample", "ord", "tile", F.lit(-1).alias("bin"),
        F.concat(F.lit("variableStep\tchrom="), "chrom", F.lit(f"\tspan={binsize}")).alias("value"))
    body = rows.select("sample", "ord", "tile", "bin", F.concat_ws(
        "\t", (F.col("bin") * binsize + 1).cast("string"), _number(F.col("v"), is_float)).alias("value"))
    # whole tiles meet in one part, so a header stays with its rows
    out = (header.unionByName(body).repartitionByRange("sample", "ord", "tile")
           .sortWithinPartitions("sample", "ord", "tile", "bin"))
    writer = out.select("sample", "value").write.mode("overwrite").partitionBy("sample")
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def write_bedgraph(bins: DataFrame, genome: DataFrame, path: str, binsize: int, is_float: bool = False,
                   zeros: bool = False, gzip: bool = False) -> None:
    """bedGraph per sample by chromosome and start; the last bin ends at length - 1."""
    data = bins if zeros else bins.filter(F.col("v") != 0)
    rows = data.join(lookup(genome).select("chrom", "length"), "chrom")
    start = F.col("bin") * binsize
    end = F.when(F.col("bin") == div("length", binsize), F.col("length") - 1).otherwise(start + binsize)
    out = rows.select("sample", "chrom", start.alias("start"), end.alias("end"), _number(F.col("v"), is_float).alias("v"))
    out = out.repartitionByRange("sample", "chrom", "start").sortWithinPartitions("sample", "chrom", "start")
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "v")
    writer = out.select("sample", line.alias("value")).write.mode("overwrite").partitionBy("sample")
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def write_bins(bins: DataFrame, path: str, tile: int = TILE_BINS * 16) -> None:
    """Parquet by sample and chromosome, sorted by bin inside a file; stands in for the indexed binary form."""
    (bins.withColumn("_t", div("bin", tile)).repartitionByRange("sample", "chrom", "_t")
     .sortWithinPartitions("sample", "chrom", "bin").drop("_t")
     .write.mode("overwrite").partitionBy("sample", "chrom").parquet(path))


def _tsv(df: DataFrame, path: str, header: bool = True, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", header).option("emptyValue", "").option("nullValue", "")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_peaks(peaks: DataFrame, path: str) -> None:
    """Peak table of 11 columns under ``path/tsv`` and its first three under ``path/bed``, per sample."""
    ordered = peaks.repartitionByRange("sample", "peak_no").sortWithinPartitions("sample", "peak_no")

    def two(c: str) -> Column:
        return F.format_string("%.2f", F.col(c))

    chrom = F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(F.concat(F.lit("chr"), "chrom"))
    _tsv(ordered.select("sample", chrom.alias("chromosome"), "start", "end", "length", "summit",
                        two("pileup").alias("pileup (ChIP)"), two("pileup_input").alias("pileup (Input)"),
                        two("enrichment").alias("Enrichment"), two("p_internal").alias("-log10(p_internal)"),
                        two("p_enrich").alias("-log10(p_enrichment)"),
                        F.concat(F.lit("peak "), F.col("peak_no").cast("string")).alias("name")), f"{path}/tsv", by=["sample"])
    _tsv(ordered.select("sample", chrom.alias("chromosome"), "start", "end"), f"{path}/bed", header=False, by=["sample"])


def write_stats(stats: DataFrame, genome: DataFrame, path: str, threshold: int = 1, after_gc: bool = False) -> None:
    """Quality table per sample: banner, two heading rows, the genome row, then the chromosomes in order.

    A sample has one row per chromosome; all rows of a sample go to one file.
    """
    samples = stats.select("sample").distinct()
    order = F.when(F.col("chrom") == GENOME_ROW, -1).otherwise(F.col("ord"))
    rows = stats.join(genome.select("chrom", "ord"), "chrom", "left").withColumn("_o", order)

    def num(c: str, fmt: str = "%s") -> Column:
        if c not in stats.columns:
            return F.lit("N/A")
        return F.coalesce(F.format_string(fmt, F.col(c)), F.lit("N/A"))

    def share(c: str, p: str) -> Column:
        return F.format_string("%d (%.1f%%)", F.col(c).cast("long"), F.col(p))

    kinds = ["nonred", "red"] + (["after_gc"] if after_gc else [])
    groups = [share(("n_" if k != "after_gc" else "") + k + s, f"pct_{k}{s}") for k in kinds for s in ("", "_fwd", "_rev")]
    value = F.concat_ws("\t", "chrom", num("length", "%d"), num("mappable", "%d"), num("pct_mappable", "%.4f"),
                        num("n", "%d"), num("n_fwd", "%d"), num("n_rev", "%d"), num("pct_genome", "%.1f%%"), *groups,
                        num("depth", "%.3f"), num("w", "%.3f"), num("normalised", "%d"), num("coverage", "%.3f"),
                        num("n_inbed", "%d"), num("frip", "%.4f"))
    body = rows.select("sample", F.col("_o").alias("o"), value.alias("value"))
    gc_top, gc_low = ("reads (GCnormed)\t\t\t", "both\tforward\treverse\t") if after_gc else ("", "")
    head = [f"Redundancy threshold: >{threshold}",
            "\tlength\tmappable base\tmappability\ttotal reads\t\t\t\tnonredundant reads\t\t\tredundant reads\t\t\t" + gc_top
            + "read depth\tscaling weight\tnormalized read number\tgenome coverage\treads in peaks\tFRiP",
            "\t\t\t\tboth\tforward\treverse\t% genome\tboth\tforward\treverse\tboth\tforward\treverse\t" + gc_low]
    top = samples.select("sample", F.explode(F.array(*[F.struct(F.lit(i - 10).alias("o"), F.lit(h).alias("value"))
                                                       for i, h in enumerate(head)])).alias("h")).select("sample", "h.*")
    (top.unionByName(body).repartition("sample").sortWithinPartitions("sample", "o")
     .select("sample", "value").write.mode("overwrite").partitionBy("sample").text(path))


def write_light_stats(stats: DataFrame, genome: DataFrame, path: str) -> None:
    """Totals and depth of signals without read statistics, per sample."""
    order = F.when(F.col("chrom") == GENOME_ROW, -1).otherwise(F.col("ord"))
    body = (stats.join(genome.select("chrom", "ord"), "chrom", "left")
            .select("sample", order.alias("o"), F.concat_ws("\t", "chrom", F.col("total").cast("string"),
                                                            F.col("depth").cast("string")).alias("value")))
    top = stats.select("sample").distinct().select("sample", F.lit(-2).alias("o"), F.lit("\ttotal reads\tread depth").alias("value"))
    (top.unionByName(body).repartition("sample").sortWithinPartitions("sample", "o")
     .select("sample", "value").write.mode("overwrite").partitionBy("sample").text(path))


def write_bin_distribution(dist: DataFrame, genome: DataFrame, path: str, values: int = 200) -> None:
    """Value 0..199 by genome and chromosomes: number and share of bins, per sample.

    Rows are built from a map of one sample and value, so the chromosome list is the header only.
    """
    chroms = [GENOME_ROW] + [r[0] for r in genome.select("chrom", "ord").orderBy("ord").collect()]
    grid = dist.select("sample").distinct().withColumn("value", F.explode(F.sequence(F.lit(0), F.lit(values - 1))))
    cells = dist.groupBy("sample", "value").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("chrom").alias("k"), F.struct(F.col("n_bins").alias("n"), F.col("prop").alias("p")).alias("v")))).alias("m"))
    rows = grid.join(cells, ["sample", "value"], "left")
    cols = []
    for c in chroms:
        cell = F.try_element_at("m", F.lit(c))
        cols += [F.coalesce(cell["n"], F.lit(0).cast("long")).alias(f"{c} bins"), F.coalesce(cell["p"], F.lit(0.0)).alias(f"{c} prop")]
    out = rows.select("sample", F.col("value").alias("read number"), *cols)
    _tsv(out.repartition("sample").sortWithinPartitions("sample", "read number"), path, by=["sample"])


def write_gc_distribution(weights: DataFrame, path: str) -> None:
    """GC, genome share, reads share, depth, weight."""
    out = weights.select(F.col("gc").alias("GC"), F.col("genome_prop").alias("genome prop"),
                         F.col("reads_prop").alias("reads prop"), "depth", "weight")
    _tsv(out.coalesce(1).sortWithinPartitions("GC"), path)


def write_profile_matrix(wide: DataFrame, path: str, binsize: int = 1) -> None:
    """Site x offset matrix per label; the header holds the offsets in base pairs."""
    out = wide.select("label", "site", *[F.col(f"`{c}`").alias(str(int(c) * binsize)) for c in wide.columns
                                         if c not in ("label", "site")])
    _tsv(out.repartitionByRange("label", "site").sortWithinPartitions("label", "site"), path, by=["label"])


def write_site_matrix(matrix: DataFrame, path: str, add_name: bool = False) -> None:
    """chromosome, start, end, [name], one column per label."""
    labels = [c for c in matrix.columns if c not in ("chrom", "start", "end", "name")]
    out = matrix.select(F.col("chrom").alias("chromosome"), "start", "end", *(["name"] if add_name else []), *labels)
    _tsv(out.repartitionByRange("chromosome", "start").sortWithinPartitions("chromosome", "start", "end"), path)
