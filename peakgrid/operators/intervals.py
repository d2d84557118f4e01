"""Interval algebra on closed intervals ``(keys..., start, end)``."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tiles import TILE_BP, cut_to_tiles, div, stitch
from ..session import cut

BUCKET_BP = 1024
COVER_FAN = 8
#: Bins of its home level that an interval of the overlap join is cut into at most (one more where it lies across a border).
SPLIT = 4
#: Left rows of the overlap join that travel and meet as one; they start within a quarter of a bin.
BLOCK_ROWS, BLOCK_STARTS = 512, 4


def tiled_union(df: DataFrame, keys: Sequence[str] = ("chrom",), tile: int = TILE_BP) -> DataFrame:
    """Disjoint cover of the intervals, cut at tile borders: (keys, tile, start, end).

    The first aggregation keeps one row per start position, so a pile-up of
    equal fragments is folded map-side and a tile never has more than ``tile`` rows.
    """
    keys = list(keys)
    pieces = (cut_to_tiles(df.select(*keys, "start", "end"), tile)
              .groupBy(*keys, "tile", "start").agg(F.max("end").alias("end")))
    w = Window.partitionBy(*keys, "tile").orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = (pieces.withColumn("_new", F.coalesce((F.col("start") > reach + 1).cast("int"), F.lit(1)))
            .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return (runs.groupBy(*keys, "tile", "_run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run"))


def merge_intervals(df: DataFrame, keys: Sequence[str] = ("chrom",), tile: int = TILE_BP) -> DataFrame:
    """Union of intervals: overlapping and touching ones become one."""
    return stitch(tiled_union(df, keys, tile).drop("tile"), keys, tile, [])


def overlay(layers: Mapping[str, DataFrame], keys: Sequence[str] = ("chrom",),
            tile: int = TILE_BP) -> DataFrame:
    """Boundary sweep: segments with the depth of every layer at each base.

    Returns (keys, tile, start, end, <layer>...) for the bases under at least one
    layer, cut at tile borders. Events are summed per position before the sweep.
    """
    keys = list(keys)
    names = list(layers)

    def events(name: str, df: DataFrame) -> DataFrame:
        pieces = cut_to_tiles(df.select(*keys, "start", "end"), tile)
        step = F.explode(F.array(
            F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")),
            F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d"))))
        e = pieces.select(*keys, "tile", step.alias("e"))
        return e.select(*keys, "tile", F.col("e.pos").alias("pos"),
                        *[(F.col("e.d") if n == name else F.lit(0)).alias(n) for n in names])

    all_events = reduce(DataFrame.unionByName, [events(n, d) for n, d in layers.items()])
    marks = all_events.groupBy(*keys, "tile", "pos").agg(*[F.sum(n).alias(n) for n in names])
    w = Window.partitionBy(*keys, "tile").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    segs = marks.select(*keys, "tile", F.col("pos").alias("start"),
                        (F.lead("pos").over(w) - 1).alias("end"),
                        *[F.sum(n).over(run).alias(n) for n in names])
    alive = reduce(Column.__or__, [F.col(n) > 0 for n in names])
    return segs.filter(F.col("end").isNotNull() & alive)


def combine(a: DataFrame, b: DataFrame, how: str, keys: Sequence[str] = ("chrom",),
            tile: int = TILE_BP) -> DataFrame:
    """Bases of ``a`` minus / and ``b`` as disjoint intervals (how = subtract | intersect)."""
    segs = overlay({"in_a": a, "in_b": b}, keys, tile)
    keep = (F.col("in_a") > 0) & ((F.col("in_b") == 0) if how == "subtract" else (F.col("in_b") > 0))
    return merge_intervals(segs.filter(keep), keys, tile)


def _widths(bucket: int, fan: int) -> list[int]:
    """Bin widths of the nested levels; the last covers every 32-bit position."""
    out = [bucket]
    while out[-1] < 1 << 31:
        out.append(out[-1] * fan)
    return out


def _by_level(length: Column, widths: list[int], value: Callable[[int, int], Column]) -> Column:
    """``value(level, width)`` of the lowest level whose bins are as wide as ``length``."""
    out = F.when(length <= widths[0], value(0, widths[0]))
    for k, w in enumerate(widths[1:-1], 1):
        out = out.when(length <= w, value(k, w))
    return out.otherwise(value(len(widths) - 1, widths[-1]))


def overlap_join(left: DataFrame, right: DataFrame, bucket: int = BUCKET_BP, how: str = "inner",
                 on: Sequence[str] = ("chrom",), left_span: tuple[str, str] = ("start", "end"),
                 right_span: tuple[str, str] = ("start", "end"), fan: int = 4) -> DataFrame:
    """Pairs of overlapping intervals.

    Bins are nested: each level's are ``fan`` times as wide as those of the level below. An interval is at home on the lowest level whose bins are as
    wide as a quarter of it, and visits those levels above that the other side has; it lies in at most five bins of each, however long it is, so that
    few of the pairs that meet in a bin do not overlap. A pair meets at the higher of its two levels only: a key names the side that is at home, so visitors
    of a wide bin do not meet each other, and a home without visitors has no rows. Left rows that start close together
    meet the right side as one block, in the first bin they share with a row, and are held against it one by one only there; so a pair costs no step of a join, and rows
    come out block by block. Columns must differ in name between the sides, ``on`` aside. The pairs are as many as the overlaps; nothing else grows with them.
    """
    if how != "inner":
        raise ValueError("use overlaps_any for semi joins")
    on, (ls, le), (rs, re_) = list(on), left_span, right_span
    inside, beside = [c for c in left.columns if c not in on], [c for c in right.columns if c not in on]
    met = (_meetings(left, right, bucket, on, left_span, right_span, fan, _blocks(left, bucket, on, left_span, fan))
           .filter((F.col("_s") <= F.col(re_)) & (F.col(rs) <= F.col("_e")) & (F.greatest("_lb", "_rb") == F.col("_b"))))
    return met.select(*on, *beside, F.inline("_rows")).filter((F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le))).select(*on, *inside, *beside)


def _blocks(left: DataFrame, bucket: int, on: list[str], span: tuple[str, str], fan: int) -> DataFrame:
    """Rows of one level that start close together, at most BLOCK_ROWS of them: (on, _own, _s, _e, _rows), the span over all of them and the rows without ``on``."""
    own = left.withColumn("_own", _level(span, _widths(bucket, fan))).filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*on, *span)]))
    near = own.withColumn("_near", F.floor(F.col(span[0]) * F.lit(BLOCK_STARTS) / (F.lit(bucket) * F.pow(F.lit(float(fan)), "_own"))))
    rank = F.row_number().over(Window.partitionBy(*on, "_own", "_near").orderBy(span[0]))
    return (near.withColumn("_part", F.floor((rank - 1) / BLOCK_ROWS)).groupBy(*on, "_own", "_near", "_part")
            .agg(F.min(span[0]).alias("_s"), F.max(span[1]).alias("_e"), F.collect_list(F.struct(*[c for c in left.columns if c not in on])).alias("_rows")).drop("_near", "_part"))


def _level(span: tuple[str, str], widths: list[int]) -> Column:
    """Home level of an interval in the overlap join."""
    return _by_level(F.ceil((F.col(span[1]) - F.col(span[0]) + 1) / SPLIT), widths, lambda k, _: F.lit(k))


def _meetings(left: DataFrame, right: DataFrame, bucket: int = BUCKET_BP, on: Sequence[str] = ("chrom",), left_span: tuple[str, str] = ("start", "end"),
              right_span: tuple[str, str] = ("start", "end"), fan: int = 4, blocks: DataFrame | None = None) -> DataFrame:
    """Pairs of :func:`overlap_join` that share a bin, once for each bin; of ``blocks`` of left rows, if given, and right rows."""
    on, widths = list(on), _widths(bucket, fan)

    def placed(df: DataFrame, span: tuple[str, str], first: str, left_side: bool, other: DataFrame, other_span: tuple[str, str]) -> DataFrame:
        """Key 2k names the right side at home on level k, 2k + 1 the left side. A right row at home meets left rows at home too."""
        there = other.agg(F.collect_set(_level(other_span, widths))).scalar()  # at most one entry a level
        df = (df if "_own" in df.columns else df.withColumn("_own", _level(span, widths))).withColumn("_there", there)
        side = 1 - left_side  # of those that are visited: right rows visit left homes
        visited = F.exists("_there", lambda x: x <= F.col("_own") if left_side else x < F.col("_own"))
        home = F.when(visited, F.array(2 * F.col("_own") + (1 - side))).otherwise(F.array().cast("array<int>"))
        visits = F.transform(F.filter("_there", lambda x: x > F.col("_own") if left_side else x >= F.col("_own")), lambda x: 2 * x + side)
        df = df.withColumn("_key", F.explode(F.concat(home, visits))).drop("_own", "_there")
        width = F.lit(bucket).cast("long") * F.pow(F.lit(float(fan)), F.shiftright("_key", 1)).cast("long")
        df = df.withColumn(first, F.floor(F.col(span[0]) / width).cast("int")).withColumn("_last", F.floor(F.col(span[1]) / width).cast("int"))
        return df.withColumn("_b", F.explode(F.sequence(first, "_last"))).drop("_last")

    l = placed(left, left_span, "_lb", True, right, right_span) if blocks is None else placed(blocks, ("_s", "_e"), "_lb", True, right, right_span)
    return l.join(placed(right, right_span, "_rb", False, left, left_span), [*on, "_key", "_b"])


def overlaps_any(left: DataFrame, right: DataFrame, max_span: int | None = None,
                 on: Sequence[str] = ("chrom",), bucket: int = 4096, anti: bool = False,
                 span: tuple[str, str] = ("start", "end"), fan: int = 16) -> DataFrame:
    """Rows of ``left`` that overlap any interval of ``right`` (semi or anti join), each once.

    A left row has one key: the bin of its start at the lowest level of nested bins that are as wide as itself. The right intervals are merged, so they are
    disjoint, and offered at every level to the bins whose rows could reach them; their number is bounded by the genome over ``bucket``
    plus a few for each interval and level. ``max_span``, the usual bound of ``end - start``, widens the lowest bins to it; longer rows are found as well.
    """
    on = list(on)
    s, e = span
    widths = _widths(max(bucket, (max_span or 0) + 1), fan)
    merged = merge_intervals(right, on).withColumnRenamed("start", "_s").withColumnRenamed("end", "_e")
    reach = F.concat(*[F.transform(F.sequence(F.floor(F.greatest(F.col("_s") - (w - 1), F.lit(0)) / w).cast("int"), F.floor(F.col("_e") / w).cast("int")), _at_level(k))
                       for k, w in enumerate(widths)])
    offer = merged.select("*", F.inline(reach))
    length = F.col(e) - F.col(s) + 1
    l = (left.withColumn("_l", _by_level(length, widths, lambda k, _: F.lit(k)))
         .withColumn("_b", _by_level(length, widths, lambda _, w: F.floor(F.col(s) / w).cast("int"))))
    cond = [l[k] == offer[k] for k in on] + [l["_l"] == offer["_level"], l["_b"] == offer["_bin"], l[s] <= offer["_e"], offer["_s"] <= l[e]]
    return l.join(offer, cond, "left_anti" if anti else "left_semi").drop("_b", "_l")


def _at_level(k: int, name: str = "_bin"):
    return lambda x: F.struct(F.lit(k).alias("_level"), x.alias(name))


def _cover(low: Column, high: Column, fan: int) -> Column:
    """``array<struct<_level, _block>>``: the aligned blocks of 1, ``fan``, ``fan``^2 ... positions that make up [low, high]; fewer than 2 * ``fan`` of a level."""
    levels, none = len(_widths(1, fan)), F.array().cast("array<bigint>")

    def inside(k: int) -> tuple[Column, Column]:
        width = F.lit(float(fan ** k))
        return F.ceil(low / width).cast("long"), F.floor((high + 1) / width).cast("long")

    out = []
    for k in range(levels):
        a, b = inside(k)
        above, beyond = inside(k + 1)  # whole blocks of the next level are not divided
        some = above < beyond if k < levels - 1 else F.lit(False)
        until, after = F.when(some, above * fan).otherwise(b), beyond * fan
        out += [F.transform(F.when(c, F.sequence(x, y - 1)).otherwise(none), _at_level(k, "_block"))
                for c, x, y in ((a < until, a, until), (some & (after < b), after, b))]
    return F.concat(*out)


def stab_max(spans: DataFrame, points: DataFrame, value: str, keys: Sequence[str] = ("chrom",), fan: int = COVER_FAN) -> DataFrame:
    """Largest ``value`` of the intervals over each distinct point (keys, pos) -> (keys, pos, value); points under none are left out.

    ``spans``: (keys, start, end, value), a number. An interval is kept as the aligned blocks it is made of, of which only the
    largest value stays, and a point looks into one block a level; so pairs of points and intervals are never made.
    """
    keys = list(keys)
    blocks = cut(spans.select(*keys, value, F.inline(_cover(F.col("start"), F.col("end"), fan)))
                 .groupBy(*keys, "_level", "_block").agg(F.max(value).alias(value)))
    rest = [k for k in keys if k != "chrom"]
    there = blocks.groupBy(*rest).agg(F.collect_set("_level").alias("_there"))  # one row a kind of interval, at most one entry a level
    asked = points.select(*keys, "pos").distinct()
    asked = (asked.join(F.broadcast(there), rest) if rest else asked.crossJoin(there)).select(*keys, "pos", F.explode("_there").alias("_level"))
    asked = asked.withColumn("_block", F.floor(F.col("pos") / F.pow(F.lit(float(fan)), "_level")).cast("long"))
    return asked.join(blocks, [*keys, "_level", "_block"]).groupBy(*keys, "pos").agg(F.max(value).alias(value))


def count_up_to(positions: DataFrame, points: DataFrame, keys: Sequence[str] = ("chrom",), tile: int = TILE_BP) -> DataFrame:
    """Number of ``positions`` (keys, pos) at or before each distinct point (keys, pos) -> (keys, pos, n).

    Running sums inside tiles, of one row a position; what lies in earlier tiles is carried through the table of tile sums.
    """
    keys = list(keys)
    stored = positions.filter("pos IS NOT NULL").groupBy(*keys, "pos").agg(F.count("*").alias("n")).withColumn("_asked", F.lit(False))
    asked = points.select(*keys, "pos").distinct().select(*keys, "pos", F.lit(0).cast("long").alias("n"), F.lit(True).alias("_asked"))
    rows = stored.unionByName(asked).withColumn("_tile", F.floor(F.col("pos") / tile))
    w = Window.partitionBy(*keys, "_tile").orderBy("pos", "_asked")  # what lies on a point counts
    sums = cut(rows.select(*keys, "_tile", "pos", "_asked", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
                           F.lead("pos").over(w).isNull().alias("_last")).filter("_asked OR _last"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.filter("_last").select(*keys, "_tile", before.alias("_before"))  # one row a tile
    return sums.filter("_asked").join(carried, [*keys, "_tile"]).select(*keys, "pos", (F.col("n") + F.coalesce("_before", F.lit(0))).alias("n"))


def restrict_to_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Clip intervals to user regions; what lies outside is dropped."""
    if regions.limit(1).count() == 0:
        raise ValueError("no region given")
    r = merge_intervals(regions).withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end")
    hit = overlap_join(df, r, right_span=("r_start", "r_end"))
    return (hit.withColumn("start", F.greatest("start", "r_start"))
            .withColumn("end", F.least("end", "r_end")).drop("r_start", "r_end"))


def restrict_bins(bins: DataFrame, regions: DataFrame, binsize: int) -> DataFrame:
    """Bins that overlap the user regions."""
    r = merge_intervals(regions)
    cover = (r.withColumn("bin", F.explode(F.sequence(div("start", binsize), div("end", binsize))))
             .select("chrom", "bin").distinct())
    return bins.join(cover, ["chrom", "bin"], "left_semi")


def status_segments(genome: DataFrame, mappable: DataFrame | None = None,
                    bed: DataFrame | None = None) -> DataFrame:
    """Disjoint segments with status UNMAPPABLE, MAPPABLE or INBED (peaks win)."""
    whole = genome.select("chrom", F.lit(0).alias("start"), (F.col("length") - 1).alias("end"))
    layers = {"in_genome": whole, "in_map": mappable if mappable is not None else whole}
    if bed is not None:
        layers["in_bed"] = bed
    segs = overlay(layers).filter(F.col("in_genome") > 0)
    status = F.when(F.col("in_map") > 0, "MAPPABLE").otherwise("UNMAPPABLE")
    if bed is not None:
        status = F.when(F.col("in_bed") > 0, "INBED").otherwise(status)
    segs = segs.withColumn("status", status)
    return merge_intervals(segs, ["chrom", "status"]).select("chrom", "start", "end", "status")


def mappability_table(mappable: DataFrame) -> DataFrame:
    """Mappable bases per chromosome."""
    return (tiled_union(mappable).groupBy("chrom")
            .agg(F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("mappable")))
