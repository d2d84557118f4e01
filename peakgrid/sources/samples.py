"""Sample sheet: ChIP / input pairs and their display settings."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SAMPLES
from ..session import lookup


def _binsize(path: str) -> int:
    parts = path.split(".")
    last = len(parts) - 1
    if parts[last] == "gz":
        last -= 1
    try:
        return int(parts[last - 1])
    except (ValueError, IndexError):
        return 0


def sample_sheet(spark: SparkSession, rows: list[str], overlays: list[str] = (), binsize: int | None = None) -> DataFrame:
    """Rows ``ChIP,Input,label,peak list,binsize,scale_tag,scale_ratio,scale_pvalue``; only the first is needed.

    The label falls back to the file name and the bin size to the number before the
    suffix. Overlays attach to the rows by position (``overlay_of`` = label).
    """
    def parse(row: str, over: str | None):
        f = row.split(",")
        if len(f) > 8:
            raise ValueError(f"more than 8 fields: {row}")
        f += [""] * (8 - len(f))
        if not f[0]:
            raise ValueError(f"no ChIP sample: {row}")
        size = int(f[4]) if f[4] else (binsize or _binsize(f[0]))
        if size <= 0:
            raise ValueError(f"bin size unknown: {row}")
        if f[1] and not f[4] and not binsize and _binsize(f[1]) != size:
            raise ValueError(f"bin size of ChIP and input differ: {row}")
        scale = [float(x) if x else None for x in f[5:8]]
        return (f[0], f[1] or None, f[2] or f[0].rsplit("/", 1)[-1], f[3] or None, size, *scale, over)

    first = [parse(r, None) for r in rows]
    if len(overlays) > len(first):
        raise ValueError("more overlays than samples")
    second = [parse(r, first[i][2]) for i, r in enumerate(overlays) if r]
    return spark.createDataFrame(first + second, SAMPLES)


def signal_paths(sheet: DataFrame) -> list[str]:
    """Every signal file once, though several pairs may share it (a sheet is a small parameter table)."""
    paths = {r[0] for r in sheet.select("chip").collect()} | {r[0] for r in sheet.select("input").collect() if r[0]}
    return sorted(paths)


def pairs_of(sheet: DataFrame) -> DataFrame:
    """(label, chip, input, panel, layer_no): overlays share the panel of their sample."""
    return lookup(sheet.selectExpr("label", "chip", "input", "coalesce(overlay_of, label) AS panel",
                                   "CASE WHEN overlay_of IS NULL THEN 0 ELSE 1 END AS layer_no"))
