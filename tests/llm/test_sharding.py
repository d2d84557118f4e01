"""Extendible hashing against splitting bucket by bucket."""
import hashlib

import pytest

from peakgrid.llm import sharding


def split(rows, limit, depth=0, prefix=0):
    """rows: (id, hash, bytes) -> id: (depth, prefix, bytes)."""
    total = sum(b for _, _, b in rows)
    if total <= limit or depth == 60:
        return {i: (depth, prefix, total) for i, _, _ in rows}
    out = {}
    for bit in (0, 1):
        part = [r for r in rows if r[1] >> (59 - depth) & 1 == bit]
        out |= split(part, limit, depth + 1, prefix * 2 + bit) if part else {}
    return out


@pytest.mark.parametrize("limit", [40, 300, 10**9])
def test_equals_single_splits(spark, limit):
    rows = [(i, "x" * (i % 37)) for i in range(400)] + [(7, "é" * 30), (7, None), (900, "y" * 500), (None, "z")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, depth int")
    keyed = [(i, int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), len((t or "").encode())) for i, t in rows]
    want = split(keyed, limit)
    got = sharding.shards(df, limit).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.depth, r.prefix, r.shard_bytes) for r in got} == want
    assert all(r.oversized == (r.shard_bytes > limit) for r in got)
    assert sharding.shards(df.limit(0), limit).collect() == []


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50) for i in range(60)] + [(None, None)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 500)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text").collect(), key=str) == sorted(df.collect(), key=str)
