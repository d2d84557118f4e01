"""Shards by extendible hashing.

A document's bucket is the shortest prefix of its hash bits whose documents fit the byte limit; only
buckets that are too large split on a further bit. The byte sums of all prefixes come from one aggregate
at the deepest level, rolled up, so rows are shuffled as (prefix, bytes) and never as texts.

Defined results: a null text has no bytes; rows with the same id share a shard; a null id hashes as an empty one;
a shard that a single id overfills stays as it is and is marked; an empty table gives no shard.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

LIMIT, DEPTH = 1 << 20, 60


def hash_bits(c) -> F.Column:
    """The first 60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(depth):
    return F.shiftrightunsigned("hash", F.lit(DEPTH) - depth) if not isinstance(depth, int) else F.shiftrightunsigned("hash", DEPTH - depth)


def directory(rows: DataFrame, limit: int = LIMIT, step: int = 16) -> DataFrame:
    """``(depth, prefix, bytes, n_keys)`` of the final buckets of ``rows(hash, bytes)``.

    Levels are worked in blocks of ``step`` bits: one aggregate at the block's last bit, sums of its shorter
    prefixes from that, and only hashes in buckets still too large go on to the next block."""
    keys = store(rows.groupBy("hash").agg(F.sum("bytes").alias("bytes")), "keys")
    done, base = [], 0
    while base < DEPTH and (base == 0 or keys.limit(1).count()):
        top = min(DEPTH, base + step)
        last = keys.groupBy(_prefix(top).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        depths = F.explode(F.sequence(F.lit(base if base == 0 else base + 1), F.lit(top))).alias("depth")
        sums = store(last.select("p", "bytes", "n", depths).groupBy("depth", F.expr(f"shiftrightunsigned(p, {top} - depth)").alias("prefix"))
                     .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "prefixes")
        fits = sums.filter((F.col("bytes") <= limit) | ((F.col("depth") == DEPTH) & F.lit(top == DEPTH)))
        parent = sums.select((F.col("depth") + 1).alias("depth"), "prefix", F.col("bytes").alias("above"))
        final = (fits.join(parent.withColumnRenamed("prefix", "up"), [fits.depth == parent.depth, F.shiftrightunsigned(fits.prefix, 1) == F.col("up")], "left")
                 .filter(F.col("above").isNull() | (F.col("above") > limit)).select(fits.depth, "prefix", "bytes", F.col("n").alias("n_keys")))
        done.append(store(final, "buckets"))
        large = sums.filter((F.col("depth") == top) & (F.col("bytes") > limit)).select(F.col("prefix").alias("p"))
        keys = store(keys.withColumn("p", _prefix(top)).join(large, "p", "left_semi").drop("p"), "keys")
        base = top
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, depth, prefix, shard_bytes, oversized)`` for every row."""
    rows = store(docs.select(F.col(id_col).alias("id"), hash_bits(id_col).alias("hash"),
                             F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")), "hashes")
    found = store(directory(rows, limit), "directory")
    depths = [r.depth for r in found.select("depth").distinct().collect()]  # at most 61
    tries = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in sorted(depths)] or [F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))]))
    return (rows.select("id", tries.alias("t")).select("id", "t.depth", "t.prefix")
            .join(found.select("depth", "prefix", F.col("bytes").alias("shard_bytes")), ["depth", "prefix"])
            .select("id", "depth", "prefix", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized")))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """The documents as one folder for each shard."""
    placed = shards(docs, limit).select(F.col("id").alias("doc_id"), F.concat_ws("-", "depth", "prefix").alias("shard")).distinct()
    docs.join(placed, docs.doc_id.eqNullSafe(placed.doc_id)).drop(placed.doc_id).repartition("shard").write.partitionBy("shard").parquet(path)


#: The directory level by level: sums of every prefix, and for each document its shortest prefix that fits.
SQL = f"""
WITH h AS (SELECT doc_id, ('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS hash,
                  COALESCE(octet_length(encode(text)), 0) AS bytes FROM documents),
p AS (SELECT h.doc_id, h.bytes, d.depth, h.hash >> ({DEPTH} - d.depth) AS prefix FROM h, (SELECT unnest(range(0, 25))::BIGINT AS depth) d),
s AS (SELECT depth, prefix, sum(bytes) AS shard_bytes FROM p GROUP BY 1, 2)
SELECT p.doc_id, CAST(p.depth AS INTEGER) AS depth, p.prefix, CAST(s.shard_bytes AS BIGINT) AS shard_bytes, false AS oversized
FROM p JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {LIMIT}
QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) = 1"""
