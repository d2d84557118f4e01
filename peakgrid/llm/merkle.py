"""Merkle manifest of a dataset: leaf digests, subroots by language, root and a proof for every row.

The leaves of a language, in the order of their ids, are dealt to aligned blocks of ``FANOUT ** DEPTH``. A block hashes its own
subtree. Then the blocks exchange like a butterfly: in each round the ``FANOUT`` blocks that differ in one digit of their
number swap the roots they hold, and each of them hashes the parent for itself. So after a round for every
digit each block of a language holds the subroot and all proof levels on the way; nothing is handed down again. Further rounds do the
same between languages. A last, ragged group of blocks has too few members for all partners: its members serve several.

A node is the SHA-256 of its children's hexadecimal digests; an incomplete last run is hashed like the others, and a lone node stays as it is.

Defined results: a null field is ``-``; null ids come first in their language, equal ids are ordered by leaf, then by row (equal leaves
are interchangeable); null languages form a language of their own; repeated rows are leaves of their own; an empty table has no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakgrid.operators.profiles import global_rank
from peakgrid.session import lookup

from .common import store

FANOUT, DEPTH = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<place:int,nodes:array<string>>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields in a row: ``-`` for a null, else UTF-8 bytes, a colon and the value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


def levels(n: int, fanout: int = FANOUT) -> int:
    """Steps until ``n`` nodes are one."""
    steps = 0
    while n > 1:
        n, steps = -(-n // fanout), steps + 1
    return steps


def number(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves(lang, doc_id, leaf, ...)`` with ``lang_no`` and the place ``ord`` in the language; and ``(lang_no, n)`` of every language.

    Rows are dealt to sorted ranges; only counts by range and language are added up across ranges.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["lang", "doc_id", "leaf", "_row"]
    ranged = store(leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).drop("_row"), "ranged")
    sizes = store(ranged.groupBy("lang", "_part").agg(F.count("*").alias("_n"), F.min("_i").alias("_low")), "sizes")  # ranges + languages rows
    totals = sizes.groupBy("lang").agg(F.sum("_n").alias("n"))
    langs = store(global_rank(totals, [F.col("lang").asc()], "lang_no").withColumn("lang_no", F.col("lang_no").cast("int")), "langs")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (sizes.withColumn("_before", before).join(langs.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
              .select("lang_no", F.col("lang").alias("_lang"), "_part", "_low", "_before"))
    starts = lookup(store(starts, "starts")).withColumnRenamed("_part", "_p")
    placed = ranged.join(starts, (F.col("_part") == F.col("_p")) & F.col("lang").eqNullSafe(F.col("_lang")))
    return (placed.withColumn("ord", F.col("_i") - F.col("_low") + F.col("_before")).drop("_part", "_p", "_i", "_low", "_before", "_lang"),
            langs.select("lang_no", "n"))


def _run(block: list[str], steps: int, fanout: int) -> list[list[str]]:
    """All levels of a block, bottom first."""
    out = [block]
    for _ in range(steps):
        last = out[-1]
        out.append([hashlib.sha256("".join(last[i:i + fanout]).encode()).hexdigest() for i in range(0, len(last), fanout)])
    return out


def _spread(df: DataFrame, name: str, start: Column, stop: Column, step: Column, part: int = 4096) -> DataFrame:
    """A row for each of ``start``, ``start + step``, ... up to ``stop``; no array gets longer than the square root of their number or ``part``."""
    last = F.floor((stop - start) / step)
    return (df.withColumn("_k0", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(part).cast("long"))))
            .withColumn("_k", F.explode(F.sequence(F.col("_k0"), F.least(F.col("_k0") + (part - 1), last))))
            .withColumn(name, start + F.col("_k") * step).drop("_k0", "_k"))


def _swap(state: DataFrame, group: Sequence[Column], digit: Column, slots: Sequence[tuple[Column, Column, Column, Column]], active: Column) -> DataFrame:
    """One exchange: every member of a group learns the nodes of its partners, in order of ``digit``, and hashes their parent.

    ``slots`` are (own place, first, last, step) of the places that a block sends its node to, its own first. Blocks that are not
    ``active`` meet nobody and keep what they hold.
    """
    keep = [c for c in state.columns if c not in ("node", "path")]
    sent = state.select(*[g.alias(f"_g{i}") for i, g in enumerate(group)], digit.cast("int").alias("place"), active.alias("active"),
                        *[c.cast("long").alias(f"_{what}{i}") for i, slot in enumerate(slots) for what, c in zip(("own", "first", "last", "step"), slot)], "node", "path", *keep)
    own = F.lit(True)
    for i in range(len(slots)):
        last = F.when(F.col("active"), F.col(f"_last{i}")).otherwise(F.col(f"_first{i}"))
        sent = _spread(sent, f"_slot{i}", F.col(f"_first{i}"), last, F.col(f"_step{i}"))
        own = own & (F.col(f"_slot{i}") == F.col(f"_own{i}"))
    keys = [f"_g{i}" for i in range(len(group))] + [f"_slot{i}" for i in range(len(slots))]
    met = (sent.withColumn("member", F.when(own, F.struct("place", "active", "path", *keep))).groupBy(*keys)
           .agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("nodes"), F.collect_list("member").alias("members")))  # one of each digit
    heard = met.select(F.col("nodes.node").alias("nodes"), F.explode("members").alias("m"))
    up = F.concat("m.path", F.array(F.struct(F.col("m.place").alias("place"), F.col("nodes").alias("nodes"))))
    return heard.select(*[F.col(f"m.{c}").alias(c) for c in keep], F.when(F.col("m.active"), F.sha2(F.array_join("nodes", ""), 256)).otherwise(F.col("nodes")[0]).alias("node"),
                        F.when(F.col("m.active"), up).otherwise(F.col("m.path")).alias("path"))


def exchange(blocks: DataFrame, langs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``blocks(lang_no, block, node)`` with ``subroot``, ``root`` and the ``path`` of ``(place, nodes)`` above the block, bottom first.

    A lone block of a language has no own rounds, and a lone language none between languages.
    """
    wide = fanout ** depth
    sizes = langs.withColumn("n_blocks", F.ceil(F.col("n") / wide).cast("long")).drop("n")
    top = sizes.agg(F.max("n_blocks").alias("blocks"), F.count("*").alias("langs")).first()
    rounds, lang_rounds = levels(top.blocks or 0, fanout), levels(top.langs, fanout)
    for r in range(lang_rounds):  # most blocks of a language that meets in the round
        sizes = sizes.withColumn("_g", F.floor(F.col("lang_no") / fanout ** (r + 1)))
        sizes = sizes.join(sizes.groupBy("_g").agg(F.max("n_blocks").alias(f"widest{r}")), "_g").drop("_g")
    state = blocks.join(lookup(store(sizes, "languages")), "lang_no").withColumn("path", F.array().cast(PATH))

    def digits(of: str, total: Column, r: int):
        half, span = fanout ** r, fanout ** (r + 1)
        at, low, sub = F.col(of).cast("long"), F.col(of) % half, F.floor(F.col(of) / half)
        count = F.least(F.lit(half), total - sub * half)  # members of the own group of the round before
        reach = F.least(F.lit(half), total - F.floor(at / span) * span)  # places with a block at all
        return F.floor(at / span), sub % fanout, (low, low, reach - 1, count)
    for r in range(rounds):
        group, digit, slot = digits("block", F.col("n_blocks"), r)
        state = _swap(state, [F.col("lang_no"), group], digit, [slot], F.col("n_blocks") > fanout ** r)
    state = state.withColumn("subroot", F.col("node"))
    for r in range(lang_rounds):
        group, digit, slot = digits("lang_no", F.lit(top.langs), r)
        seats = (F.col("block"), F.col("block"), F.col(f"widest{r}") - 1, F.col("n_blocks"))  # a block serves those of larger languages too
        state = _swap(state, [group], digit, [slot, seats], F.lit(True))
    return state.select("lang_no", "block", "path", "subroot", F.col("node").alias("root"))


def fold(leaf: str, proof: Sequence[tuple[int, Sequence[str]]]) -> str:
    """The root that a leaf and its ``(place, siblings)`` levels lead to."""
    for place, others in proof:
        leaf = hashlib.sha256("".join([*others[:place], leaf, *others[place:]]).encode()).hexdigest()
    return leaf


def open_leaves(leaves: DataFrame, make: Callable, schema: str, extra: Sequence[str] = (), fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Build the tree over ``leaves(lang, doc_id, leaf, *extra)`` and emit ``make(row, proof)`` for every row of every block.

    ``proof`` has ``(place, siblings)`` for every level; ``row`` holds doc_id, leaf, the extra columns, subroot and root.
    """
    wide = fanout ** depth
    placed, langs = number(store(leaves, "leaves"))
    langs = store(langs, "counts")
    placed = placed.join(lookup(langs), "lang_no").withColumn("block", F.floor(F.col("ord") / wide).cast("long"))
    # a block of a language with several blocks climbs all its levels; a lone block stops at one node
    steps = F.expr("CASE " + " ".join(f"WHEN n <= {fanout ** k} THEN {k}" for k in range(depth)) + f" ELSE {depth} END")
    placed = store(placed.select("lang_no", "block", "ord", steps.alias("steps"), "doc_id", "leaf", *extra), "placed")

    def root_of(key, t):
        t = t.sort_by("ord")
        top = _run(t.column("leaf").to_pylist(), t.column("steps")[0].as_py(), fanout)[-1][0]
        return pa.table({"lang_no": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "node": [top]})
    blocks = store(placed.select("lang_no", "block", "ord", "steps", "leaf").groupBy("lang_no", "block").applyInArrow(root_of, "lang_no int, block long, node string"), "blocks")
    upper = store(exchange(blocks, langs, fanout, depth), "upper")

    def prove(key, mine, above):
        mine = mine.sort_by("ord")
        top = above.to_pylist()[0]
        upper_levels = [(p["place"], p["nodes"][:p["place"]] + p["nodes"][p["place"] + 1:]) for p in top["path"]]
        rows = mine.select(["doc_id", "leaf", *extra]).to_pylist()
        tree = _run([r["leaf"] for r in rows], mine.column("steps")[0].as_py(), fanout)
        out = []
        for i, r in enumerate(rows):
            proof, at = [], i
            for level in tree[:-1]:
                low, place = at - at % fanout, at % fanout
                run = level[low:low + fanout]
                proof.append((place, run[:place] + run[place + 1:]))
                at //= fanout
            r["subroot"], r["root"] = top["subroot"], top["root"]
            out.append(make(r, proof + upper_levels))
        return pa.Table.from_pylist(out, shape)
    shape = _arrow(leaves, schema)
    return placed.groupBy("lang_no", "block").cogroup(upper.groupBy("lang_no", "block")).applyInArrow(prove, schema)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def leaf_rows(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"), *more)


def manifest(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof)``; ``proof`` is an array of ``(place, siblings)``, bottom first."""
    def make(row, proof):
        return row | {"proof": [{"place": p, "siblings": s} for p, s in proof]}
    return open_leaves(leaf_rows(docs), make, "doc_id long, leaf string, subroot string, root string, proof array<struct<place:int,siblings:array<string>>>", fanout=fanout, depth=depth)


def audit(docs: DataFrame, changed: DataFrame | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Proof digest of every row, and the root folded from the leaf of ``seen`` (a column of ``changed``, which is ``docs`` with it; else the own leaf)."""
    def make(row, proof):
        row["proof_sha256"] = hashlib.sha256("".join(x for _, others in proof for x in others).encode()).hexdigest()
        row["folded_root"] = fold(row["seen"], proof)
        row["verified"] = row["folded_root"] == row["root"]
        return row
    rows = leaf_rows(docs if changed is None else changed, (leaf_digest([F.col(c) for c in FIELDS]) if changed is None else F.col("seen")).alias("seen"))
    return open_leaves(rows, make, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", ["seen"], fanout, depth)


def tampered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``seen``: the leaf after the texts of every third row (by CRC-32 of the id) are put in small letters."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = leaf_digest([F.col(c) for c in FIELDS])
    return docs.withColumn("seen", F.when(hit, leaf_digest([lower if c == "text" else F.col(c) for c in FIELDS])).otherwise(own))


def check_sql(steps: int = 10, fanout: int = FANOUT) -> str:
    """The tree level by level, for up to ``fanout ** steps`` leaves of a language and as many languages."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text):
        return "sha256(" + " || ".join(f"COALESCE(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
                                       for c in [*FIELDS[:-1], text]) + ")"
    crc = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), "
           "lambda c, x: list_reduce(list_prepend(xor(c, x), [0,0,0,0,0,0,0,0]::BIGINT[]), "
           "lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))")
    sql = f"""
WITH crc AS MATERIALIZED (SELECT *, xor({crc}, 4294967295::BIGINT) AS crc FROM documents),
l AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(low.format('text'))} ELSE {leaf('text')} END AS seen FROM crc),
own AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM l),
a0 AS MATERIALIZED (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS node, rid FROM own),
w0 AS MATERIALIZED (SELECT rid, lang, i AS at, CAST('' AS VARCHAR) AS proof, seen AS folded FROM a0 JOIN own USING (rid, lang)),
""".replace("a0 JOIN own USING (rid, lang)", "a0 JOIN (SELECT rid, seen FROM own) USING (rid)")

    def level(a, w, key, k):
        """Nodes, and each row's proof and folded digest, one level up; a lone node stays."""
        same = "n.lang IS NOT DISTINCT FROM w.lang" if key else "true"
        part = "PARTITION BY lang" if key else ""
        group = "lang, " if key else ""
        return f"""
c{a}{k} AS (SELECT *, count(*) OVER ({part}) AS n FROM {a}{k}),
g{a}{k} AS MATERIALIZED (SELECT {group}i // {fanout} AS g, list(node ORDER BY i) AS nodes, any_value(n) AS n FROM c{a}{k} GROUP BY {group}i // {fanout}),
{a}{k + 1} AS MATERIALIZED (SELECT {group}g AS i, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM g{a}{k}),
{w}{k + 1} AS MATERIALIZED (SELECT w.rid, w.lang, w.at // {fanout} AS at,
  w.proof || CASE WHEN n.n = 1 THEN '' ELSE array_to_string(n.nodes[1:w.at % {fanout}], '') || array_to_string(n.nodes[w.at % {fanout} + 2:], '') END AS proof,
  CASE WHEN n.n = 1 THEN w.folded ELSE sha256(array_to_string(n.nodes[1:w.at % {fanout}], '') || w.folded || array_to_string(n.nodes[w.at % {fanout} + 2:], '')) END AS folded
  FROM {w}{k} w JOIN g{a}{k} n ON {same} AND n.g = w.at // {fanout}),"""
    for k in range(steps):
        sql += level("a", "w", True, k)
    sql += f"""
sub AS MATERIALIZED (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM a{steps}),
b0 AS (SELECT i, subroot AS node FROM sub),
v0 AS (SELECT w.rid, w.lang, s.i AS at, w.proof, w.folded FROM w{steps} w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang),"""
    for k in range(steps // 2):
        sql += level("b", "v", False, k)
    return sql + f"""
top AS (SELECT node AS root FROM b{steps // 2})
SELECT own.doc_id, own.leaf, sub.subroot, top.root, sha256(v.proof) AS proof_sha256, v.folded AS folded_root, v.folded = top.root AS verified
FROM v{steps // 2} v JOIN own ON own.rid = v.rid JOIN sub ON sub.lang IS NOT DISTINCT FROM own.lang CROSS JOIN top"""
