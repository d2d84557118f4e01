"""The manifest against a tree built in plain Python, on ragged sizes, odd rows and the registered query's SQL."""
import hashlib
import zlib

import pytest

from peakgrid.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seen string, block int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[3], row[2], row[4], text)))


def climb(nodes, fanout):
    """Root, and for each node its proof as (place, others)."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(proofs):
            low = at[i] - at[i] % fanout
            run = nodes[low:low + fanout]
            p.append((at[i] % fanout, run[:at[i] % fanout] + run[at[i] % fanout + 1:]))
            at[i] //= fanout
        nodes = [h("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute(rows, fanout):
    out, langs = [], sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        parts.append((mine, *climb([leaf(r, r[1]) for r in mine], fanout)))
    root, tops = climb([sub for _, sub, _ in parts], fanout)
    for (mine, sub, proofs), top in zip(parts, tops):
        for r, p in zip(mine, proofs):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            low = r[1] if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            folded = leaf(r, low if hit else r[1])
            for place, others in p + top:
                folded = h("".join([*others[:place], folded, *others[place:]]))
            out.append((r[0], leaf(r, r[1]), sub, root, h("".join(x for _, o in p + top for x in o)), folded, folded == root))
    return sorted(out, key=repr)


def table(spark, sizes):
    rows = [(7 * i % 1000 + 1000 * k, f"Text {i} É", lang, f"s{i % 3}", i, "own", 3) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("fanout, depth, sizes", [
    (2, 1, {"de": 37, "en": 1, None: 6, "é": 3, "z": 2}),
    (3, 2, {"a": 100, "b": 9, "c": 10, "d": 28, "e": 1, "f": 82, "g": 2, "h": 3, "i": 1, "j": 5}),
    (8, 3, {"en": 40}),
    (8, 1, {"en": 300, "fr": 65}),
    (2, 2, {"x": 1}),
])
def test_equals_brute_force(spark, fanout, depth, sizes):
    rows, df = table(spark, sizes)
    got = merkle.audit(df, merkle.tampered(df.drop("seen")), fanout, depth).select(COLS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, fanout)
    assert {r.verified for r in got} == ({True, False} if len(rows) > 3 else {True})


def test_odd_rows(spark):
    """Null fields, null ids, repeated rows, one id with two texts, empty and long texts."""
    rows = [(None, "A", "en", None, None, "", 0), (None, "B", "en", "s", 1, "", 0), (3, None, None, "s", 2, "", 0), (3, "", None, "s", 2, "", 0), (5, "X" * 200_000, "en", "", 0, "", 0),
            (5, "X", "en", "", 0, "", 0), (9, "same", "en", "s", 1, "", 0), (9, "same", "en", "s", 1, "", 0), (2, "12:a", "", "-", -4, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = merkle.audit(df, merkle.tampered(df), 2, 1).select(COLS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)
    assert merkle.audit(df.limit(0), merkle.tampered(df.limit(0))).collect() == []


def test_manifest_proofs_fold_to_the_root(spark):
    rows, df = table(spark, {"a": 50, "b": 7, "c": 1})
    got = merkle.manifest(df, 2, 2).collect()
    assert len(got) == 58 and len({r.root for r in got}) == 1
    for r in got:
        proof = [(p.place, p.siblings) for p in r.proof]
        assert merkle.fold(r.leaf, proof) == r.root and merkle.fold(h("other"), proof) != r.root
