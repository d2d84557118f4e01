"""URL filter: rules first, then the ratio of two character Markov models of variable order.

URLs that a rule allows or blocks are the examples of an accepting and a rejecting model, each folded string with the
number of its rows of either verdict. Characters are folded to 38 signs. A sign's probability is interpolated from the
orders below it by Witten-Bell weights, so that a context counts as far as it has been seen; contexts have up to four
signs. Every context that an example has is kept; a sign is looked up under the longest kept context before it, whether the two
were seen together or not. Contexts are bounded by the signs, not by the corpus, and the table of log ratios has at most 38 rows
each; it is brought to the tasks where it is counted and found small, else joined by shuffle, once for each distinct window. A URL's score is the sum of the log ratios of its signs by its length; it
is blocked below the threshold that separates held-out examples best. All of it is DataFrame expressions.

Defined results: a null url, or one without ``://``, has an empty host and path; an empty url scores 0; without examples of both
kinds every score is 0 and the threshold blocks nothing; repeated rows are judged each.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakgrid.session import lookup

from .common import frequency_cut, store

#: (verdict, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BINS = 0.01
START, FOLD = "^", "~"
SIGNS = "abcdefghijklmnopqrstuvwxyz0:/.?#=&%_-" + FOLD
#: Signs of the longest context.
ORDER = 4
#: Contexts kept by their count beside the empty one; None keeps all. A number is for trials only, no query sets one.
CONTEXTS: int | None = None
#: Rows of a table that is brought to every task.
SMALL = 200_000


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits (as written, like ``net/``) and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _signs(url: Column) -> Column:
    """Lower case, digits as 0, and everything but letters and ten signs as one."""
    low = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    return F.regexp_replace(low, r"[^a-z0:/.?#=&%_-]", FOLD)


def _windows(df: DataFrame, *keep: str) -> DataFrame:
    """Each sign of ``s`` with the signs before it."""
    return (df.filter("length(s) > 0").withColumn("_p", F.concat(F.lit(START * ORDER), "s"))
            .select(*keep, F.explode(F.expr(f"transform(sequence(1, length(_p) - {ORDER}), i -> substring(_p, i, {ORDER + 1}))")).alias("g")))


def ratios(examples: DataFrame) -> DataFrame:
    """``(w, ratio)``: natural log ratio of accepting to rejecting probability of a sign behind each kept context.

    ``examples`` = (s, verdict, n); w is the context and the sign. Empty without examples of both verdicts.
    """
    grams = _windows(examples, "verdict", "n").groupBy("verdict", "g").agg(F.sum("n").alias("n"))
    seen = (grams.select("verdict", "n", F.explode(F.expr(f"transform(sequence(0, {ORDER}), k -> substring(g, {ORDER + 1} - k, k + 1))")).alias("w"))
            .groupBy("verdict", "w").agg(F.sum("n").alias("n")).withColumn("c", F.expr("substring(w, 1, length(w) - 1)")))
    seen = store(seen, "seen")
    both = seen.groupBy("c").agg(F.sum("n").alias("n"))
    cut = 1 if CONTEXTS is None else frequency_cut(both.filter("c <> ''"), CONTEXTS)
    kept = store(both.filter((F.col("n") >= cut) | (F.col("c") == "")).select("c"), "contexts")
    if CONTEXTS is not None:
        seen = store(seen.join(kept, "c"), "seen")
    context = seen.groupBy("verdict", F.col("c").alias("own")).agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    probs = (kept.select("c", F.explode(F.split(F.lit(SIGNS), "")).alias("x")).filter("x <> ''")
             .select("c", "x", F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("verdict")).withColumn("p", F.lit(1 / len(SIGNS))))
    for order in range(ORDER + 1):
        own = F.when(F.length("c") >= order, F.expr(f"substring(c, length(c) - {order} + 1, {order})"))
        probs = (probs.withColumn("own", own).withColumn("w", F.concat("own", "x"))
                 # few rows of the short contexts, which are many rows' own
                 .join(lookup(seen.filter(F.length("c") == order).select("verdict", "w", "n"), SMALL), ["verdict", "w"], "left")
                 .join(lookup(context.filter(F.length("own") == order), SMALL), ["verdict", "own"], "left")
                 .withColumn("p", F.expr("CASE WHEN total IS NULL THEN " + ("NULL" if order == 0 else "p") + " ELSE (coalesce(n, 0) + types * p) / (total + types) END"))
                 .select("c", "x", "verdict", "p"))
    wide = probs.groupBy("c", "x").agg(F.max(F.when(F.col("verdict") == "allow", F.col("p"))).alias("a"), F.max(F.when(F.col("verdict") == "block", F.col("p"))).alias("b"))
    return wide.filter("a IS NOT NULL AND b IS NOT NULL").select(F.concat("c", "x").alias("w"), F.ln(F.col("a") / F.col("b")).alias("ratio"))


def scores(urls: DataFrame, table: DataFrame) -> DataFrame:
    """``(key, score)`` of distinct sign strings: mean log ratio, each sign under its longest kept context."""
    windows, found = _windows(urls, "s").withColumnRenamed("s", "key"), []
    distinct = windows.select("g").distinct()
    for order in range(ORDER, -1, -1):
        one = table.filter(F.length("w") == order + 1).select(F.col("w").alias(f"w{order}"), F.col("ratio").alias(f"r{order}"))
        distinct = distinct.withColumn(f"w{order}", F.expr(f"substring(g, {ORDER + 1 - order}, {order + 1})")).join(lookup(one, SMALL), f"w{order}", "left")
        found.append(f"r{order}")
    each = store(distinct.select("g", F.coalesce(*found, F.lit(0.0)).alias("ratio")), "windows")
    return windows.join(lookup(each, SMALL), "g").groupBy("key").agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row ``cut``: the bin edge with the smallest balanced error on ``(score, allowed, blocked)``, nearest to 0 among equals."""
    bins = scored.groupBy(F.floor(F.col("score") / BINS).alias("k")).agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    # scores are bounded by the logarithm of the smallest probability, so there are few thousand bins at most
    return bins.agg(F.collect_list(F.struct("k", "a", "b")).alias("bins")).select(F.expr(f"""
        CASE WHEN aggregate(bins, 0L, (x, y) -> x + y.a) = 0 OR aggregate(bins, 0L, (x, y) -> x + y.b) = 0 THEN -1e9 ELSE
        array_min(transform(array_append(transform(bins, e -> e.k), 0L), e -> named_struct(
            'error', round(aggregate(filter(bins, y -> y.k < e), 0D, (x, y) -> x + y.a) / aggregate(bins, 0L, (x, y) -> x + y.a)
                   + aggregate(filter(bins, y -> y.k >= e), 0D, (x, y) -> x + y.b) / aggregate(bins, 0L, (x, y) -> x + y.b), 9),
            'far', abs(e), 'e', e))).e * {BINS}D END""").alias("cut"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, score, verdict)`` for every row."""
    host, path = parts("url")
    rule, kind = rule_of()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path, "s": _signs(F.col("url"))})
    rows = store(rows.withColumn("rule", rule).withColumn("by_rule", kind).drop("url"), "urls")
    # strings that both kinds of rules meet are examples of both, by their rows
    texts = store(rows.groupBy("s").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")), "texts")
    held = F.pmod(F.xxhash64("s"), F.lit(5)) == 0
    known = texts.filter("allowed + blocked > 0")
    labelled = known.filter(~held).select("s", F.expr("stack(2, 'allow', allowed, 'block', blocked) AS (verdict, n)")).filter("n > 0")
    table = store(ratios(labelled), "ratios")
    scored = store(scores(texts, table), "scores")
    cut = threshold(known.filter(held).join(scored, known.s == scored.key).select("score", "allowed", "blocked")).first().cut  # one number
    judged = rows.join(scored, rows.s == scored.key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return judged.select("id", "host", "path", "rule", "score", F.coalesce(
        "by_rule", F.when(F.col("score") < cut, "block").otherwise("allow")).alias("verdict"))
