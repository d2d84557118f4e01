"""Quality rules: word statistics of a text, fixed limits, and robust multivariate outliers.

All of it is DataFrame expressions. Per language and source, minimum-covariance-determinant
estimates of centre and scatter are found by concentration steps: each step is one
aggregate of sums and cross products per group, combined before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_or_empty

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _repeat_words() -> Column:
    """Words covered by 3-word windows that occur at least twice: equal windows stand side by side after sorting."""
    return F.expr("""aggregate(
        sort_array(transform(filter(sorted, (s, j) -> (j > 0 AND sorted[j - 1].h = s.h) OR (j < size(sorted) - 1 AND sorted[j + 1].h = s.h)), s -> s.i)),
        named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)""")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_lines``, ``n_upper``, ``n_marks`` (punctuation), ``n_distinct``. A null text has no words."""
    text = text_or_empty(text_col)
    wide = docs.withColumns({
        "_t": text,
        "_w": F.array_remove(F.split(text, BLANK), ""),
        "_l": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    wide = wide.withColumn("_h", F.expr(
        "CASE WHEN size(_w) < 3 THEN array() ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"))
    wide = wide.withColumn("sorted", F.expr(
        "CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> named_struct('h', x, 'i', i))) END"))
    out = wide.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.char_length("_t") - F.char_length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(_repeat_words(), F.lit(0)).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_upper": (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"\p{Lu}", ""))).cast("long"),
        "n_marks": (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"\p{P}", ""))).cast("long"),
        "n_distinct": F.size(F.array_distinct("_w")).cast("long")})
    return out.drop("_t", "_w", "_l", "_h", "sorted", text_col)


#: Fixed limits of the base rules.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Transformed statistics of a text with words, each with the smallest spread that counts as ordinary.
VIEWS = {
    "z_length": ("ln(word_chars / n_words)", 0.08),
    "z_symbols": ("sqrt(n_symbols / n_words)", 0.08),
    "z_upper": ("asin(sqrt(least(n_upper / word_chars, 1)))", 0.05),
    "z_marks": ("ln(0.1 + n_marks / n_words)", 0.25),
    "z_lines": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.2),
    "z_repeat": ("sqrt(n_repeat_words / n_words)", 0.2),
}
P = len(VIEWS)
#: Quantiles of the chi-square distribution with six degrees of freedom: 0.5, 0.975 and 1 - 1e-6.
CHI_HALF, CHI_WEIGHT, CHI_REJECT = 5.348, 14.449, 38.258
COVER, STEPS, LEAST_ROWS = 0.75, 3, 50

#: Minus the inverse of array<array<double>> ``m`` and the logarithm of its determinant, by sweeping every pivot.
SWEEP = f"""aggregate(sequence(0, {P - 1}), named_struct('m', m, 'logdet', 0D), (a, k) -> named_struct(
    'm', transform(a.m, (row, i) -> transform(row, (x, j) -> CASE
        WHEN i = k AND j = k THEN -1 / x WHEN i = k THEN x / a.m[k][k] WHEN j = k THEN x / a.m[k][k]
        ELSE x - row[k] * a.m[k][j] / a.m[k][k] END)),
    'logdet', a.logdet + ln(a.m[k][k])))"""
SHIFT = "+".join(f"(z[{i}] - c[{i}]) * (z[{j}] - c[{j}]) * {1 if i == j else 2} * q[{i}][{j}]" for i in range(P) for j in range(i, P))
FLOOR = [s for _, s in VIEWS.values()]


def _scatter(rows: DataFrame, by: list[str]) -> DataFrame:
    """Centre ``c``, inverse scatter ``q`` and ``logdet`` of ``z`` in each group."""
    sums = [F.count("*").alias("n")] + [F.sum(F.col("z")[i]).alias(f"s{i}") for i in range(P)]
    sums += [F.sum(F.col("z")[i] * F.col("z")[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)]
    cov = "array(" + ",".join("array(" + ",".join(
        f"s{min(i, j)}_{max(i, j)} / n - s{i} * s{j} / n / n" + (f" + {FLOOR[i] ** 2}" if i == j else "") for j in range(P)) + ")" for i in range(P)) + ")"
    return (rows.groupBy(*by).agg(*sums)
            .select(*by, F.array(*[F.col(f"s{i}") / F.col("n") for i in range(P)]).alias("c"), F.expr(cov).alias("m"))
            .withColumn("a", F.expr(SWEEP))
            .select(*by, "c", F.expr("transform(a.m, r -> transform(r, x -> -x))").alias("q"), "a.logdet"))


def _distances(rows: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(fit.select(*by, "c", "q"), by).withColumn("d", F.expr(SHIFT)).drop("c", "q")


def _nearest(rows: DataFrame, by: list[str], share: float) -> DataFrame:
    """The rows within the ``share`` quantile of distance of their group."""
    cut = rows.groupBy(*by).agg(F.percentile_approx("d", F.lit(share), F.lit(10_000)).alias("cut"))
    return rows.join(cut, by).filter("d <= cut").drop("cut", "d")


def covariance_determinant(rows: DataFrame) -> DataFrame:
    """Reweighted MCD estimates ``(grp, c, q)`` of the vectors ``z`` in each group ``grp``.

    Two deterministic starts (scaled by median and quartiles; scatter of values squashed by tanh),
    concentration steps on the nearest three quarters from both, the smaller determinant wins; the
    scatter is scaled to the chi-square median, and rows within the 0.975 quantile give the final estimates.
    """
    by = ["grp", "start"]
    quart = rows.groupBy("grp").agg(*[F.percentile_approx(F.col("z")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000)).alias(f"p{i}") for i in range(P)])
    scale = quart.select("grp", F.array(*[F.col(f"p{i}")[1] for i in range(P)]).alias("med"),
                         F.array(*[F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(P)]).alias("sd"))
    scaled = rows.join(scale, "grp")
    diag = "array(" + ",".join("array(" + ",".join(f"1 / sd[{i}] / sd[{i}]" if i == j else "0D" for j in range(P)) + ")" for i in range(P)) + ")"
    first = scale.select("grp", F.lit(0).alias("start"), F.col("med").alias("c"), F.expr(diag).alias("q"))
    squashed = scaled.select("grp", F.lit(1).alias("start"), F.array(*[F.expr(f"med[{i}] + sd[{i}] * tanh((z[{i}] - med[{i}]) / sd[{i}])") for i in range(P)]).alias("z"))
    fit = store(first.unionByName(_scatter(squashed, by).drop("logdet")), "start")
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for step in range(STEPS):
        fit = store(_scatter(_nearest(_distances(both, fit, by), by, 0.5 if step == 0 else COVER), by), "step")
    best = fit.groupBy("grp").agg(F.min_by(F.struct("c", "q"), F.struct("logdet", "start")).alias("b")).select("grp", "b.c", "b.q")
    near = _distances(rows, best, ["grp"])
    half = near.groupBy("grp").agg(F.percentile_approx("d", F.lit(0.5), F.lit(10_000)).alias("half"))
    core = near.join(half, "grp").filter(f"d * {CHI_HALF} <= {CHI_WEIGHT} * greatest(half, 1e-12)").select("grp", "z")
    return _scatter(core, ["grp"]).drop("logdet")


def _groups(rows: DataFrame) -> DataFrame:
    """Group ``grp`` of each language and source: itself from LEAST_ROWS rows on, else what is left of the language, else of all."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("small", F.col("n") < LEAST_ROWS)
    langs = sizes.filter("small").groupBy(F.col("lang").alias("lang_")).agg((F.sum("n") < LEAST_ROWS).alias("few"))
    return sizes.join(langs, F.col("lang").eqNullSafe(F.col("lang_")), "left").select(
        F.col("lang").alias("lang_"), F.col("source").alias("source_"),
        F.when(~F.col("small"), F.to_json(F.struct("lang", "source")))
        .when(~F.col("few"), F.to_json(F.struct("lang", F.lit(2).alias("tier")))).otherwise(F.lit("rest")).alias("grp"))


def _known(docs: DataFrame, wanted: list[str]) -> DataFrame:
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``row_key``, the statistics, ``base_failed``, ``distance`` and ``kept``.

    A document fails the base rules below 50 words or when more than half of its words lie in
    repeated 3-word windows. The others are vectors of six transformed statistics; one is rejected
    when its squared Mahalanobis distance from the robust centre of its language and source is
    beyond the 1 - 1e-6 chi-square quantile. Sparse sources are estimated together; fewer than
    LEAST_ROWS rows in all give no estimate, and only the base rules decide.

    A null text has no words and fails; null languages and sources are groups of their own; repeated rows are
    judged each; missing ``lang`` or ``source`` columns count as null; other columns are not read.
    """
    docs = _known(docs.withColumnRenamed(id_col, "doc_id").withColumnRenamed(text_col, "text"), ["doc_id", "lang", "source", "text"])
    docs = docs.withColumn("row_key", F.xxhash64("lang", "source", "text"))
    stats = store(statistics(docs).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words")), "statistics")
    z = [F.expr(f"CAST({e.replace('/ n_words', '/ greatest(n_words, 1)').replace('/ word_chars', '/ greatest(word_chars, 1)')} AS double)") for e, _ in VIEWS.values()]
    good = stats.filter("NOT base_failed")
    groups = _groups(good)
    rows = store(good.join(groups, good.lang.eqNullSafe(F.col("lang_")) & good.source.eqNullSafe(F.col("source_")))
                 .select(*good.columns, "grp", F.array(*z).alias("z")), "vectors")
    fits = covariance_determinant(rows.select("grp", "z"))
    enough = rows.groupBy("grp").agg((F.count("*") >= LEAST_ROWS).alias("enough"))
    fits = store(fits.join(enough, "grp"), "estimates")
    judged = rows.join(fits, "grp").withColumn("distance", F.when(F.col("enough"), F.expr(SHIFT))).select(*stats.columns, "distance")
    failed = stats.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return judged.unionByName(failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CHI_REJECT))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents, all columns as they were."""
    bad = quality_rules(docs).filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    lang, source = (F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(lang, source, "text") == F.col("_key")), "left_anti")
