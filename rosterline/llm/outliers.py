"""Quality rules: plain limits, then robust multivariate outliers, in DataFrame operations only.

Per language and source, the location and scatter of transformed text statistics are estimated by the
minimum covariance determinant: starting from medians and median deviations, concentration steps
refit mean and covariance on the share ``core`` of the documents that lie nearest. Documents far from
the estimate in Mahalanobis distance are rejected.

Quantiles within a group are read from counts per bin, and moments are exact integer sums, so no
group is gathered anywhere and a rerun gives the same verdicts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterline.functions.blanks import let
from rosterline.llm.common import SPACE, WORD, rows_of, whole_text, written

SYMBOLS = "#*$%&|<>"
STATISTICS = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
# The least standard deviation of each statistic: most texts have no symbol and no repeated line at
# all, and a scatter of zero would reject the first text that has one.
FLOOR = (0.3, 0.35, 0.15, 0.15, 0.15)
SCALE = 4096


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more, each word counted once."""
    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def places(grams: Column) -> Column:
        """Sorted starts of the windows whose digest is not the only one of its kind."""
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return let(pairs, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, k: (F.get(p, k - 1)["g"] == x["g"]) | F.coalesce(F.get(p, k + 1)["g"] == x["g"], F.lit(False))),
            lambda x: x["i"])))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3)))),
            F.lit(0), lambda a, b: a + b)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(grams, lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(places(g), covered))))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, _row, lang, source`` and the counts the rules use, over whole texts (null: empty)."""
    rows = rows_of(docs, "doc_id", "lang", "source", whole_text().alias("text"))
    words = F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    counts = let(words, lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    return rows.select(
        "doc_id", "_row", "lang", "source", counts.alias("counts"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(
        "doc_id", "_row", "lang", "source", F.col("counts.n_words").cast("long").alias("n_words"),
        F.col("counts.word_chars").cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", F.col("counts.n_repeat_words").cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed(measured: DataFrame) -> DataFrame:
    """The statistic vector as integers of 1 / SCALE."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log(n), 4 * F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), 4 * F.sqrt(F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines")) / 2, 2 * F.sqrt(F.col("n_repeat_words") / n))
    return measured.withColumns({name: F.round(v * SCALE).cast("long") for name, v in zip(STATISTICS, values)})


def _quantile(rows: DataFrame, share: float) -> DataFrame:
    """``grp, dim, value``: the least ``value`` of (grp, dim) with ``share`` of the rows at or below it."""
    counts = rows.groupBy("grp", "dim", "value").agg(F.count("*").alias("n"))
    by_value = Window.partitionBy("grp", "dim").orderBy("value")
    whole = Window.partitionBy("grp", "dim")
    return (
        counts.withColumn("upto", F.sum("n").over(by_value)).withColumn("all", F.sum("n").over(whole))
        .filter(F.col("upto") >= F.col("all") * share)
        .groupBy("grp", "dim").agg(F.min("value").alias("value")))


def _long_form(rows: DataFrame, values) -> DataFrame:
    return rows.select("grp", F.posexplode(F.array(*values)).alias("dim", "value"))


def _wide(values: DataFrame, prefix: str) -> DataFrame:
    return values.groupBy("grp").agg(*(
        F.max(F.when(F.col("dim") == d, F.col("value"))).alias(f"{prefix}{d}") for d in range(len(STATISTICS))))


def _start(rows: DataFrame, bin_: int) -> DataFrame:
    """``grp, m0.., s0..``: medians and scaled median deviations, to a bin's width."""
    binned = [F.floor(F.col(x) / bin_) * bin_ for x in STATISTICS]
    medians = _wide(_quantile(_long_form(rows, binned), 0.5), "m")
    off = [F.floor(F.abs(F.col(x) - F.col(f"m{d}")) / bin_) * bin_ for d, x in enumerate(STATISTICS)]
    spread = _wide(_quantile(_long_form(rows.join(medians, "grp"), off), 0.5), "d")
    return medians.join(spread, "grp").select("grp", *(f"m{d}" for d in range(len(STATISTICS))), *(
        F.greatest(F.col(f"d{d}") * 1.4826, F.lit(f * SCALE)).alias(f"l{d}{d}") for d, f in enumerate(FLOOR)), *(
        F.lit(0.0).alias(f"l{d}{e}") for d in range(len(STATISTICS)) for e in range(d)))


def _fit(rows: DataFrame) -> DataFrame:
    """``grp, m.., l..``: mean and Cholesky factor of the covariance of each group, from exact sums."""
    dims = range(len(STATISTICS))
    x = [F.col(c) for c in STATISTICS]
    exact = "decimal(38,0)"
    sums = rows.groupBy("grp").agg(
        F.count("*").cast("double").alias("n"), *(F.sum(x[d].cast(exact)).alias(f"s{d}") for d in dims),
        *(F.sum((x[d] * x[e]).cast(exact)).alias(f"p{d}{e}") for d in dims for e in range(d + 1)))
    fit = sums.select("grp", "n", *((F.col(f"s{d}").cast("double") / F.col("n")).alias(f"m{d}") for d in dims), *(
        F.col(f"p{d}{e}").cast("double").alias(f"p{d}{e}") for d in dims for e in range(d + 1)))
    fit = written(fit.select("grp", *(f"m{d}" for d in dims), *(
        (F.col(f"p{d}{e}") / F.col("n") - F.col(f"m{d}") * F.col(f"m{e}") + F.lit((FLOOR[d] * SCALE) ** 2 if d == e else 0.0)).alias(f"c{d}{e}")
        for d in dims for e in range(d + 1))))
    for d in dims:
        for e in range(d + 1):
            rest = F.col(f"c{d}{e}")
            for k in range(e):
                rest = rest - F.col(f"l{d}{k}") * F.col(f"l{e}{k}")
            least = (FLOOR[d] * SCALE / 10) ** 2
            fit = fit.withColumn(f"l{d}{e}", F.sqrt(F.greatest(rest, F.lit(least))) if d == e else rest / F.col(f"l{e}{e}"))
    return written(fit.drop(*(f"c{d}{e}" for d in dims for e in range(d + 1))))


def _distance(rows: DataFrame, fit: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with ``distance2``, the squared Mahalanobis distance by forward substitution."""
    out = rows.join(fit, "grp", how)
    for d, x in enumerate(STATISTICS):
        rest = F.col(x) - F.col(f"m{d}")
        for e in range(d):
            rest = rest - F.col(f"l{d}{e}") * F.col(f"y{e}")
        out = out.withColumn(f"y{d}", rest / F.col(f"l{d}{d}"))
    dims = range(len(STATISTICS))
    return out.withColumn("distance2", sum((F.col(f"y{d}") * F.col(f"y{d}") for d in dims), F.lit(0.0))).drop(
        *(c for c in out.columns if c[0] in "mly" and c[1:].isdigit()))


def judge(
    docs: DataFrame, core: float = 0.75, steps: int = 3, limit: float = 120.0, least_group: int = 50,
) -> DataFrame:
    """Counts and verdict per document.

    ``docs`` needs ``doc_id, text, lang, source``; other columns are ignored. Returns one row per input
    row: ``doc_id, _row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, distance2``. Estimates use the documents that pass the plain limits; a null language or
    source is a value of its own. Documents of a group under ``least_group`` are held against all documents of
    their language; where the language is smaller still, they have no estimate and stay (``distance2`` null).
    ``limit`` bounds the squared distance, in units in which each statistic's floor (``FLOOR``) is part
    of its variance.
    """
    measured = written(transformed(measure(docs)))
    passed = measured.filter(~F.col("base_failed")).select("_row", "lang", "source", *STATISTICS)
    name = F.to_json(F.struct(F.coalesce("lang", F.lit("\0")).alias("l"), F.coalesce("source", F.lit("\0")).alias("s")))
    pool = F.to_json(F.struct(F.coalesce("lang", F.lit("\0")).alias("l")))
    sizes = passed.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn(
        "all", F.sum("n").over(Window.partitionBy("lang"))).filter(F.col("all") >= least_group)
    small = F.col("n") < least_group
    # A language with a small group has an estimate of its own, from the rows of all its groups.
    sizes = written(sizes.select(
        F.col("lang").alias("_l"), F.col("source").alias("_s"), F.when(small, pool).otherwise(name).alias("grp"),
        F.when(F.max(small).over(Window.partitionBy("lang")), pool).alias("pool"), small.alias("small")))
    placed = written(passed.join(
        sizes, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    ).select("_row", "grp", "pool", "small", *STATISTICS))
    judged = placed.select("_row", "grp", *STATISTICS)
    rows = written(placed.filter("not small").select("_row", "grp", *STATISTICS).union(
        placed.filter("pool is not null").select("_row", F.col("pool").alias("grp"), *STATISTICS)))
    bin_ = SCALE // 64
    fit = written(_start(rows, bin_))
    for _ in range(steps):
        far = _distance(rows, fit).withColumn("value", F.floor(F.log2(F.col("distance2") + 1e-3) * 32).cast("long"))
        near = _quantile(far.select("grp", F.lit(0).alias("dim"), "value"), core).select("grp", F.col("value").alias("most"))
        fit = _fit(far.join(near, "grp").filter("value <= most"))
    verdict = _distance(judged, fit).select("_row", "distance2")
    return measured.join(verdict, "_row", "left").select(
        "doc_id", "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance2") <= limit, F.lit(True))).alias("kept"), "distance2")
