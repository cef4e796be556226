"""Mixing sources to target weights: random keys, range-sorted prefix sums, an exact cut per source.

Every document gets a key hashed from a seed and its id. Within a source, documents are dealt to
ranges of the key and sorted by key within a range; sums per range give each range its start, so the
running total of a source never passes through one task. The cut falls on the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterline.llm.common import SPACE, WORD, rows_of, whole_text, written

WEIGHTS = (5, 2, 1)


def words(text: Column | str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in code-point order (null last) take the weights in turn and share ``share`` times all
    words. A target stops at ``cap`` times its source; what it leaves is shared again by weight. This
    ends at one level: each target is the smaller of its cap and level x weight, and the level follows
    from sums over the sources in order of cap / weight.
    """
    order = F.col("source").asc_nulls_last()
    place = (F.row_number().over(Window.orderBy(order)) - 1) % len(weights)
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), place)
    by_ratio = Window.orderBy("ratio", order)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("whole", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("whole") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", order_key(), "level"))).over(Window.partitionBy())["level"])
        .select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))
    )


def order_key() -> Column:
    """The source as a struct field that sorts null last."""
    return F.struct(F.col("source").isNull(), F.col("source")).alias("source")


def spread(sized: DataFrame, ranges: int, range_rows: int) -> DataFrame:
    """``sized`` with the ``range`` of each key; a key of more rows than a range holds gets one per row.

    Ranges of hashed keys are equally full unless many rows share a key: missing or repeated ids. Only
    ranges far above the mean are searched for such keys, and a key is looked for among their rows.
    """
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / 2**32).cast("long")
    ranged = sized.withColumn("range", part)
    full = ranged.groupBy("range").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * range_rows).select("range")
    if full.isEmpty():
        return ranged
    hot = ranged.join(full, "range", "left_semi").groupBy("key").agg(F.count("*").alias("n")).filter(
        F.col("n") > range_rows).select(F.col("key").alias("_hot"))
    own = F.md5(F.concat_ws(":", "key", F.col("_row").cast("string")).cast("binary"))
    keyed = sized.join(hot, F.col("key") == F.col("_hot"), "left").withColumn(
        "key", F.when(F.col("_hot").isNull(), F.col("key")).otherwise(own)).drop("_hot")
    return written(keyed.withColumn("range", part))


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix",
    range_rows: int = 10_000, row: str | None = None,
) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` needs ``doc_id, text, source`` (``row``: see ``rows_of``); other columns are ignored. Returns
    one row per input row: ``doc_id, _row, size, source_size, target, taken``. A source takes
    ``floor(target)`` words: whole passes over the source, then its documents in key order, the last
    one in part. Null text has no words, a null source is a source of its own. Null ids share a key, and so
    do repeated ones; rows of a key that has more than ``range_rows`` get a key each. An empty table gives an
    empty result.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = written(rows_of(docs, "doc_id", "source", words().alias("size"), key.alias("key"), row=row))
    ranges = max(1, -(-sized.count() // range_rows))
    sized = spread(sized, ranges, range_rows)
    per_range = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    per_source = per_range.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        F.col("source").alias("_source"), F.col("range").alias("_range"),
        F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("start"))
    goal = targets(per_source, weights, share, cap).withColumnRenamed("source", "_of")
    starts = written(
        starts.join(goal, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
        .withColumn("budget", F.floor("target").cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size")))
    before = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("start") - F.coalesce(F.sum("size").over(before), F.lit(0))
    return (
        sized.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
        .withColumn("left", left)
        .select(
            "doc_id", "_row", "size", "source_size", "target",
            (F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least("size", "left"))).cast("long").alias("taken"))
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, the cut one shortened.

    Columns stay as they are; in a shortened row ``text`` ends after its last taken word and
    ``n_chars``, where present, is that text's length. Documents without words are not taken.
    """
    # The whole row travels as one value, so that no column name can clash.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "source", "text",
        F.monotonically_increasing_id().alias("row"))
    taken = mix(rows, row="row", **options).filter("taken > 0").select(F.col("_row").alias("row"), "size", "taken")
    passes = F.explode(F.sequence(F.lit(1).cast("long"), F.expr("(taken + size - 1) div size")))
    rest = F.col("taken") - (F.col("turn") - 1) * F.col("size")
    pieces = F.regexp_extract_all("text", F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    cut = F.when(rest >= F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), F.greatest(rest, F.lit(1)).cast("int")), ""))
    out = rows.join(taken, "row").withColumn("turn", passes).withColumn("text", cut)
    doc = F.col("doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(doc.alias("doc")).select(*(F.col(f"doc.`{c}`") for c in docs.columns))
