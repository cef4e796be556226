"""Entity resolution in three tiers, and the record that a group of duplicates becomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rosterline.functions.blanks import none_if_empty
from rosterline.functions.clean import web_domain
from rosterline.operators.merge import spread_null_key
from rosterline.operators.similarity import cluster_names, sorted_words
from rosterline.session import cut_lineage


def merge_group(
    df: DataFrame, by: str, order: str = "_ord", lineage: str | None = "data_sources"
) -> DataFrame:
    """One record per value of ``by``: in each column the first non-null value in row order.

    An empty text is a value here. Lineage lists unite to a sorted set, except in groups of one,
    which stay as they are. The record's place is that of its first member. Every aggregate
    combines before the shuffle, so a group may hold any share of the rows.
    """
    values = [c for c in df.columns if c not in (by, order, lineage)]
    first = [
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values
    ]
    extra = []
    if lineage is not None:
        entries = F.array_distinct(F.flatten(F.collect_set(F.split(F.col(lineage), ";"))))
        united = F.array_join(F.array_remove(F.sort_array(entries), ""), ";")
        extra = [
            F.when(F.count(F.lit(1)) == 1, F.min(F.col(lineage))).otherwise(united).alias(lineage)
        ]
    merged = df.groupBy(by).agg(F.min(order).alias(order), *first, *extra)
    return merged.select(*[c for c in df.columns])


def merge_members(
    df: DataFrame, by: str, members: DataFrame, on: str, order: str = "_ord", lineage: str | None = "data_sources"
) -> DataFrame:
    """Merge the rows whose ``on`` is in ``members`` by their ``by``; all others pass through untouched.

    ``members`` is narrow and written, so Spark knows its size. Where it is small it goes to the rows and
    only rows that have a duplicate are shuffled; else each row is shuffled once, by ``on``. A row whose
    ``on`` is null has no duplicate and gets a spread key, so that such rows are not dealt to one task.
    """
    columns = [c for c in df.columns if c not in (by, on) or c == order]
    rows = df.withColumn(on, spread_null_key(F.col(on), F.col(order))) if on == by else df
    marked = rows.join(members.withColumn("_many", F.lit(True)), on, "left")
    many = merge_group(marked.filter("_many").select(by, *columns), by, order, lineage)
    return marked.filter("_many is null").select(*columns).unionByName(many.select(*columns))


def merge_on(df: DataFrame, key: Column, order: str = "_ord", **options) -> DataFrame:
    """Merge rows with the same key; rows whose key is null or empty stay as they are.

    Keys with two or more rows are found first, on the key alone.
    """
    keyed = df.withColumn("_group", none_if_empty(key.cast("string")))
    shared = keyed.select("_group").filter("_group is not null").groupBy("_group").agg(F.count("*").alias("n")).filter("n > 1")
    return merge_members(keyed, "_group", cut_lineage(shared.select("_group")), "_group", order, **options).select(*df.columns)


def merge_exact(df: DataFrame, key: str = "ein", key_normalizer=None, **options) -> DataFrame:
    """Tier 1: same key."""
    value = F.col(key)
    return merge_on(df, key_normalizer(value) if key_normalizer else value, **options)


def block_names(
    df: DataFrame, name: str = "org_name", block: Sequence[str] = ("state", "city"), order: str = "_ord"
) -> DataFrame:
    """Rows that can be compared, with their block and word-sorted name."""
    needed = [*block, name]
    present = df.dropna(subset=needed)
    return present.select(
        F.col(order).alias("ord"),
        F.concat_ws("|", *[F.upper(F.col(c)) for c in block]).alias("block"),
        sorted_words(F.col(name)).alias("name"),
    )


def fuzzy_clusters(
    df: DataFrame, name: str = "org_name", block: Sequence[str] = ("state", "city"),
    threshold: float = 85.0, order: str = "_ord", **limits,
) -> DataFrame:
    """``(ord, cluster)`` for rows that share a cluster with an earlier row or start one by a copy.

    Copies of a name inside a block collapse first: whatever takes the first copy takes the
    others, and else the first copy does.
    """
    rows = block_names(df, name, block, order)
    names = cut_lineage(
        rows.groupBy("block", "name").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("copies"))
    )
    taken = cluster_names(names.select("block", "name", "ord"), threshold, **limits)
    homes = (
        names.join(taken, "ord", "left")
        .filter(F.col("anchor").isNotNull() | (F.col("copies") > 1))
        .select("block", "name", F.coalesce("anchor", "ord").alias("cluster"))
    )
    return rows.join(homes, ["block", "name"]).select("ord", "cluster")


def merge_fuzzy(
    df: DataFrame, name: str = "org_name", block: Sequence[str] = ("state", "city"),
    threshold: float = 85.0, order: str = "_ord", lineage: str | None = "data_sources", **limits,
) -> DataFrame:
    """Tier 2: similar names within a place. Rows without name or place stay as they are."""
    clusters = fuzzy_clusters(df, name, block, threshold, order, **limits)
    # A cluster's first row is named by the others only.
    members = clusters.union(clusters.select("cluster", "cluster")).distinct().withColumnRenamed("ord", order)
    return merge_members(df, "cluster", cut_lineage(members), order, order, lineage).select(*df.columns)


def merge_domain(
    df: DataFrame, url: str = "website", shared_domains: Sequence[str] = (),
    drop_unparseable: bool = False, order: str = "_ord", **options,
) -> DataFrame:
    """Tier 3: same web domain.

    ``shared_domains`` lists hosts many organisations use, which say nothing about identity.
    ``drop_unparseable`` leaves out rows whose address has no host; by default they stay.
    """
    domain = web_domain(F.col(url))
    if drop_unparseable:
        df = df.filter(F.col(url).isNull() | (F.col(url) == "") | (domain != ""))
    if shared_domains:
        domain = F.when(~domain.isin(*shared_domains), domain)
    return merge_on(df, domain, order, **options)


def deduplicate(df: DataFrame, shared_domains: Sequence[str] = (), key_normalizer=None, **limits) -> DataFrame:
    """The three tiers in order.

    The rows after tier 1 are used more than once, so they are written to the checkpoint folder.
    """
    exact = cut_lineage(merge_exact(df, key_normalizer=key_normalizer))
    return merge_domain(merge_fuzzy(exact, **limits), shared_domains=shared_domains)


def tier_counts(df: DataFrame, **limits) -> DataFrame:
    """Rows at the start and after each tier."""
    exact = cut_lineage(merge_exact(df))
    fuzzy = cut_lineage(merge_fuzzy(exact, **limits))
    stages = (("start", df), ("exact", exact), ("fuzzy", fuzzy), ("domain", merge_domain(fuzzy)))
    counts = [
        stage.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tier"), "rows")
        for name, stage in stages
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result
