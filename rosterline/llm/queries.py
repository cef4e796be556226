"""The operators of this folder as queries over the supplied tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterline.catalog.registry import table
from rosterline.llm import (
    centroids, chats, exact, huffman, language, mixing, neardup, outliers, packing, prefixes, quality, suffixes, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query("op6_mixing", """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS whole
  FROM per_source),
levels AS (
  SELECT *, cap / weight AS ratio,
         (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM weighed),
goals AS (
  SELECT source, source_size,
         least(cap, (SELECT level FROM levels WHERE level <= ratio ORDER BY place LIMIT 1) * weight) AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM goals),
cut AS (
  SELECT doc_id, size, source_size, target, passes,
         CAST(floor(target) AS BIGINT) - passes * source_size
           - coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM sized JOIN budgets ON sized.source IS NOT DISTINCT FROM budgets.source)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, left_over)) AS BIGINT) AS taken
FROM cut""")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("_row")


@query("op7_exact_dedup", """
WITH read AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
FROM read WINDOW best AS (PARTITION BY body ORDER BY chars DESC, doc_id)""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.group_equal(table(spark, sf_dir, "documents")).drop("_row")


@query("op8_chat_format", """
WITH unique_turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
chats AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said
  FROM unique_turns GROUP BY conv_id),
first AS (SELECT said, min(conv_id) AS conv_id FROM chats GROUP BY said),
prefixes AS (SELECT DISTINCT said[1:n] AS said FROM first, unnest(range(1, len(said))) AS u(n))
SELECT conv_id, len(said) AS n_turns,
       array_to_string(list_transform(said, lambda x: '<|' || coalesce(x.r, 'unknown') || '|>' || chr(10) || coalesce(x.t, '') || chr(10)), '') AS text
FROM first ANTI JOIN prefixes USING (said)""")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render(table(spark, sf_dir, "conversations"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents")).drop("_row")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("_row")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("_row")


@query("op5_minhash")
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_near(table(spark, sf_dir, "documents")).drop("_row", "first")


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """The plain double loop over vectors and centroids, one pair of tables a round."""
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""]
    for t in range(rounds + 1):
        parts.append(f"""
a{t} AS MATERIALIZED (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(kept.v, c{t}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS m
  FROM kept, c{t} GROUP BY r)""")
        if t < rounds:
            parts.append(f"""
s{t} AS MATERIALIZED (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
  FROM (SELECT m.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{t} JOIN kept USING (r), range(1, 65) AS u(i) GROUP BY m.c, i)
  GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT c, coalesce(s{t}.v, c{t}.v) AS v FROM c{t} LEFT JOIN s{t} USING (c))""")
    return ",".join(parts) + f"""
SELECT vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c = m.c"""


@query("op11_centroids", _cluster_sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_huffman_ids")
def op12_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.through_files(table(spark, sf_dir, "documents")).drop("_row")


@query("op13_prefix_trie", """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, left(sha256(length(role) || ':' || role || text), 32)) AS said
  FROM said GROUP BY conv_id),
heads AS (
  SELECT conv_id, said,
         -- CRC-32 of the decimal digits: eight shifts a byte
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1),
           lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM own),
rebuilt AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(b.said, [])[1:c.h], c.said[c.h + 1:]) AS said
  FROM heads AS c LEFT JOIN own AS b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (SELECT conv_id, d, said[1:d] AS path, len(said) = d AS ends FROM rebuilt, unnest(range(0, len(said) + 1)) AS u(d)),
nodes AS MATERIALIZED (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(path[d]).t, '[^\\x20\\x09-\\x0D]+')), 0) AS saved
  FROM prefixes GROUP BY path),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
subtrees AS (
  SELECT n.path[1:d] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (children.n IS NULL) AS n_leaves
  FROM nodes AS n LEFT JOIN children ON children.path = n.path, unnest(range(0, n.depth + 1)) AS u(d) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(children.n, 0) AS n_children,
       n_leaves, saved_tokens, n.ends_sha256
FROM nodes AS n JOIN subtrees ON subtrees.path = n.path LEFT JOIN children ON children.path = n.path
LEFT JOIN nodes AS p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))
