"""Master files that keep arriving: the same classify and score plan over a file stream.

This is an addition for operation; a run takes what is new and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rosterline.operators.classify import ClassifyRule, classify
from rosterline.operators.coerce import coerce_schema, tag_source
from rosterline.operators.normalize import normalize_records
from rosterline.operators.score import finish
from rosterline.sources.tabular import map_master


def arriving_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Parquet files of master rows as they land; ``_ord`` is the hash of the row's key and name."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("_ord", F.xxhash64("EIN", "NAME"))


def scored_stream(
    rows: DataFrame, run_date: str, updated_at: str, rule: ClassifyRule = ClassifyRule()
) -> DataFrame:
    """Per-row work only, so the stream keeps no state."""
    records = coerce_schema(map_master(classify(rows, rule)), keep=("_ord",))
    return finish(normalize_records(tag_source(records, "irs_bmf", run_date)), updated_at)


def append_new(scored: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived since the last run, then stop."""
    return (
        scored.writeStream.format("parquet").option("path", output)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
