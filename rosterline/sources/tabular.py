"""CSV sources: the master file in parts, the finished directory, bulk filing extracts."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rosterline import fixed
from rosterline.functions.blanks import strip, to_number
from rosterline.functions.clean import code_label, title_case
from rosterline.operators.coerce import PLACE_BITS, numbers_from_text, rename_first_alias


def files_of(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """``(file, bytes)`` below each path in turn, by name, without hidden and empty files; a file is itself."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    out: list[tuple[str, int]] = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(conf)
        if not system.getFileStatus(where).isDirectory():
            out.append((path, system.getFileStatus(where).getLen()))
            continue
        found, below, top = [], system.listFiles(where, True), system.makeQualified(where).toString().rstrip("/")
        while below.hasNext():
            status = below.next()
            name = status.getPath().toString()
            if not any(part[:1] in ("_", ".") for part in name[len(top) + 1:].split("/")):
                found.append((name, status.getLen()))
        out += sorted(found)
    return [(name, size) for name, size in out if size]


def _header(spark: SparkSession, path: str, encoding: str) -> tuple[str, ...] | None:
    """The names in a file's first line that is not blank, trimmed and in upper case."""
    java = spark._jvm
    where = java.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    stream = where.getFileSystem(conf).open(where)
    codec = java.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    lines = java.java.io.BufferedReader(java.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, encoding))
    try:
        line = lines.readLine()
        while line is not None and not line.strip("\ufeff \t"):
            line = lines.readLine()
    finally:
        lines.close()
    return None if line is None else tuple(c.strip().upper() for c in next(csv.reader([line.lstrip("\ufeff")])))


# The scan's own file path and the listed one differ in the slashes after the scheme and in escapes.
def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^([a-zA-Z0-9+.-]+):/+", "$1:/")


def read_text_csv(
    spark: SparkSession, paths: Sequence[str], encoding: str = "ISO-8859-1", multi_line: bool = False
) -> DataFrame:
    """CSV files with headers, every column as text, stacked by trimmed upper-case column name.

    Files may differ in columns and their order; those with the same header are one scan, so any number
    of files makes as many scans as there are headers. ``_ord`` numbers the rows file by file, in the
    order of ``paths`` and of the names below a folder, since Spark itself deals files out by size. It holds
    the number of the row's block among all blocks of all files, and the row's place in its task.
    """
    files = files_of(spark, paths)
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: _header(spark, f[0], encoding), files))
    # No split is smaller than this, so two splits of a file never share a block number.
    least = min(_bytes(spark, "spark.sql.files.maxPartitionBytes"), _bytes(spark, "spark.sql.files.openCostInBytes"))
    before, places, groups = 0, [], {}
    for (path, size), header in zip(files, headers):
        if header is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            full = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toUri().toString()
            places.append((full, before))
            groups.setdefault(header, []).append(path)
            before += size // least + 1
    if not groups:
        raise ValueError(f"no rows and no header in {list(paths)}")
    room = PLACE_BITS - before.bit_length()
    listed = spark.createDataFrame(places, "_file string, _before long").select(_plain_path(F.col("_file")).alias("_file"), "_before")
    parts = []
    for header, own in groups.items():
        scan = (
            spark.read.schema(StructType([StructField(c, StringType()) for c in header])).option("header", True)
            .option("encoding", encoding).option("escape", '"').option("multiLine", multi_line).csv(own))
        rows = scan.select(
            *[F.col(f"`{c}`") for c in header], _plain_path(F.col("_metadata.file_path")).alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row"))
        row = F.when(F.col("_row") < (1 << room), F.col("_row")).otherwise(F.raise_error(F.lit("too many rows in one task")).cast("long"))
        block = F.col("_before") + F.floor(F.col("_start") / least)
        # The files' table is given in code, so Spark knows its size.
        parts.append(rows.join(listed, "_file").select(*[F.col(f"`{c}`") for c in header], (block * (1 << room) + row).alias("_ord")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _bytes(spark: SparkSession, setting: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))


def map_master(df: DataFrame, zip_length: int | None = None) -> DataFrame:
    """Master file columns to the canonical record; ``zip_length`` keeps so many characters of the ZIP."""
    short = (lambda z: z) if zip_length is None else (lambda z: F.substring(z, 1, zip_length))
    text = lambda c: strip(F.col(c)) if c in df.columns else F.lit(None).cast("string")
    subsection = text("SUBSECTION")
    other = F.concat(F.lit("501(c)("), subsection, F.lit(")"))
    return df.select(
        "_ord",
        title_case(text("NAME")).alias("org_name"),
        title_case(text("SORT_NAME")).alias("org_name_alt"),
        text("EIN").alias("ein"),
        title_case(text("STREET")).alias("street_address"),
        title_case(text("CITY")).alias("city"),
        F.upper(text("STATE")).alias("state"),
        short(text("ZIP")).alias("zip_code"),
        F.lit("US").alias("country"),
        text("NTEE_CD").alias("ntee_code"),
        subsection.alias("irs_subsection"),
        text("FILING_REQ_CD").alias("irs_filing_requirement"),
        text("RULING").alias("ruling_date"),
        text("ACCT_PD").alias("fiscal_year_end"),
        to_number(text("ASSET_AMT")).alias("total_assets"),
        to_number(text("REVENUE_AMT")).alias("total_revenue"),
        code_label(subsection, fixed.SUBSECTION_LABELS, other).alias("org_type"),
        code_label(text("STATUS"), fixed.STATUS_LABELS).alias("tax_exempt_status"),
    )


def map_filings(df: DataFrame) -> DataFrame:
    """A bulk filing extract to canonical names, by the first alias each column goes by."""
    return rename_first_alias(df, {"_ord": ("_ord",), **fixed.FILING_ALIASES})


def read_directory(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A finished directory: text columns, the known numeric ones as numbers.

    ``multi_line`` allows line breaks in cells, at the price of one task per file.
    """
    df = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        .option("inferSchema", False).csv(path)
    )
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return numbers_from_text(df)
