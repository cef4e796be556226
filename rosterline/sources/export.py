"""Sinks: the directory, one table per view, text reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from rosterline import fixed
from rosterline.operators.coerce import pick_columns
from rosterline.operators.score import in_output_order
from rosterline.plans.views import report_lines

BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV files with a header each; ``bom`` puts the UTF-8 mark in front of every header."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_directory(df: DataFrame, path: str, bom: bool = True) -> None:
    """The canonical columns, sorted by state and name across the files."""
    ordered = in_output_order(df)
    write_csv(pick_columns(ordered, [n for n, _ in fixed.COLUMNS]), path, bom)


def write_views(views: Mapping[str, DataFrame], folder: str, bom: bool = True) -> None:
    for name, view in views.items():
        write_csv(view.drop("_ord"), f"{folder.rstrip('/')}/{name}", bom)


def write_report(report: DataFrame, path: str) -> None:
    """A report has a few dozen lines, so one file holds it."""
    report_lines(report).coalesce(1).write.mode("overwrite").text(path)
