"""Stage outputs as Parquet: write once, read back on resume while inputs stay the same, skip or redo by choice."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterline.operators.coerce import ORDERED_SCHEMA, empty_records

# What a manifest says while its stage is being written.
UNFINISHED = ""


def fingerprint(inputs: Sequence[DataFrame], rule: str = "") -> str:
    """A digest of what a stage is made from.

    An input read from files counts by their names, lengths and times (no content is read), any other by
    its rows in any order. ``rule`` stands for the code and its parameters, and for what was done to an
    input after reading.
    """
    parts = [rule]
    for df in inputs:
        seen, files = df, df.inputFiles()
        if files:
            # The names are URIs, and a reader takes patterns.
            names = [re.sub(r"([][{}*?\\])", r"\\\1", unquote(f)) for f in files]
            seen = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(names).select(
                "path", "length", "modificationTime")
        row = F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")
        count, total = seen.agg(F.count(F.lit(1)), F.sum(row)).first()
        parts.append(f"{df.schema.simpleString()} {count} {total}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


@dataclass
class Stages:
    """Named stages below one folder all executors can reach.

    A stage in ``run`` (all by default) is computed and written, unless ``resume`` finds its
    output. A stage given its ``inputs`` leaves a manifest with their fingerprint and its ``rule``; on
    resume it is computed again when that differs, when there is none, or when writing was broken off. A
    stage made from another one's output therefore follows it. A stage not in ``run`` is read back as it
    is. When there is nothing to read, it gives what its ``otherwise`` gives (a skipped transform passes
    its input on), else no records with a row order; ``required`` stages then fail. ``clean`` ignores and
    overwrites earlier output.
    """

    spark: SparkSession
    folder: str
    run: Iterable[str] | None = None
    resume: bool = False
    clean: bool = False
    written: set[str] = field(default_factory=set)

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    def saved(self, name: str) -> DataFrame | None:
        if self.clean and name not in self.written:
            return None
        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException:
            return None

    def manifest(self, name: str) -> str | None:
        """The fingerprint a stage was written from."""
        try:
            first = self.spark.read.schema("fingerprint string").parquet(f"{self.path(name)}.manifest").first()
        except AnalysisException:
            return None
        return first and first["fingerprint"]

    def _note(self, name: str, text: str) -> None:
        one = self.spark.range(1).select(F.lit(text).alias("fingerprint"))
        one.write.mode("overwrite").parquet(f"{self.path(name)}.manifest")

    def stage(
        self, name: str, compute: Callable[[], DataFrame], required: bool = False,
        otherwise: Callable[[], DataFrame] | None = None, schema=ORDERED_SCHEMA,
        inputs: Sequence[DataFrame] | None = None, rule: str = "",
    ) -> DataFrame:
        wanted = self.run is None or name in self.run
        mark = fingerprint(inputs, rule) if wanted and inputs is not None else None
        earlier = self.saved(name) if self.resume or not wanted else None
        if earlier is not None and (mark is None or mark == self.manifest(name)):
            return earlier
        if not wanted:
            if required:
                raise LookupError(f"stage {name} is skipped and has no saved output")
            return otherwise() if otherwise is not None else empty_records(self.spark, schema)
        if mark is not None:
            self._note(name, UNFINISHED)
        compute().write.mode("overwrite").parquet(self.path(name))
        if mark is not None:
            self._note(name, mark)
        self.written.add(name)
        return self.spark.read.parquet(self.path(name))
