"""Three ways into the directory (code, subsection, words in the name) and one way out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rosterline import fixed
from rosterline.functions.blanks import is_true, strip
from rosterline.functions.keywords import matches_any


@dataclass(frozen=True)
class ClassifyRule:
    name: str = "NAME"
    code: str = "NTEE_CD"
    subsection: str = "SUBSECTION"
    code_prefix: str = fixed.CODE_PREFIX
    subsection_value: str = fixed.SUBSECTION
    include: Sequence[str] = fixed.INCLUDE_KEYWORDS
    exclude: Sequence[str] = fixed.EXCLUDE_KEYWORDS
    word_boundary: bool = False

    def by_code(self) -> Column:
        """Prefix of the untrimmed code, so a leading space is no match."""
        return is_true(F.startswith(F.col(self.code), F.lit(self.code_prefix)))

    def by_subsection(self) -> Column:
        return is_true(strip(F.col(self.subsection)) == self.subsection_value)

    def by_keyword(self) -> Column:
        return matches_any(F.col(self.name), self.include, word_boundary=self.word_boundary)

    def included(self) -> Column:
        return self.by_code() | self.by_subsection() | self.by_keyword()

    def excluded(self) -> Column:
        """An excluded phrase wins over all three ways in."""
        return matches_any(F.col(self.name), self.exclude, word_boundary=self.word_boundary)


def classify(df: DataFrame, rule: ClassifyRule = ClassifyRule()) -> DataFrame:
    return df.filter(rule.included() & ~rule.excluded())


def classify_counts(df: DataFrame, rule: ClassifyRule = ClassifyRule()) -> DataFrame:
    """Rows per way in, rows excluded and rows kept, from one scan."""
    hit = df.select(
        rule.by_code().alias("code"), rule.by_subsection().alias("subsection"),
        rule.by_keyword().alias("keyword"), rule.excluded().alias("out"),
    )
    into = F.col("code") | F.col("subsection") | F.col("keyword")
    return hit.agg(
        F.count_if("code").alias("by_code"), F.count_if("subsection").alias("by_subsection"),
        F.count_if("keyword").alias("by_keyword"), F.count_if(into & F.col("out")).alias("excluded"),
        F.count_if(into & ~F.col("out")).alias("kept"),
    )
