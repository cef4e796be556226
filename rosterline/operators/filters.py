"""Directory filters. Each is a Column; ``FilterSpec`` joins the ones that are set with AND."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from rosterline import fixed
from rosterline.functions.blanks import is_filled, is_true
from rosterline.functions.keywords import any_of

SEARCH_COLUMNS = (
    "org_name", "city", "mission_statement", "services_offered", "service_categories",
    "eligibility_requirements",
)
CONTACT_COLUMNS = ("phone", "email", "website")
Range = tuple[float, float | None]


def contains_text(value: Column, text: str, regex: bool = False) -> Column:
    """Case-insensitive contains; ``regex`` reads the text as a pattern."""
    if regex:
        return is_true(value.rlike("(?i)" + text))
    return is_true(F.contains(F.lower(value), F.lit(text.lower())))


def search(text: str, columns: Sequence[str] = SEARCH_COLUMNS, regex: bool = False) -> Column:
    return any_of([contains_text(F.col(c), text, regex) for c in columns])


def in_state(state: str, column: str = "state") -> Column:
    return is_true(F.upper(F.col(column)) == state.upper())


def in_range(value: Column, bounds: Range) -> Column:
    """Both ends belong to the range; null is outside."""
    low, high = bounds
    return is_true(value >= low if high is None else value.between(low, high))


def flag_is(value: Column, yes: bool) -> Column:
    """Null counts as not yes."""
    said_yes = is_true(value == "Yes")
    return said_yes if yes else ~said_yes


def has_any(columns: Sequence[str] = CONTACT_COLUMNS) -> Column:
    return any_of([is_filled(F.col(c)) for c in columns])


def needs_enrichment() -> Column:
    """A site is known, and the e-mail or one of two profiles is not."""
    missing = [F.col(c).isNull() for c in ("email", "facebook_url", "twitter_url")]
    return F.col("website").isNotNull() & any_of(missing)


@dataclass(frozen=True)
class FilterSpec:
    """Everything a user can ask for at once; what is left at its default does nothing."""

    text: str = ""
    tiers: Sequence[str] = ()
    states: Sequence[str] = ()
    city: str = ""
    zip_prefix: str = ""
    categories: Sequence[str] = ()
    org_types: Sequence[str] = ()
    revenue: str | Range | None = None
    employees: str | Range | None = None
    accredited: bool | None = None
    code_prefix: str = ""
    has_contact: bool = False
    min_score: float = 0.0
    regex: bool = False
    search_columns: Sequence[str] = field(default=SEARCH_COLUMNS)

    def condition(self, df: DataFrame) -> Column:
        columns = [c for c in self.search_columns if c in df.columns]
        contacts = [c for c in CONTACT_COLUMNS if c in df.columns]
        wanted: list[Column] = []
        if self.text:
            wanted.append(search(self.text, columns, self.regex))
        for name, values in (
            ("confidence_grade", self.tiers), ("state", self.states), ("org_type", self.org_types)
        ):
            if values:
                wanted.append(F.col(name).isin(*values))
        if self.city:
            wanted.append(contains_text(F.col("city"), self.city, self.regex))
        if self.zip_prefix:
            wanted.append(F.startswith(F.col("zip_code"), F.lit(self.zip_prefix)))
        if self.categories:
            wanted.append(any_of(
                [contains_text(F.col("service_categories"), c, self.regex) for c in self.categories]
            ))
        if self.code_prefix:
            wanted.append(F.startswith(F.col("ntee_code"), F.lit(self.code_prefix.upper())))
        if self.revenue is not None:
            wanted.append(in_range(F.col("total_revenue"), self._range(self.revenue, fixed.REVENUE_FILTERS)))
        if self.employees is not None:
            wanted.append(in_range(F.col("num_employees"), self._range(self.employees, fixed.EMPLOYEE_FILTERS)))
        if self.accredited is not None:
            wanted.append(flag_is(F.col("va_accredited"), self.accredited))
        if self.has_contact:
            wanted.append(has_any(contacts))
        if self.min_score > 0:
            wanted.append(F.col("confidence_score") >= self.min_score)
        return functools.reduce(operator.and_, wanted, F.lit(True))

    @staticmethod
    def _range(asked: str | Range, named: dict[str, Range]) -> Range:
        return named[asked] if isinstance(asked, str) else asked

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.condition(df))


def state_share(df: DataFrame, state: str) -> DataFrame:
    """Rows in a state, all rows, and the share in percent with one decimal."""
    counts = df.agg(F.count_if(in_state(state)).alias("matched"), F.count(F.lit(1)).alias("total"))
    share = F.bround(F.col("matched") / F.greatest("total", F.lit(1)) * 100, 1)
    return counts.withColumn("percent", share)


def lookup(df: DataFrame, key: str, value: str, order: str = "_ord") -> DataFrame:
    """The first row with this key."""
    return df.filter(F.col(key) == value).orderBy(order).limit(1)


def name_matches(
    df: DataFrame, text: str, limit: int = 20, column: str = "org_name", order: str = "_ord"
) -> DataFrame:
    """The first rows whose name holds the text, in row order."""
    return df.filter(contains_text(F.col(column), text)).orderBy(order).limit(limit)
