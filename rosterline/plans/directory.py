"""The whole way from landed sources to a finished directory, as one lazy plan per stage."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from rosterline.operators.classify import ClassifyRule, classify
from rosterline.operators.coerce import AFTER_BASE, coerce_schema, placed, tag_source
from rosterline.operators.enrich import enrich_from_pages
from rosterline.operators.filters import in_state
from rosterline.fixed import ENRICHED
from rosterline.operators.merge import digits, first_rows, merge_sources, update_back
from rosterline.operators.normalize import normalize_records
from rosterline.operators.resolve import deduplicate
from rosterline.operators.score import finish
from rosterline.sources.tabular import map_master
from rosterline.sources.stages import Stages



@dataclass(frozen=True)
class Inputs:
    """Landed tables. Keyed sources fill by key in their order; unkeyed ones are stacked."""

    master: DataFrame
    keyed: Mapping[str, DataFrame] = field(default_factory=dict)
    unkeyed: Mapping[str, DataFrame] = field(default_factory=dict)
    pages: DataFrame | None = None


def source_records(df: DataFrame, name: str, run_date: str) -> DataFrame:
    """Any source as canonical records with its name in the lineage."""
    return tag_source(coerce_schema(df, keep=("_ord",)), name, run_date)


def after_base(df: DataFrame, place: int) -> DataFrame:
    """Row numbers behind those of the base."""
    return df.withColumn("_ord", placed(F.col("_ord"), AFTER_BASE + place))


def base_records(master: DataFrame, run_date: str, rule: ClassifyRule = ClassifyRule()) -> DataFrame:
    """Classified master rows, the first row of each key, as canonical records."""
    kept = first_rows(classify(master, rule), "EIN")
    return source_records(map_master(kept), "irs_bmf", run_date)


def enrich_stage(merged: DataFrame, pages: DataFrame, state: str | None = None) -> DataFrame:
    """Fill from pages, for one state only when asked; the others stay as they are."""
    chosen = merged if state is None else merged.filter(in_state(state))
    enriched = enrich_from_pages(chosen, pages).drop("fields_updated")
    return enriched if state is None else update_back(merged, enriched, "_ord", ENRICHED)


def build_directory(
    inputs: Inputs,
    run_date: str,
    updated_at: str,
    state: str | None = None,
    skip_enrichment: bool = False,
    stages: Stages | None = None,
    rule: ClassifyRule = ClassifyRule(),
) -> DataFrame:
    """Classify, merge, resolve, enrich, normalise, score.

    Every input numbers its own rows in ``_ord``; stacked sources come after the base. With ``stages``
    each step is written and can be resumed from. A skipped source adds nothing; a skipped merge,
    resolution or enrichment passes on what came before it.
    """
    def step(name: str, compute, made_from, rule="", required: bool = False, otherwise=None) -> DataFrame:
        if stages is None:
            return compute()
        return stages.stage(name, compute, required, otherwise, inputs=made_from, rule=f"{name} {rule}")

    base = step("base", lambda: base_records(inputs.master, run_date, rule), [inputs.master], f"{run_date} {rule}", required=True)
    keyed = {
        n: step(n, lambda n=n, d=d: source_records(d, n, run_date), [d], run_date) for n, d in inputs.keyed.items()}
    others = {
        n: step(n, lambda n=n, d=d, i=i: after_base(source_records(d, n, run_date), i), [d], f"{run_date} {i}")
        for i, (n, d) in enumerate(inputs.unkeyed.items())
    }
    merged = step(
        "merged", lambda: merge_sources(base, keyed, others, key_normalizer=digits),
        [base, *keyed.values(), *others.values()], f"{[*keyed]} {[*others]}", otherwise=lambda: base)
    resolved = step(
        "resolved", lambda: deduplicate(merged, key_normalizer=digits), [merged], otherwise=lambda: merged)
    if inputs.pages is not None and not skip_enrichment:
        unfilled = resolved
        resolved = step(
            "enriched", lambda: enrich_stage(unfilled, inputs.pages, state), [unfilled, inputs.pages], f"{state}",
            otherwise=lambda: unfilled)
    return finish(normalize_records(resolved), updated_at)
