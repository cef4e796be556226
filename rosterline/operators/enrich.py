"""Contact details from landed search results and landed pages. Nothing is fetched here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rosterline import fixed
from rosterline.functions import contact
from rosterline.functions.blanks import let, none_if_empty
from rosterline.functions.clean import web_host
from rosterline.functions.keywords import any_of
from rosterline.operators.filters import needs_enrichment
from rosterline.operators.merge import fill_back, spread_null_key

SOCIAL = tuple(fixed.SOCIAL_PATTERNS)
FOUND = ("website", "phone", "email", "mission_statement", *SOCIAL)


def listed_domain(url: Column, domains: Sequence[str], substring: bool = False) -> Column:
    """Whether the host is one of the domains or below it; ``substring`` looks anywhere in the host."""
    def listed(host: Column) -> Column:
        if substring:
            return contact.contains_any(host, domains)
        return host.isin(*domains) | any_of([F.endswith(host, F.lit("." + d)) for d in domains])

    return let(F.replace(web_host(url), F.lit("www."), F.lit("")), listed)


def evidence_from_results(
    results: DataFrame,
    key: str = "ein",
    rank: str = "rank",
    skip_domains: Sequence[str] = fixed.SKIP_DOMAINS,
    skip_email: Sequence[str] = fixed.SKIP_EMAIL_PARTS,
    skip_social: Sequence[str] = fixed.SKIP_SOCIAL_PARTS,
    patterns: Mapping[str, str] = fixed.SOCIAL_PATTERNS,
    substring_domains: bool = False,
) -> DataFrame:
    """Per key the best-ranked site, phone, e-mail and profiles; columns ``key, url, title, snippet``.

    Each result's text offers its first e-mail only. One aggregate that combines before the
    shuffle, however many results a key has.
    """
    text = F.concat(F.coalesce("snippet", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))
    site_ok = ~F.coalesce(listed_domain(F.col("url"), skip_domains, substring_domains), F.lit(False))

    def usable_mail(mail: Column) -> Column:
        return let(F.lower(mail), lambda e: F.when(contact.acceptable_email(e, parts=skip_email), mail))

    def usable_profile(url: Column) -> Column:
        return F.when(contact.usable_profile(url, skip_social), F.rtrim(url, F.lit("/")))

    found = {
        "website": F.when(site_ok, none_if_empty(F.col("url"))),
        "phone": contact.first_phone(text),
        "email": F.when(F.contains(text, F.lit("@")), let(contact.first_match(text, fixed.EMAIL_PATTERN), usable_mail)),
        **{n: let(contact.first_match(F.col("url"), p), usable_profile) for n, p in patterns.items()},
    }
    rows = results.select(key, rank, *[c.alias(n) for n, c in found.items()])
    best = [F.min_by(F.col(n), F.when(F.col(n).isNotNull(), F.col(rank))).alias(n) for n in found]
    return rows.groupBy(key).agg(*best)


def answered(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("status") == 200) if "status" in pages.columns else pages


def site_details(
    pages: DataFrame,
    skip_email: Sequence[str] = fixed.SKIP_EMAIL_PARTS,
    skip_social: Sequence[str] = fixed.SKIP_SOCIAL_PARTS,
    patterns: Mapping[str, str] = fixed.SOCIAL_PATTERNS,
    keep: Sequence[str] = ("url",),
    mission_limit: int | None = None,
) -> DataFrame:
    """Phone, e-mail (``mailto:`` first), profiles and mission of each answered page."""
    html, hrefs = F.col("html"), F.col("_links")
    linked = answered(pages).withColumn("_links", contact.links(html))
    return linked.select(
        *keep,
        contact.first_phone(html).alias("phone"),
        contact.site_email(html, hrefs, skip_email).alias("email"),
        *contact.social_urls(html, hrefs, patterns, skip_social),
        contact.meta_content(html, limit=mission_limit).alias("mission_statement"),
    )


def page_details(pages: DataFrame, keep: Sequence[str] = ("url",), mission_limit: int | None = None) -> DataFrame:
    """Profiles, e-mail and mission of each answered page, without the share-link rules."""
    html, hrefs = F.col("html"), F.col("_links")
    linked = answered(pages).withColumn("_links", contact.links(html))
    return linked.select(
        *keep, *contact.social_urls(html, hrefs), contact.first_email(html).alias("email"),
        contact.meta_content(html, limit=mission_limit).alias("mission_statement"),
    )


def one_per(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the same one on every run."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")


def combine_evidence(evidence: DataFrame, details: DataFrame, key: str = "ein") -> DataFrame:
    """Result evidence wins, the chosen site's page fills what it left open."""
    pages = one_per(details.select(
        F.col("url").alias("website"), *[F.col(c).alias(f"_site_{c}") for c in ("phone", "email", *SOCIAL)],
        "mission_statement",
    ), "website")
    site = pages.withColumnRenamed("website", "_k")
    joined = evidence.withColumn("_k", spread_null_key(F.col("website"), F.col(key))).join(site, "_k", "left")
    return joined.select(
        key, "website",
        *[F.coalesce(none_if_empty(F.col(c)), F.col(f"_site_{c}")).alias(c) for c in ("phone", "email", *SOCIAL)],
        "mission_statement",
    )


def enrich_from_results(df: DataFrame, results: DataFrame, pages: DataFrame, key: str = "ein") -> DataFrame:
    """Records with their blanks filled from results and pages; ``fields_updated`` counts cells."""
    evidence = evidence_from_results(results, key)
    chosen = pages.join(evidence.select(F.col("website").alias("url")), "url", "left_semi")
    return fill_back(df, combine_evidence(evidence, site_details(chosen), key), key, FOUND)


def enrich_from_pages(df: DataFrame, pages: DataFrame, order: str = "_ord") -> DataFrame:
    """Records that need it get their nulls filled from the page of their own website."""
    columns = ("email", "mission_statement", *SOCIAL)
    needy = df.filter(needs_enrichment()).select(order, "website")
    # Patterns run over the pages that are asked for, not over all.
    chosen = pages.join(needy.select(F.col("website").alias("url")), "url", "left_semi")
    details = page_details(chosen).withColumnRenamed("url", "website")
    found = needy.join(one_per(details, "website"), "website").drop("website")
    return fill_back(df, found, order, columns, empty_is_missing=False)
