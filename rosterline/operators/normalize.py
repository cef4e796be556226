"""All normalisers over a canonical table, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterline.functions import clean

RULES = {
    "ein": clean.normalize_key,
    "phone": clean.normalize_phone,
    "website": clean.normalize_url,
    "state": clean.normalize_state,
    "zip_code": clean.normalize_zip,
    "org_name": clean.normalize_name,
    "facebook_url": clean.normalize_url,
    "twitter_url": clean.normalize_url,
    "linkedin_url": clean.normalize_url,
    "instagram_url": clean.normalize_url,
    "youtube_url": clean.normalize_url,
    "email": clean.normalize_email,
}


def normalize_records(df: DataFrame, country: str = "US") -> DataFrame:
    """Normalise the columns the table has; a missing country becomes the default."""
    changed: dict[str, Column] = {c: f(F.col(c)) for c, f in RULES.items() if c in df.columns}
    known = F.col("country") if "country" in df.columns else F.lit(None).cast("string")
    return df.withColumns({**changed, "country": F.coalesce(known, F.lit(country))})
