"""Normalisers for keys, phones, addresses, names and amounts. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from rosterline import fixed
from rosterline.functions.blanks import let, none_if_empty, strip
from rosterline.functions.keywords import any_of, shortest_words

CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"
UNCASED = r"[^\p{Lu}\p{Ll}\p{Lt}]"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def code_label(code: Column, labels: Mapping[str, str], otherwise: Column | None = None) -> Column:
    """Label of a code from a small fixed table, else ``otherwise`` (null when not given)."""
    pairs = [F.lit(text) for pair in labels.items() for text in pair]
    found = F.try_element_at(F.create_map(*pairs), code)
    return found if otherwise is None else F.coalesce(found, otherwise)


def normalize_key(value: Column) -> Column:
    """Nine digits as ``dd-ddddddd``; anything else is null."""
    d = digits(value)
    return F.when(F.length(d) == 9, F.concat(F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 7)))


def normalize_phone(value: Column) -> Column:
    """Ten digits (or eleven led by 1) as ``(ddd) ddd-dddd``; anything else is null."""
    ten = none_if_empty(F.regexp_extract(digits(value), "^1?([0-9]{10})$", 1))
    return F.regexp_replace(ten, "^(...)(...)(....)$", r"($1) $2-$3")


def normalize_zip(value: Column) -> Column:
    """``ddddd`` or ``ddddd-dddd``; fewer than five characters give null."""

    def shaped(kept: Column) -> Column:
        base = F.substring(kept, 1, 5)
        tail = F.ltrim(F.substr(kept, F.lit(6)), F.lit("-"))
        long = F.when(F.length(tail) == 4, F.concat(base, F.lit("-"), tail)).otherwise(base)
        return F.when(F.length(kept) >= 5, long)

    return let(F.regexp_replace(value, "[^0-9-]", ""), shaped)


def normalize_state(value: Column) -> Column:
    """Two-letter codes pass through upper-cased; full names are looked up."""
    v = F.upper(strip(value))
    return F.when(F.length(v) == 2, v).otherwise(code_label(v, fixed.STATE_CODES_BY_NAME))


def normalize_email(value: Column) -> Column:
    return F.lower(strip(value))


def _web_text(value: Column) -> Column:
    """Trimmed, with line breaks and tabs taken out as URL readers do."""
    breaks = lambda text: any_of([F.contains(text, F.lit(ch)) for ch in "\t\r\n"])
    return let(strip(value), lambda text: F.when(
        breaks(text), F.regexp_replace(text, r"[\t\r\n]", "")).otherwise(text))


def _unbalanced_brackets(host: Column) -> Column:
    return F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))


def normalize_url(value: Column) -> Column:
    """Scheme added when missing, host lower-cased; params, query, fragment and last ``/`` cut."""

    def with_scheme(text: Column) -> Column:
        known = F.startswith(text, F.lit("http://")) | F.startswith(text, F.lit("https://"))
        full = F.when(known, text).when(text != "", F.concat(F.lit("https://"), text))
        return F.regexp_extract(full, "^[^?#]*", 0)

    def rebuilt(url: Column) -> Column:
        def joined(site: Column) -> Column:
            host = F.substring_index(site, "//", -1)
            path = F.substring(url, F.length(site) + 1, F.length(url))
            path = F.when(
                F.contains(url, F.lit(";")), F.regexp_replace(path, r"^((?:.*/)?[^/;]*);[^/]*$", "$1")
            ).otherwise(path)
            # Schemes are lower-case by now, so lower-casing the site touches the host only.
            whole = F.rtrim(F.concat(F.lower(site), path), F.lit("/"))
            return F.when((host != "") & ~_unbalanced_brackets(host), whole)

        return let(F.substring_index(url, "/", 3), joined)

    return let(let(_web_text(value), with_scheme), rebuilt)


def web_host(value: Column) -> Column:
    """Lower-cased network location; empty when the text has no ``//`` part, null for null."""
    host = F.regexp_extract(_web_text(value), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return let(host, lambda h: F.when(_unbalanced_brackets(h), F.lit("")).otherwise(F.lower(h)))


def web_domain(value: Column) -> Column:
    """Network location without one leading ``www.``; ports are kept."""
    return F.regexp_replace(web_host(value), r"^www\.", "")


def title_case(value: Column) -> Column:
    """A capital after every character that is not a cased letter, as in ``O'Neil'S``.

    Plain words between spaces need only ``initcap``, which is much cheaper.
    """

    def titled(text: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit(f"({CASED}+|{UNCASED}+)"), F.lit(1))
        other = text.rlike("[^A-Za-z ]")
        return F.when(other, F.array_join(F.transform(runs, F.initcap), "")).otherwise(F.initcap(text))

    return let(value if isinstance(value, Column) else F.col(value), titled)


def normalize_name(value: Column, acronyms: Sequence[str] = fixed.NAME_ACRONYMS) -> Column:
    """Title case with single spaces; known acronyms stay upper-case as whole words."""
    parts = shortest_words(acronyms)

    def raised(name: Column) -> Column:
        words = F.transform(
            F.split(name, " "), lambda w: F.when(F.upper(w).isin(*acronyms), F.upper(w)).otherwise(w)
        )
        lowered = F.lower(name)
        maybe = any_of([F.contains(lowered, F.lit(p)) for p in parts])
        return F.when(maybe, F.array_join(words, " ")).otherwise(name)

    return let(F.regexp_replace(title_case(none_if_empty(strip(value))), r"\s+", " "), raised)


def slug_to_name(slug: Column) -> Column:
    """``aid-for-vets`` to ``AID FOR Vets``: words of up to three letters go upper-case."""
    words = F.filter(F.split(F.replace(slug, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")
    short = r"^\p{L}{1,3}$"
    return F.array_join(
        F.transform(words, lambda w: F.when(w.rlike(short), F.upper(w)).otherwise(title_case(w))), " "
    )


def bucket_label(value: Column, buckets: Sequence[tuple] = fixed.REVENUE_BUCKETS) -> Column:
    """Label of the first closed range that holds ``value``; null between ranges."""
    label = F.lit(None).cast("string")
    for low, high, text in reversed(buckets):
        inside = value >= low if high is None else value.between(low, high)
        label = F.when(inside, F.lit(text)).otherwise(label)
    return label


def compact_currency(value: Column) -> Column:
    """``$1.2B``, ``$3.4M``, ``$56K``, ``$789``; ``N/A`` for null."""

    def scaled(unit: float, places: int, suffix: str) -> Column:
        number = F.format_string(f"%.{places}f", F.bround(value / F.lit(unit), places))
        return F.concat(F.lit("$"), number, F.lit(suffix))

    return (
        F.when(value.isNull(), F.lit("N/A"))
        .when(value >= 1e9, scaled(1e9, 1, "B"))
        .when(value >= 1e6, scaled(1e6, 1, "M"))
        .when(value >= 1e3, scaled(1e3, 0, "K"))
        .otherwise(scaled(1.0, 0, ""))
    )


def join_address(*parts: Column) -> Column:
    """The non-empty parts with ``, `` between them."""
    return F.concat_ws(", ", *[none_if_empty(p) for p in parts])


PERSON = "array<struct<name:string,title:string,compensation:double>>"


def people_list(value: Column, limit: int | None = None) -> Column:
    """JSON array of people to structs, all or the first ``limit``; null for blank text.

    Text that is no such JSON is one person of that name.
    """
    named = F.struct(value.alias("name"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("compensation"))
    people = F.coalesce(F.from_json(value, PERSON), F.when(strip(value) != "", F.array(named)))
    return people if limit is None else F.slice(people, 1, limit)


def people_json(people: Column) -> Column:
    """Structs to JSON text with nulls written out; null for an empty list."""
    return F.when(F.size(people) > 0, F.to_json(people, {"ignoreNullFields": "false"}))


def split_list(value: Column, delimiter: str = ";", limit: int | None = None) -> Column:
    """``;``-text to an array of trimmed, non-empty entries, all of them or the first ``limit``."""
    entries = F.filter(F.transform(F.split(value, delimiter), strip), lambda x: x != "")
    return entries if limit is None else F.slice(entries, 1, limit)
