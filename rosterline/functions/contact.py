"""Contact details out of page text: patterns over landed HTML, no fetching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from rosterline import fixed
from rosterline.functions.blanks import let, none_if_empty, strip
from rosterline.functions.keywords import any_of

# An attribute value in double quotes, in single quotes, or bare up to white space or the tag's end.
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'<>=`]+)"""
HREF = rf"""(?is)<a\b[^>]*?\bhref\s*=\s*{_VALUE}"""
COMMENT = r"(?s)<!--.*?-->"
# Names of characters come from the standard library's table of HTML entities.
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
NAMED = "map({})".format(", ".join(f"'&{n};', '{' ' if n == 'nbsp' else chr(p)}'" for n, p in name2codepoint.items()))
AMPERSANDS = ("&amp;", "&AMP;", "&#38;", "&#038;", "&#x26;", "&#X26;")


def _character(entity: Column) -> Column:
    """What one entity stands for; unknown ones stay as they are."""
    hexadecimal = F.regexp_extract(entity, "^&#[xX]([0-9a-fA-F]+);", 1)
    decimal = F.regexp_extract(entity, "^&#([0-9]+);", 1)
    point = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", decimal).cast("long")
    valid = ((point > 0) & (point < 0xD800)) | point.between(0xE000, 0x10FFFF)
    numeric = F.when(point == 160, F.lit(" ")).when(
        valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    return F.coalesce(numeric, F.try_element_at(F.expr(NAMED), entity), entity)


def unescape(value: Column) -> Column:
    """Named and numeric entities decoded, each once; a no-break space becomes a blank."""

    def decoded(text: Column) -> Column:
        found = F.array_except(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array(*map(F.lit, AMPERSANDS)))
        plain = F.aggregate(found, text, lambda done, e: F.replace(done, e, _character(e)))
        # Ampersands last, or what they set free would be decoded again.
        for entity in AMPERSANDS:
            plain = F.replace(plain, F.lit(entity), F.lit("&"))
        return plain

    return let(value, lambda text: F.when(F.contains(text, F.lit("&")), decoded(text)).otherwise(text))


def visible_text(html: Column) -> Column:
    """Tags removed, entities decoded, ends trimmed."""
    return strip(unescape(F.regexp_replace(html, r"<[^>]*>", "")))


def cell_text(html: Column) -> Column:
    """The text between tags, each piece trimmed, run together."""
    pieces = F.split(F.regexp_replace(html, COMMENT, "<!>"), r"<[^>]*>")
    return F.array_join(F.transform(pieces, lambda piece: strip(unescape(piece))), "")


def links(html: Column) -> Column:
    """``href`` values of ``<a>`` tags in page order, quoted either way or bare; comments do not count."""
    live = F.when(F.contains(html, F.lit("<!--")), F.regexp_replace(html, COMMENT, "")).otherwise(html)
    values = F.regexp_extract_all(live, F.lit(HREF), F.lit(1))

    def bare(value: Column) -> Column:
        return F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)

    return F.transform(values, lambda v: unescape(bare(v)))


def contains_any(value: Column, parts: Sequence[str]) -> Column:
    return any_of([F.contains(value, F.lit(p)) for p in parts])


def first_match(value: Column, pattern: str) -> Column:
    """First match of a pattern, null when there is none."""
    return none_if_empty(F.regexp_extract(value, pattern, 0))


def usable_profile(url: Column, skip: Sequence[str]) -> Column:
    """Not a share, login or help address. The rule lower-cases the address only."""
    return let(F.lower(url), lambda u: ~contains_any(u, skip))


def social_url(html: Column, hrefs: Column, pattern: str, skip: Sequence[str] = ()) -> Column:
    """First profile address in the links, else in the raw page.

    A skipped address in a link moves on to the next link; in the raw page only the first match
    is looked at.
    """
    matches = F.concat(
        F.transform(hrefs, lambda h: F.regexp_extract(h, pattern, 0)),
        F.array(F.regexp_extract(html, pattern, 0)),
    )
    found = F.filter(matches, lambda u: (u != "") & usable_profile(u, skip))
    return F.rtrim(F.get(found, F.lit(0)), F.lit("/"))


def social_urls(
    html: Column, hrefs: Column, patterns: Mapping[str, str] = fixed.SOCIAL_PATTERNS,
    skip: Sequence[str] = (),
) -> list[Column]:
    return [social_url(html, hrefs, p, skip).alias(name) for name, p in patterns.items()]


def acceptable_email(
    address: Column, skip: Sequence[str] = (), endings: Sequence[str] = (),
    parts: Sequence[str] = (),
) -> Column:
    """For a lower-cased address: not listed, no listed ending, no listed part."""
    bad = [F.endswith(address, F.lit(e)) for e in endings] + [contains_any(address, parts)]
    if skip:
        bad.append(address.isin(*skip))
    return ~any_of(bad)


def first_email(
    text: Column, skip: Sequence[str] = fixed.SKIP_EMAILS,
    endings: Sequence[str] = fixed.SKIP_EMAIL_ENDINGS, parts: Sequence[str] = (),
) -> Column:
    """First acceptable address in the text, lower-cased.

    No address holds a space, so only the pieces between spaces that hold an @ are searched.
    """
    pieces = F.filter(F.split(text, " "), lambda piece: F.contains(piece, F.lit("@")))
    found = F.regexp_extract_all(F.array_join(pieces, " "), F.lit(f"({fixed.EMAIL_PATTERN})"), F.lit(1))
    lowered = F.transform(found, F.lower)
    first = F.get(F.filter(lowered, lambda e: acceptable_email(e, skip, endings, parts)), F.lit(0))
    return F.when(F.contains(text, F.lit("@")), first)


def mailto_email(hrefs: Column, parts: Sequence[str] = fixed.SKIP_EMAIL_PARTS) -> Column:
    """First acceptable ``mailto:`` address, lower-cased, without its query."""
    addresses = F.transform(
        F.filter(hrefs, lambda h: F.startswith(h, F.lit("mailto:"))),
        lambda h: F.lower(strip(F.substring_index(F.replace(h, F.lit("mailto:"), F.lit("")), "?", 1))),
    )
    good = F.filter(
        addresses,
        lambda e: e.rlike("^" + fixed.EMAIL_PATTERN) & acceptable_email(e, parts=parts),
    )
    return F.get(good, F.lit(0))


def site_email(html: Column, hrefs: Column, parts: Sequence[str] = fixed.SKIP_EMAIL_PARTS) -> Column:
    """``mailto:`` links first, then anywhere in the page."""
    return F.coalesce(mailto_email(hrefs, parts), first_email(html, (), (), parts))


def first_phone(text: Column, pattern: str = fixed.PHONE_PATTERN) -> Column:
    return first_match(text, pattern)


def meta_content(html: Column, name: str = "description", limit: int | None = None) -> Column:
    """``content`` of ``<meta name=…>`` in either attribute order, trimmed; whole or ``limit`` characters."""
    named = rf"""\bname\s*=\s*["']{name}["']"""
    double, single = r"""\bcontent\s*=\s*"([^"]*)\"""", r"""\bcontent\s*=\s*'([^']*)'"""
    found = [
        none_if_empty(F.regexp_extract(html, pattern, 1))
        for content in (double, single)
        for pattern in (rf"(?is)<meta\b[^>]*{named}[^>]*{content}",
                        rf"(?is)<meta\b[^>]*{content}[^>]*{named}")
    ]
    text = strip(unescape(F.coalesce(*found)))
    return text if limit is None else F.substring(text, 1, limit)
