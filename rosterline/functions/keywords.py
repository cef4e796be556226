"""Any-of-these-words predicates."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from rosterline.functions.blanks import is_true


def shortest_words(words: Iterable[str]) -> list[str]:
    """Words that contain another word of the list add nothing to an any-match; leave them out."""
    kept: list[str] = []
    for word in sorted({w.lower() for w in words}, key=lambda w: (len(w), w)):
        if not any(k in word for k in kept):
            kept.append(word)
    return kept


def one_pattern(words: Iterable[str]) -> str:
    """The words as one pattern with common beginnings factored out, so a text is passed over once."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(letter) + pattern(below) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        found = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return found + "?" if "" in node else found

    return pattern(tree)


def any_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, conditions) if conditions else F.lit(False)


def matches_any(
    value: Column, words: Sequence[str], *, word_boundary: bool = False, regex: bool = False
) -> Column:
    """True when a word occurs in ``value``, ignoring case; null text is false.

    The default is a plain substring test. ``word_boundary`` asks for whole words;
    ``regex`` takes the words as patterns.
    """
    if not words:
        return F.lit(False)
    if regex:
        return is_true(value.rlike("(?i)" + "|".join(words)))
    if word_boundary:
        return is_true(value.rlike(rf"(?i)\b{one_pattern(w.strip() for w in words)}\b"))
    shortest = shortest_words(words)
    if len(shortest) == 1:
        return is_true(F.contains(F.lower(value), F.lit(shortest[0])))
    # Most places of a text begin no word; the class turns them away before the branches are tried.
    begins = "".join(sorted({re.escape(w[0]) for w in shortest}))
    return is_true(F.lower(value).rlike(f"(?=[{begins}])" + one_pattern(shortest)))


def any_column_matches(columns: Sequence[Column], words: Sequence[str], **options) -> Column:
    return any_of([matches_any(c, words, **options) for c in columns])
