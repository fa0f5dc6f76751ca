"""English text search by stems (X11): AND of words, OR, -word and "phrases". Stop words count for their place only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.stemming import SPECIAL_STEMS, lexeme, lexemes


def tokens(text: Column) -> Column:
    """The stems of a text in order, with a mark where a stop word stands."""
    return lexemes(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _holds(found: Column, words: list[str]) -> Column | None:
    """Whether the stems stand one behind the other; a stop word between them may be any word. None for stop words only."""
    wanted = {k: w for k, w in enumerate(words) if w}
    if not wanted:
        return None
    if len(wanted) == 1:
        return F.array_contains(found, *wanted.values())
    places = range(min(wanted), max(wanted) + 1)
    line = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
    return F.rlike(line, F.lit(" " + " ".join(wanted.get(k, "[^ ]+") for k in places) + " "))


def parsed(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A query as alternatives, each a list of (excluded, lexemes that stand one behind the other); tests and alternatives without words other than stop words go."""
    either: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.upper() == "OR" and not minus:
            either.append([])
            continue
        words = [lexeme(w) for w in re.findall(r"[^\W_]+", (phrase or word).lower())]
        if any(words):
            either[-1].append((bool(minus), words))
    return [g for g in either if g]


def matches(text: Column, query: str) -> Column:
    """Whether the text meets the query; a query without words other than stop words meets nothing."""
    found, out = tokens(text), F.lit(False)
    for group in parsed(query):
        tests = [~_holds(found, words) if minus else _holds(found, words) for minus, words in group]
        out = out | reduce(lambda a, b: a & b, tests)
    return F.coalesce(out, F.lit(False))


def may_match(text: Column, query: str) -> Column:
    """A cheap test that every text meeting the query passes: each wanted word's beginning stands at the beginning of a word.

    A stem differs from its words at the end alone, in its last letter or behind it, but for the words of a fixed list.
    """
    out = F.lit(False)
    for group in parsed(query):
        starts = {w[:1] if w in SPECIAL_STEMS else w[: max(1, len(w) - 1)] for minus, words in group if not minus for w in words if w}
        test = reduce(lambda a, b: a & b, [F.lower(text).rlike(r"(?<![\p{L}\p{N}])" + s) for s in sorted(starts)], F.lit(True))
        out = out | test
    return F.coalesce(out, F.lit(False))
