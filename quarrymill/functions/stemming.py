"""English word stems by the published Porter2 rules, and English stop words (X11)."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been being
    have has had having do does did doing a an the and but if or because as until while of at by for with about against
    between into through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now""".split()
)
#: Words with stems of their own, and stems that are final after the first step.
ODD = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ODD |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
SPECIAL_STEMS = frozenset(ODD.values())
FINAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Endings and what they become, by step.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
VOWEL = "[aeiouy]"
DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
SHORT_END = re.compile(rf"(^{VOWEL}[^aeiouy]|[^aeiouy]{VOWEL}[^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region behind a vowel and a consonant begin."""

    def behind(at: int) -> int:
        found = re.compile(rf"{VOWEL}[^aeiouy]").search(word, at)
        return found.end() if found else len(word)

    prefix = re.match("gener|commun|arsen", word)
    first = prefix.end() if prefix else behind(0)
    return first, behind(first)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _short(word: str) -> bool:
    return bool(SHORT_END.search(word)) and _regions(word)[0] >= len(word)


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; other words than those of Latin letters stay as they are."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word in ODD:
        return ODD[word]
    word = re.sub(rf"^y|(?<={VOWEL})y", "Y", word)
    first, second = _regions(word)
    # Plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(VOWEL, word[:-2]):
        word = word[:-1]
    if word in FINAL:
        return word
    # Past and present participles
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= first:
            word = word[: -len(end)] + "ee"
    elif end and re.search(VOWEL, word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")) or not DOUBLE.search(word) and _short(word):
            word += "e"
        elif DOUBLE.search(word):
            word = word[:-1]
    word = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", word)
    # Derived words
    end = _longest(word, SECOND)
    if end and len(word) - len(end) >= first and (end != "ogi" or word[-4:-3] == "l") and (end != "li" or word[-3:-2] in set("cdeghkmnrt")):
        word = word[: -len(end)] + SECOND[end]
    end = _longest(word, THIRD)
    if end and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + THIRD[end]
    end = _longest(word, FOURTH)
    if end and len(word) - len(end) >= second and (end != "ion" or word[-4:-3] in set("st")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= second or len(word) - 1 >= first and not SHORT_END.search(word[:-1])) or word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


def lexeme(word: str) -> str:
    """The stem of a word, or an empty text for a stop word."""
    return "" if word in STOP_WORDS else stem(word)


@pandas_udf(T.ArrayType(T.StringType()))
def lexemes(words: pd.Series) -> pd.Series:
    """The lexemes of each list of words, in place, "-" for a stop word; null for null."""
    return words.map(lambda ws: None if ws is None else [lexeme(w) or "-" for w in ws])
