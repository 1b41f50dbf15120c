"""Suffix stripping of English words by the published algorithm of 1980, on distinct words in Arrow batches.

A word is a sequence of consonant and vowel groups; its measure counts how often a vowel group is followed by a consonant
group.  Each step has rules (suffix, replacement) of which the longest that matches decides; a rule applies if the stem
before the suffix passes the step's test.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes and replacements of the published algorithm, step by step.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c for a consonant and v for a vowel, letter by letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    s = _longest(word, ("sses", "ies", "ss", "s"))
    if s:
        word = word[: -len(s)] + {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}[s]
    s = _longest(word, ("eed", "ed", "ing"))
    if s == "eed":
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif s and "v" in _shape(word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        s = _longest(word, rules)
        if s and measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + rules[s]
    s = _longest(word, STEP_4)
    if s and measure(word[: -len(s)]) > 1 and (s != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def stemmed(word: str | Column) -> Column:
    """The stem of each word; null stays null."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem(w))

    return stems(F.lower(word))
