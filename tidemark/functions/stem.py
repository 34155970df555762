"""English word stems, after Porter's published algorithm ("An algorithm for suffix stripping", 1980).

Used on the words of a query and on the few distinct terms that could share their stem, never on
running text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffix rules of the published algorithm, longest match first within a step.
STEP_2 = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "tional": "tion",
    "biliti": "ble", "entli": "ent", "ousli": "ous", "ation": "ate", "alism": "al", "aliti": "al", "iviti": "ive",
    "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "ator": "ate", "eli": "e",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
    "al", "er", "ic", "ou",
]


def _shape(part: str) -> str:
    """Consonants and vowels as ``c`` and ``v``; a y after a consonant is a vowel."""
    kinds = ""
    for letter in part:
        vowel = letter in "aeiou" or (letter == "y" and kinds.endswith("c"))
        kinds += "v" if vowel else "c"
    return kinds


def _measure(part: str) -> int:
    return len(re.findall("v+c+", _shape(part)))


def _short_end(part: str) -> bool:
    return _shape(part).endswith("cvc") and part[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str]) -> str:
    for suffix, other in rules.items():
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + other if _measure(rest) > 0 else word
    return word


def _plural_and_tense(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
    if ending is None:
        return word
    word = word[: -len(ending)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short_end(word) else word


def porter_stem(word: str) -> str:
    if len(word) < 3:
        return word
    word = _plural_and_tense(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2), STEP_3)
    suffix = next((s for s in STEP_4 if word.endswith(s)), None)
    if suffix:
        rest = word[: -len(suffix)]
        if _measure(rest) > 1 and (suffix != "ion" or rest[-1] in "st"):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@F.pandas_udf(T.StringType())
def stems(terms: pd.Series) -> pd.Series:
    return terms.map(porter_stem)
