"""Stemmers that need more than one expression; they see each distinct term once.

``porter`` is the algorithm of M. F. Porter, "An algorithm for suffix stripping"
(1980): steps 1a to 5b by rules on the measure of what a suffix leaves.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from vellum.functions.analysis import map_terms

#: Suffixes and what takes their place, where the measure of the rest is over 0.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes that go where the measure of the rest is over 1.
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """The word in c and v; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        vowel = x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    """How often a run of vowels is followed by one of consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, and the last is not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes: Iterable[str]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """The stem of a lower-case English word; words of other letters or of one or two stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    # 1a: plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past and progressive forms
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    elif (s := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and _short(word):
            word += "e"
    # 1c: a last y
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # 2 and 3: double suffixes
    for rules in (STEP_2, STEP_3):
        if (s := _longest(word, rules)) and measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + rules[s]
    # 4: single suffixes
    if (s := _longest(word, STEP_4)) and measure(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    # 5: a last e, and double l
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not _short(rest)):
            word = rest
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def english(tokens: DataFrame, term_col: str, out: str = "stem", keep: Iterable[str] = ()) -> DataFrame:
    """A table of tokens with their Porter stems; words of ``keep`` are not stemmed. A null token has a null stem."""
    kept = frozenset(keep)
    return map_terms(tokens, term_col, lambda t: t if t is None or t in kept else porter(t), out)
