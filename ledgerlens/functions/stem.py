"""Suffix stripping of ROUGE tokens by the published algorithm of M. F. Porter (Program 14(3), 1980).

Written from the paper: a word is its string of consonants and vowels, a rule set is a table from suffix to
replacement, and the longest suffix of a word that a table has decides.  The departures that ROUGE scorers
use are kept as a separate table of whole words and the three conditions marked "departure" below.

Tokens are stemmed inside Arrow batches with a per-worker cache; only tokens of four and more characters
are stemmed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES: whole words with a stem of their own, and the suffix tables of steps 2, 3 and 4.
WHOLE_WORDS = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys(
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


def shape(word: str) -> str:
    """``c`` for a consonant and ``v`` for a vowel; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    """Number of vowel-consonant sequences."""
    return len(re.findall("v+c+", shape(word)))


def short(word: str) -> bool:
    """Ends consonant, vowel, consonant but w, x, y; departure: so does a whole word of vowel and consonant."""
    kinds = shape(word)
    return kinds == "vc" or (kinds.endswith("cvc") and word[-1] not in "wxy")


def cut(word: str, table: dict[str, str], least: int) -> str:
    """Replace the longest suffix that the table has, if what is before it measures more than ``least``."""
    for at in range(len(word)):
        if word[at:] in table:
            head, suffix = word[:at], word[at:]
            before = word[:-3] if suffix == "logi" else head
            fits = measure(before) > least and (suffix != "ion" or head[-1:] in ("s", "t"))
            return head + table[suffix] if fits else word
    return word


def plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]  # departure: ties, tie
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-2] if word.endswith("sses") else word[:-1]
    return word


def past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]  # departure: died, die
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    head = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x) and "v" in shape(word[: -len(x)])), None)
    if head is None:
        return word
    if head.endswith(("at", "bl", "iz")):
        return head + "e"
    if len(head) > 1 and head[-1] == head[-2] and shape(head)[-1] == "c":
        return head if head[-1] in "lsz" else head[:-1]
    return head + "e" if measure(head) == 1 and short(head) else head


def final_y(word: str) -> str:
    """Departure: y after a consonant that does not begin the word becomes i."""
    return word[:-1] + "i" if len(word) > 2 and word.endswith("y") and shape(word)[-2] == "c" else word


def double_suffixes(word: str) -> str:
    """Departure: alli becomes al and the table is applied once more."""
    if word.endswith("alli") and measure(word[:-4]):
        return double_suffixes(word[:-2])
    return cut(word, STEP_2, 0)


def tidy(word: str) -> str:
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@lru_cache(maxsize=200_000)
def porter_stem(word: str) -> str:
    """Stem one word, lower-cased."""
    word = word.lower()
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    if len(word) < 3:
        return word
    word = double_suffixes(final_y(past(plural(word))))
    return tidy(cut(cut(word, STEP_3, 0), STEP_4, 1))


def stem_token(tok: str, min_len: int = 4) -> str:
    """Stem tokens of at least ``min_len`` characters."""
    return porter_stem(tok) if len(tok) >= min_len else tok


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_arrays(tokens: pd.Series) -> pd.Series:
    return pd.Series([[stem_token(t) for t in arr] if arr is not None else None for arr in tokens])


def stem_tokens(tokens: Column) -> Column:
    """Stem every token of an array column (Arrow batches, cached per worker)."""
    return _stem_arrays(tokens)
