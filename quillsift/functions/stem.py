"""English term analysis: stop words out, words cut to their stems.

The stemmer is the published Snowball English algorithm: suffix rules that apply only inside the
regions behind the first (R1) and the second (R2) vowel-consonant change of a word. It runs once
per distinct word of an Arrow batch; the column of stems is then taken by dictionary code.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.text import terms

#: English words that carry no content.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then "
    "there these they this to was will with"
).split()

#: Words the rules would get wrong, and words left alone after the first step.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
FINAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

#: Suffixes of each step with what takes their place.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion"
).split()

_REGION = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_LONG_START = re.compile("gener|commun|arsen")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _ending(word: str, suffixes) -> str | None:
    """The longest of the suffixes that the word ends in."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    found = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if found is None:
        return word
    base = word[: -len(found)]
    if found.startswith("eed"):
        return base + "ee" if len(base) >= r1 else word
    if not _VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _DOUBLE.search(base):
        return base[:-1]
    return base + "e" if len(base) <= r1 and _SHORT_END.search(base) else base


def _derived(word: str, r1: int, r2: int) -> str:
    found = _ending(word, STEP_2)
    if found is not None and len(word) - len(found) >= r1:
        base = word[: -len(found)]
        fits = (found != "ogi" or base.endswith("l")) and (found != "li" or base.endswith(tuple("cdeghkmnrt")))
        word = base + STEP_2[found] if fits else word
    found = _ending(word, STEP_3)
    if found is not None and len(word) - len(found) >= (r2 if found == "ative" else r1):
        word = word[: -len(found)] + STEP_3[found]
    found = _ending(word, STEP_4)
    if found is not None and len(word) - len(found) >= r2:
        base = word[: -len(found)]
        word = base if found != "ion" or base.endswith(("s", "t")) else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    # A y that sounds as a consonant is written Y.
    word = re.sub("([aeiouy])y", r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    start = _LONG_START.match(word) or _REGION.match(word)
    r1 = start.end() if start else len(word)
    second = _REGION.match(word, r1)
    r2 = second.end() if second else len(word)
    word = _plural(word)
    if word in FINAL:
        return word
    word = _past(word, r1)
    if word[-1] in "yY" and len(word) > 2 and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    at = len(word) - 1
    if word.endswith("e"):
        if at >= r2 or (at >= r1 and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and at >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _stemmed(lists: pa.Array) -> pa.Array:
    lists = lists.cast(pa.list_(pa.string()))
    words = lists.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string())
    offsets = pa.compute.subtract(lists.offsets, lists.offsets[0])
    return pa.ListArray.from_arrays(offsets, stems.take(words.indices), mask=lists.is_null())


def stemmed_terms(col: Column) -> Column:
    """``terms`` without English stop words, each cut to its stem."""
    kept = F.filter(terms(F.coalesce(col, F.lit(""))), lambda t: ~t.isin(*STOP_WORDS))
    return F.arrow_udf(_stemmed, "array<string>")(kept)


#: Analyzers by the name under which a stored index remembers its own.
ANALYZERS = {"plain": terms, "english": stemmed_terms}
