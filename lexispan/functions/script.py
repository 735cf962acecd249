"""Script conversion between IAST, its injective variant and Devanagari.

Each direction is one pattern over the whole text: a syllable is a consonant with
the vowel that belongs to it, so no state is carried from letter to letter.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.functions.letters import DEVANAGARI_CONSONANTS, DEVANAGARI_SIGNS, DEVANAGARI_VOWELS, VIRAMA

# Signs with the same meaning in both scripts, and spellings of one IAST letter.
MARKS = {"ṃ": "ं", "ḥ": "ः", "m̐": "ँ", "'": "ऽ", "||": "॥", "|": "।"}
EQUIVALENT = (("r̥̄", "ṝ"), ("r̥", "ṛ"), ("l̥̄", "ḹ"), ("l̥", "ḷ"), ("ṁ", "ṃ"))
PLAIN_DIPHTHONGS = (("ē", "e"), ("ō", "o"))
INJECTIVE = {"ai": "ē", "au": "ō"}
ASPIRATES = ("kh", "gh", "ch", "jh", "ṭh", "ḍh", "th", "dh", "ph", "bh")

_CONSONANT = {v: k for k, v in DEVANAGARI_CONSONANTS.items() if k != "ळ"}
_VOWEL = {v: k for k, v in DEVANAGARI_VOWELS.items()}
_SIGN = {v: k for k, v in DEVANAGARI_SIGNS.items()} | {"a": ""}
_longest = lambda names: "|".join(sorted(map(re.escape, names), key=len, reverse=True))
_IAST = re.compile(rf"(?P<c>{_longest(_CONSONANT)})(?P<v>{_longest(_VOWEL)})?|(?P<w>{_longest(_VOWEL)})|(?P<m>{_longest(MARKS)})")
_DEVA = re.compile(rf"([{''.join(DEVANAGARI_CONSONANTS)}])([{''.join(DEVANAGARI_SIGNS)}{VIRAMA}])?|([{''.join(DEVANAGARI_VOWELS)}])|([ंःँऽ॥।])")
_FREE_OM = re.compile(r"(?<!\S)oṃ(?!\S)")


def normalize_iast(text: str, *, keep_diphthongs: bool = False) -> str:
    """Composed text without Vedic accents, with one spelling for each letter."""
    text = unicodedata.normalize("NFC", re.sub("[̀́]", "", unicodedata.normalize("NFD", text)))
    for old, new in EQUIVALENT + (() if keep_diphthongs else PLAIN_DIPHTHONGS):
        text = text.replace(unicodedata.normalize("NFC", old), new).replace(old, new)
    return unicodedata.normalize("NFC", text)


def iast_to_devanagari(text: str) -> str:
    """Spaces and all other characters stay as they are; a free-standing oṃ becomes ॐ."""

    def one(m: re.Match) -> str:
        if m["c"]:
            return _CONSONANT[m["c"]] + (_SIGN[m["v"]] if m["v"] else VIRAMA)
        return _VOWEL[m["w"]] if m["w"] else MARKS[m["m"]]

    return unicodedata.normalize("NFC", _IAST.sub(one, _FREE_OM.sub("ॐ", normalize_iast(text))))


def _to_iast(text: str, consonants: dict[str, str], diphthongs: dict[str, str]) -> str:
    marks = {v: k for k, v in MARKS.items()}
    spell = lambda v: diphthongs.get(v, v)

    def one(m: re.Match) -> str:
        consonant, sign, vowel, mark = m.groups()
        if consonant:
            return consonants[consonant] + ("a" if sign is None else "" if sign == VIRAMA else spell(DEVANAGARI_SIGNS[sign]))
        return spell(DEVANAGARI_VOWELS[vowel]) if vowel else marks[mark]

    return unicodedata.normalize("NFC", _DEVA.sub(one, unicodedata.normalize("NFC", text)))


def devanagari_to_iast(text: str) -> str:
    """ॐ stays as it is."""
    return _to_iast(text, DEVANAGARI_CONSONANTS, {})


def devanagari_to_injective(text: str) -> str:
    """IAST in which ē, ō and raised h set diphthongs and aspirates apart from sequences; raises on Devanagari it has no letter for."""
    aspirated = {k: v[:-1] + "ʰ" if v in ASPIRATES else v for k, v in DEVANAGARI_CONSONANTS.items()}
    out = _to_iast(text.replace("ॐ", "ओं"), aspirated, INJECTIVE)
    left = re.search("[ऀ-ॿ]", out)
    if left:
        raise ValueError(f"unsupported Devanagari character U+{ord(left[0]):04X}")
    return out


def transform_script(text: str, source: str, target: str) -> str:
    """Dispatch; the same script is only composed (NFC)."""
    if source == target:
        return unicodedata.normalize("NFC", text)
    if (source, target) not in ROUTES:
        raise ValueError(f"unsupported conversion: {source} to {target}")
    return ROUTES[source, target](text)


ROUTES = {("iast", "devanagari"): iast_to_devanagari, ("devanagari", "iast"): devanagari_to_iast, ("devanagari", "iast_injective"): devanagari_to_injective}


def _column(function) -> object:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None or x is pd.NA or x != x else function(x))

    return run


nfc = _column(lambda x: unicodedata.normalize("NFC", x))
nfd = _column(lambda x: unicodedata.normalize("NFD", x))
normalized_iast = _column(normalize_iast)
to_devanagari = _column(iast_to_devanagari)
to_iast = _column(devanagari_to_iast)
to_injective = _column(devanagari_to_injective)


def converted(text: Column, source: Column, target: str) -> Column:
    """As scripted, in one Arrow call for both scripts."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, sources: pd.Series) -> pd.Series:
        one = lambda x, s: None if x is None or x != x else transform_script(x, s, target) if (s, target) in ROUTES else unicodedata.normalize("NFC", x)
        return pd.Series([one(x, s) for x, s in zip(texts, sources, strict=True)], dtype=object)

    return run(text, source)


def scripted(text: Column, source: Column, target: str) -> Column:
    """Texts of either script in the target script; a null or unknown source script leaves the text composed."""
    if target == "devanagari":
        return F.when(source == "iast", to_devanagari(text)).otherwise(nfc(text))
    if target == "iast":
        return F.when(source == "devanagari", to_iast(text)).otherwise(nfc(text))
    return F.when(source == "devanagari", to_injective(text)).otherwise(nfc(text))
