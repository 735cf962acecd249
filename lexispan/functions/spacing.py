"""Spacing conditions as column expressions; all run inside the JVM.

Java's (?U) makes \\s Unicode white space.  Lines are kept: white space here never
means the line feed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispan.functions.letters import DEVANAGARI_CONSONANTS, DEVANAGARI_SIGNS, DEVANAGARI_VOWELS, VIRAMA
from lexispan.functions.script import ASPIRATES

CONDITIONS = ("observed", "surface_word", "continuous", "lexical_boundary", "legacy_joined")
GAP = r"[\s&&[^\n]]"
_DEVA_C = f"[{''.join(DEVANAGARI_CONSONANTS)}]"
_DEVA_V = f"[{''.join(DEVANAGARI_VOWELS)}]"
_SIGN_OF = {k: {v: s for s, v in DEVANAGARI_SIGNS.items()}.get(v, "") for k, v in DEVANAGARI_VOWELS.items()}
_VOWELS = "aāiīuūṛṝḷḹeo"
_CONSONANTS = "kgṅcjñṭḍṇtdnpbmyrlvśṣsh"


def _sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, f"(?U){pattern}", by)


def whitespace_signature(text: Column) -> Column:
    """The white-space characters of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\s)"), F.lit(1))


def compact(text: Column) -> Column:
    """The text without any white space."""
    return _sub(text, r"\s+", "")


def _recomposed(text: Column) -> Column:
    """Consonant, virama, gap, vowel become the consonant with the vowel's sign: no sound changes, only the writing.

    One pattern, which can only begin at a virama, marks all seams; the rest are plain replacements.
    """
    seam = "\ue000"
    text = _sub(text, f"(?<={_DEVA_C}){VIRAMA}{GAP}+(?={_DEVA_V})", seam)
    for vowel, sign in _SIGN_OF.items():
        text = F.replace(text, F.lit(seam + vowel), F.lit(sign))
    return text


def continuous_iast(text: Column) -> Column:
    """No white space but one space on either side of a danda that has text there."""
    bare = _sub(text, f"{GAP}+", "")
    return _sub(_sub(bare, r"(?<=[^|\n])(?=\|)", " "), r"(?<=\|)(?=[^|\n])", " ")


def continuous_devanagari(text: Column) -> Column:
    """No white space but one space after a danda that has text after it; consonants and vowels that meet are written together."""
    bare = _sub(_recomposed(text), f"{GAP}+", "")
    return _sub(bare, r"(?<=[।॥])(?=[^।॥\n])", " ")


def danda_spacing(text: Column) -> Column:
    """No space before a danda, one after it if text follows, none at the line's end."""
    text = _sub(text, f"{GAP}*([।॥])", "$1")
    text = _sub(text, rf"([।॥]){GAP}*(?=[^।॥\s])", "$1 ")
    return _sub(text, rf"([।॥]){GAP}*(?=\n|$)", "$1")


def legacy_joined_iast(text: Column) -> Column:
    """Gaps between consonants, consonant and vowel, vowel and avagraha go; every other run of white space is one space.  Anusvara and visarga are no consonants."""
    consonant, vowel = f"[{_CONSONANTS}]", f"[{_VOWELS}]"
    text = _sub(text, rf"(?i)(?<={consonant}){GAP}+(?={consonant}|{vowel})", "")
    text = _sub(text, rf"(?i)(?<={vowel}){GAP}+(?=')", "")
    return _sub(text, f"{GAP}+", " ")


def legacy_joined_devanagari(text: Column) -> Column:
    """As legacy_joined_iast: a virama ends in a consonant, a bare consonant, sign or vowel in a vowel."""
    vowel_end = f"(?:{_DEVA_C}|[{''.join(DEVANAGARI_SIGNS)}{''.join(DEVANAGARI_VOWELS)}])"
    text = _recomposed(text)
    text = _sub(text, rf"(?<={_DEVA_C}{VIRAMA}){GAP}+(?={_DEVA_C})", "")
    text = _sub(text, rf"(?<={vowel_end}){GAP}+(?=ऽ)", "")
    return _sub(text, f"{GAP}+", " ")


def spaced(text: Column, condition: str, script: str) -> Column:
    """One spacing condition of a composed (NFC) text of the given script."""
    if condition not in CONDITIONS:
        raise ValueError(f"unsupported spacing condition: {condition}")
    if script not in ("iast", "devanagari", "iast_injective"):
        raise ValueError(f"unsupported script: {script}")
    deva = script == "devanagari"
    if condition in ("continuous", "lexical_boundary"):
        out = continuous_devanagari(text) if deva else continuous_iast(text)
    elif condition == "legacy_joined":
        out = legacy_joined_devanagari(text) if deva else legacy_joined_iast(text)
    else:
        out = text
    return danda_spacing(out) if deva and condition in ("surface_word", "legacy_joined", "continuous") else out


def commas_to_danda(text: Column) -> Column:
    """A comma at the line's start or after white space, and those that follow it, go; any other is a danda."""
    return F.replace(_sub(text, r"(?m)(^|\s),+", "$1"), F.lit(","), F.lit("।"))


def split_on_danda(line: Column, marks: str = "।॥") -> Column:
    """Sentences of a line with their closing mark, trimmed; empty ones are left out."""
    pieces = F.regexp_extract_all(line, F.lit(f"([^{marks}]+[{marks}]?)"), F.lit(1))
    return F.filter(F.transform(pieces, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def longest_iast_tokens(text: Column) -> Column:
    """Letters by longest match, a digraph being one; all other characters one by one."""
    return F.regexp_extract_all(text, F.lit(f"(?s)({'|'.join((*ASPIRATES, 'ai', 'au'))}|[|]{{2}}|.)"), F.lit(1))


def joined_tokens(tokens: Column) -> Column:
    """Letters and spaces (longest_iast_tokens) without the spaces that legacy joining drops; other runs of spaces are one space."""
    consonants = F.array(*(F.lit(c) for c in (*ASPIRATES, *_CONSONANTS)))
    vowels = F.array(*(F.lit(v) for v in (*_VOWELS, "ai", "au")))
    blank = lambda x: x.rlike(r"(?U)^\s$")

    def kept(x: Column, i: Column) -> Column:
        before = F.get(tokens, i - 1)
        after = F.get(F.filter(F.slice(tokens, i + 2, F.size(tokens)), lambda y: ~blank(y)), F.lit(0))
        c, v = F.array_contains(consonants, before), F.array_contains(vowels, before)
        seam = (c & (F.array_contains(consonants, after) | F.array_contains(vowels, after))) | (v & (after == "'"))
        return ~blank(x) | (x == "\n") | ~(F.coalesce(seam, F.lit(False)) | F.coalesce(blank(before), F.lit(False)))

    return F.filter(tokens, kept)
