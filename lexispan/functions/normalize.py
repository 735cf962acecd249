"""Normaliser of Devanagari text.

A text is read line by line, and each line as a row of tokens: words of Devanagari
letters, dandas (in either script), stops, and gaps; whatever else there is (digits,
brackets, Latin notes) is no token.  A line without a word is left out, whether it
was a page number, a verse number, a header or a note; an empty line parts
paragraphs.  Marks between two words are one mark, so a number between double dandas
leaves one of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.functions.script import nfc

# What marks a line as metadata.
TRAILER_WORDS = (
    "encoding:", "electronic text", "file name", "text title", "latest update", "send corrections", "questions, comments", "from https://",
    "from http://", "copyright", "all rights reserved", "author:", "language:", "prepared by", "encoded by", "input by", "proofread", "updated",
)
SINGLE, DOUBLE = "।", "॥"
_TOKEN = re.compile(r"(?P<word>[ऀ-ॣ॰-ॿ]+)|(?P<danda>[|।॥]+)|(?P<stop>[.!?;]+)|(?P<gap>\s+)")


def is_metadata(line: str) -> bool:
    """Whether a line says something about the file: a comment, an address or one of the fixed words."""
    low = line.strip().lower()
    return low.startswith("%") or "://" in low or "www." in low or re.search(r"\w@\w", low) is not None or any(word in low for word in TRAILER_WORDS)


def body_lines(text: str) -> list[str]:
    """Lines up to the last one with Devanagari that isn't metadata."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    while lines and (is_metadata(lines[-1]) or not any("ऀ" <= c <= "ॿ" for c in lines[-1])):
        lines.pop()
    return lines


def tokens(line: str) -> Iterator[tuple[str, str]]:
    """(kind, text): word, gap, or the mark it stands for."""
    for found in _TOKEN.finditer(line):
        kind = found.lastgroup
        if kind == "danda":
            yield "mark", DOUBLE if DOUBLE in found[0] or len(found[0]) > 1 else SINGLE
        elif kind == "stop":
            yield "mark", SINGLE
        else:
            yield kind, found[0]


def written(line: str) -> str:
    """The line's words and marks: no space before a mark, one after it, a new line after a double danda; empty without a word."""
    out: list[str] = []
    mark, gap, words = "", False, 0
    for kind, value in tokens(line):
        if kind == "gap":
            gap = True
        elif kind == "mark":
            mark = max(mark, value)  # the double danda is the greater
        else:
            between = mark + "\n" if mark == DOUBLE else mark + " " if mark else " " if gap else ""
            out += [between if out or mark else "", value]
            mark, gap, words = "", False, words + 1
    return "".join(out) + mark if words else ""


def normalize_text(text: str) -> str:
    """All of it, for one text."""
    shown = "".join(c for c in unicodedata.normalize("NFC", text) if c in "\n\r\t" or unicodedata.category(c)[0] != "C")
    out: list[str] = []
    for line in body_lines(shown):
        kept = written(line)
        if kept or (not line.strip() and out and out[-1]):
            out.append(kept)
    return "\n".join(out).strip("\n")


@F.pandas_udf(T.StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """normalize_text of each text; null stays null."""
    return texts.map(lambda x: None if x is None or x != x else normalize_text(x))


@F.pandas_udf(T.StringType())
def trailer_cut(texts: pd.Series) -> pd.Series:
    """Each text up to its last body line."""
    return texts.map(lambda x: None if x is None or x != x else "\n".join(body_lines(x)))


def visible(text: Column) -> Column:
    """Without format, control, private and unassigned characters, but for line ends and tabs."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\r\t]]", "")


def tidy_space(text: Column) -> Column:
    """Line feeds only, single spaces, trimmed lines, at most one blank line in a row."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    trimmed = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.trim(F.regexp_replace(F.array_join(trimmed, "\n"), "\n\n\n+", "\n\n"), F.lit("\n"))


def light_devanagari(text: Column) -> Column:
    """After transliteration: single spaces, no marks at a line's start, dandas and commas close to their word, one blank line between paragraphs."""
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n|\r", "\n"), r"(?U)[\s&&[^\n]]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?m)^[ ।,]+", ""), r" +,", ",")
    text = F.regexp_replace(F.regexp_replace(text, r" +([।॥])", "$1"), r"([।॥])", "$1 ")
    text = F.regexp_replace(F.regexp_replace(text, " +", " "), r" ([।॥])", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"(?m)^ +| +$", ""), r"\n{2,}", "\n\n")
    return nfc(F.regexp_replace(text, r"^\n+|\n+$", ""))
