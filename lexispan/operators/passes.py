"""The cleaning passes: what each does to one text, and how often each of its rules applied.

A pass is a function of a text that gives the text afterwards and a count for each
rule.  Passes keep line numbers (a removed line is left empty) unless they say
otherwise.  The functions are pure, so they run as Arrow UDFs (see `cleaning.column`).
Null texts are not handed to them; empty texts stay empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Rule = tuple[str, re.Pattern, str | Callable]
LETTERS = "a-zA-ZāīūṛṝḷḹṅñṭḍṇśṣṃḥĀĪŪṚṜḶḸṄÑṬḌṆŚṢṂḤ"
VOWELS = "aāiīuūṛṝḷḹeo"
ALPHABET = f"{VOWELS}kgṅcjñṭḍṇtdnpbmyrlvśṣshṃḥ"
CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}
DANDAS = "|।॥"


def rules_of(*rows: tuple[str, str, str | Callable]) -> list[Rule]:
    return [(name, re.compile(pattern), by) for name, pattern, by in rows]


def apply_rules(text: str, rules: list[Rule]) -> tuple[str, Counter]:
    """One pass over the lines."""
    counts: Counter = Counter()
    lines = []
    for line in text.split("\n"):
        for name, pattern, by in rules:
            after, n = pattern.subn(by, line)
            if after != line:
                counts[name] += n
                line = after
        lines.append(line)
    return "\n".join(lines), counts


def to_fixed_point(text: str, step: Callable[[str], tuple[str, Counter]], *, rounds: int = 10) -> tuple[str, Counter, int]:
    """Repeats a step until it changes nothing; the rounds it took with the last, idle one.  Raises if `rounds` aren't enough."""
    total: Counter = Counter()
    for round_no in range(1, rounds + 1):
        after, counts = step(text)
        if after == text:
            return text, total, round_no
        text, total = after, total + counts
    raise RuntimeError(f"did not reach a fixed point in {rounds} rounds")


def spans(line: str) -> list[tuple[int, int]]:
    """Outermost bracketed stretches, closed in order; an unclosed bracket opens none."""
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(line):
        if line[at] in CLOSERS:
            waiting = [CLOSERS[line[at]]]
            end = at + 1
            while end < len(line) and waiting:
                if line[end] == waiting[-1]:
                    waiting.pop()
                elif line[end] in CLOSERS:
                    waiting.append(CLOSERS[line[end]])
                end += 1
            if not waiting:
                out.append((at, end))
                at = end
                continue
        at += 1
    return out


# ---------------------------------------------------------------- canonical form

_SIGLUM = r"[A-Z][A-Za-z]{0,9}"
_NUMBER = r"\d+(?:[.,:]\d+)*"
_HEADS = re.compile(
    rf"""\s*(?:
      \(\s*{_SIGLUM}_[^()\s]*\)\s*                                   # (Sig_1,1.1a)
    | \[{_SIGLUM}\s+{_NUMBER}[a-d]*\]\s*                             # [Sig 10.29.41]
    | {_SIGLUM}[_\s]?{_NUMBER}[a-z]?\s*[|/]\.?\s*                    # Sig 1.1a/  Sig01.1.01|
    | div\d+\s+
    | \d+(?:[.,]\d+)+[a-z]?(?:\*\d+_\d+)?(?:\(\w+\))?[.:]?[\s]+      # 01,000.000*0001_01
    | \(?\d+[.):]\s+
    )""",
    re.VERBOSE,
)
_TAIL = re.compile(rf"\s*(?:\|\|\s*(?:(?:{_SIGLUM}_)?{_NUMBER}[a-d]?\.?(?:\s+\d+)?)\s*)+\|\|+(?:\s*\|\|)*\s*$")
_NESTED = re.compile(rf"(?:\|\|\s*(?:{_SIGLUM}_)?{_NUMBER}[a-d]?\.?(?:\s+\d+)?\s*\|\|\s*)+(?=\|\|)")
CANONICAL = rules_of(
    ("boilerplate", r"(?i)^\s*(?:copyright|this file is|input by|proofread|encoding|text converted|end of (?:the )?(?:file|text)|the end)\b.*$", ""),
    ("address", r"(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.[\w.]+", ""),
    ("decoration", r"[=_~#]{2,}|^\s*[-–—]{2,}\s*$", ""),
    ("danda", "[।॥/]", lambda m: "||" if m[0] == "॥" else "|"),
    ("number_between_words", rf"(?<=[{LETTERS}]) \d+ (?=[{LETTERS}])", " "),
    ("spaces", r"[ \t ]{2,}|\t", " "),
    ("ends", r"^ +| +$", ""),
)


def _without_affixes(line: str) -> tuple[str, Counter]:
    counts: Counter = Counter()
    while (found := _HEADS.match(line)) and found.end():
        line = line[found.end() :]
        counts["prefix"] += 1
    short = _TAIL.sub(" ||", _NESTED.sub("", line))
    if short != line:
        counts["suffix"] += 1
    return short, counts


def canonical(text: str) -> tuple[str, Counter]:
    """Composed letters, ASCII dandas, no boilerplate, addresses, record names or verse numbers, to a fixed point; bracketed citations inside a line stay."""

    def step(value: str) -> tuple[str, Counter]:
        counts: Counter = Counter()
        lines = []
        for line in value.split("\n"):
            line, n = _without_affixes(line)
            counts += n
            lines.append(line)
        value, n = apply_rules("\n".join(lines), CANONICAL)
        return value, counts + n

    composed = unicodedata.normalize("NFC", re.sub(r"\r\n?", "\n", text))
    after, counts, _ = to_fixed_point(composed, step)
    if composed != text:
        counts["composed"] += 1
    return after, counts


# ---------------------------------------------------------------- first, mechanical pass

_EDITOR = (
    r"\b(?:ed|eds|corr|em|emend|cf|conj|sic|om|var|lacuna|missing|read|reads|edits?|edition|thus|follows|note|n|p|pp|ms|mss|supplied|repeated|illegible|footnote|add|deest)\b(?:\.|\b)"
)
_CITED = re.compile(rf"^[.;\s]*(?:[;.]?{_SIGLUM}|[A-ZĀ-ŻṚŚṢ][\w.]*)[\s_.]*\d[\w.,;:/\s|-]*$")
_SUPPLEMENT = re.compile(r"^[a-zāīūṛṝḷḹṅñṭḍṇśṣṃḥ']{1,6}$")


def _square(found: re.Match) -> tuple[str, str]:
    inner = found[1].strip()
    line, a, b = found.string, found.start(), found.end()
    joined = (a > 0 and line[a - 1].isalpha()) or (b < len(line) and line[b].isalpha())
    if _CITED.match(inner):
        return "square_citation_removed", ""
    if re.search(_EDITOR, inner, re.IGNORECASE):
        return "square_editorial_removed", ""
    if joined and _SUPPLEMENT.match(inner):
        return "square_supplement_unwrapped", inner
    return "", found[0]


def _angle(found: re.Match) -> tuple[str, str]:
    inner = found[1]
    return ("angle_numeric_locator_removed", "") if re.fullmatch(r"[\d.,:\s-]+", inner) else ("angle_unwrapped", inner)


def _round(found: re.Match) -> tuple[str, str]:
    inner = found[1].strip()
    siglum = re.match(rf"^{_SIGLUM}(?:\s+[IVXLC]+)?[\s_.]*\d[\d.,\s-]*[a-d]?$", inner)
    folio = re.match(rf"^\d+[rvab]?\s*=\s*{_SIGLUM}\s*\d+[rv]?$|^\d+[rv]$", inner)
    note = re.search(r"^(?:ed|corr|em|cf|sic|var|v\.l)\b[.:!\s]", inner + " ", re.IGNORECASE)
    return ("round_editorial_removed", "") if siglum or folio or note else ("", found[0])


def _decided(line: str, pattern: str, decide: Callable[[re.Match], tuple[str, str]], counts: Counter) -> str:
    def by(found: re.Match) -> str:
        name, value = decide(found)
        if name:
            counts[name] += 1
        return value

    return re.sub(pattern, by, line)


def mechanical(text: str) -> tuple[str, Counter]:
    """No control characters, underscores, archive records or bracketed notes; unknown bracketed passages stay.  Lines that only hold an archive record go."""
    counts: Counter = Counter()
    kept = []
    for c in text:
        if unicodedata.category(c) in ("Cc", "Cf") and c not in "\n\t":
            counts["control_or_format_removed"] += 1
        else:
            kept.append(c)
    value = "".join(kept)
    value, n = re.subn(r"(?m)^[ \t]*\[([a-z]):[^\n]*?:\1\][ \t]*\n|\[([a-z]):[^\n]*?:\2\]", "", value)
    counts["hv_metadata_removed"] += n
    counts["underscore_to_space"] += value.count("_")
    lines = []
    for before in value.replace("_", " ").split("\n"):
        line = _decided(before, r"\[([^\[\]]*)\]", _square, counts)
        line = _decided(line, r"<([^<>]*)>", _angle, counts)
        line = _decided(line, r"\(([^()]*)\)", _round, counts)
        line = re.sub(r"[ \t]+", " ", line).rstrip()
        line = line.lstrip() if line != before and not before.startswith((" ", "\t")) else line
        counts["whitespace"] += line != before
        lines.append(line)
    return "\n".join(lines), +counts


# ---------------------------------------------------------------- second, editorial pass

_DOTTED = r"\d+(?:\.\d+){2,}\.?"
_CITATIONS = re.compile(rf"^(?:[\s;,.]*(?:{_SIGLUM}[\s_]*)?\d+(?:\.\d+)+[a-f]*)+[\s;,.]*$")


def _note(found: re.Match) -> tuple[str, str]:
    inner = found[1]
    if _CITATIONS.match(inner):
        return "square_citation_removed", ""
    if re.search(_EDITOR, inner, re.IGNORECASE):
        return "square_editorial_removed", ""
    return "", found[0]


EDITORIAL_LINES = rules_of(
    ("metadata_line_removed", r"(?i)^\W*(?:date|version|status|subject|from|to|organization|message-id|lines|sender|reply-to)\s*:.*$", ""),
    ("numeric_locator_line_removed", r"^(?=.*\d\.)(?=.*\.[\d\]])[\d.\[\]]+$|^\d+(?:\.\d+)+\.?$", ""),
    ("siglum_locator_line_removed", r"^[A-Z][A-Za-z]*[A-Z]\s+\d+(?:\.\d+)+:?\s*$", ""),
)
EDITORIAL = rules_of(
    ("leading_parenthesized_locator_removed", r"^\(\d+(?:\.\d+)+\)\s*", ""),
    ("leading_dotted_locator_removed", rf"^{_DOTTED}(?=[{LETTERS}])", ""),
    ("midline_dotted_locator_removed", rf"(?<=\s){_DOTTED}(?=[{LETTERS}])", ""),
    ("archive_suffix_removed", r"(?<=\S)\s*\|\|\s*\*\*[^|{}]*\|\|\s*$", " ||"),
    ("double_danda_number_removed", r"\|\|\s*\d+\s*\|\|", "||"),
    ("line_final_danda_number_removed", r"(?<=\|)\s*\d+\s*$", ""),
)


def editorial(text: str) -> tuple[str, Counter]:
    """No locators, verse numbers, bracketed notes and citations, or mail headers; bracketed passages of text, single numbers and headings stay."""
    counts: Counter = Counter()
    lines = []
    for before in text.split("\n"):
        line, n = apply_rules(before, EDITORIAL_LINES)
        counts += n
        line = _decided(line, r"\[([^\[\]]*)\]", _note, counts)
        line, n = apply_rules(line, EDITORIAL)
        counts += n
        if line != before:
            line = re.sub(r"(?<=\S) {2,}", " ", line).rstrip()
        lines.append(line)
    return "\n".join(lines), counts


# ---------------------------------------------------------------- separators and hyphens


@dataclass(frozen=True)
class Mark:
    """One separator of a line: its place, what stands on either side, and what is to be done."""

    place: int
    left: str
    right: str
    decision: str
    reason: str


def _unit(line: str, at: int, step: int, mark: str, bracketed: list[tuple[int, int]]) -> str:
    """What stands beside a place: a letter, digit, danda, apostrophe, bracketed stretch, white space, the mark itself, the line's edge or something else."""
    if not 0 <= at < len(line):
        return "EDGE"
    c = line[at]
    if any(a <= at < b for a, b in bracketed):
        return "PROTECTED"
    if c == mark:
        return "REPEATED"
    if c in DANDAS:
        return "DANDA"
    if c in "'’":
        beyond = at + step
        return "APOSTROPHE" if step < 0 or (0 <= beyond < len(line) and line[beyond].isalpha()) else "APOSTROPHES"
    if c.isspace():
        return "SPACE"
    if c.isdigit():
        return "DIGIT"
    return "LEXICAL" if c.isalpha() or unicodedata.category(c)[0] == "M" else "OTHER"


def marks(line: str, mark: str) -> Iterator[Mark]:
    """Every place of a separator with its units, and the decision for a hyphen: SEPARATOR, NON_SEPARATOR or REVIEW."""
    bracketed = spans(line)
    for at in (k for k, c in enumerate(line) if c == mark):
        left, right = _unit(line, at - 1, -1, mark, bracketed), _unit(line, at + 1, 1, mark, bracketed)
        if any(a < at < b for a, b in bracketed):
            yield Mark(at, left, right, "NON_SEPARATOR", "inside_protected_span")
        elif "REPEATED" in (left, right):
            yield Mark(at, left, right, "NON_SEPARATOR", "repeated_hyphen")
        elif "DIGIT" in (left, right):
            yield Mark(at, left, right, "NON_SEPARATOR", "adjacent_digit")
        elif "EDGE" in (left, right):
            yield Mark(at, left, right, "REVIEW", "line_edge")
        elif "SPACE" in (left, right):
            yield Mark(at, left, right, "REVIEW", "adjacent_whitespace")
        elif left in ("LEXICAL", "PROTECTED") and right in ("LEXICAL", "PROTECTED"):
            yield Mark(at, left, right, "SEPARATOR", f"{left.lower()}_to_{right.lower()}")
        elif left in ("LEXICAL", "PROTECTED") and right == "APOSTROPHE":
            yield Mark(at, left, right, "SEPARATOR", "to_avagraha_lexical")
        else:
            yield Mark(at, left, right, "REVIEW", "other_units")


def hyphen_marks(line: str) -> list[Mark]:
    return list(marks(line, "-"))


def separator_marks(line: str, separator: str = ".") -> list[Mark]:
    """Of each separator AUTO, REVIEW or IGNORE: AUTO between words, brackets and dandas and at a word that begins or ends the line."""
    out = []
    for m in marks(line, separator):
        sides = {m.left, m.right}
        if m.reason in ("inside_protected_span", "adjacent_digit", "repeated_hyphen"):
            out.append(Mark(m.place, m.left, m.right, "IGNORE", m.reason if m.reason != "repeated_hyphen" else "repeated_separator"))
        elif m.left == "EDGE" and m.right == "LEXICAL" or m.right == "EDGE" and m.left == "LEXICAL":
            out.append(Mark(m.place, m.left, m.right, "AUTO", "leading_edge_separator" if m.left == "EDGE" else "trailing_edge_separator"))
        elif sides <= {"LEXICAL", "PROTECTED", "DANDA", "APOSTROPHE"} and sides != {"DANDA"} and m.left != "APOSTROPHE":
            out.append(Mark(m.place, m.left, m.right, "AUTO", f"{m.left.lower()}_to_{m.right.lower()}"))
        else:
            out.append(Mark(m.place, m.left, m.right, "REVIEW", m.reason))
    return out


def _replaced(line: str, by: dict[int, str]) -> str:
    return "".join(by.get(k, c) for k, c in enumerate(line)) if by else line


def separated(text: str, separator: str = ".") -> tuple[str, Counter]:
    """Separators between words become spaces, at the ends of a line they go; all others stay."""
    counts: Counter = Counter()
    lines = []
    for line in text.split("\n"):
        by = {}
        for m in separator_marks(line, separator) if separator in line else ():
            counts[f"{m.decision}:{m.reason}"] += 1
            if m.decision == "AUTO":
                by[m.place] = "" if m.reason.endswith("edge_separator") else " "
        lines.append(_replaced(line, by))
    return "\n".join(lines), counts


def hyphen_action(m: Mark, *, line_ends: bool = True) -> tuple[str, str | None]:
    """(rule, what replaces the hyphen), or its decision and None if it stays."""
    if m.decision == "SEPARATOR":
        return "general_separator_to_space", " "
    if m.decision == "REVIEW":
        if m.left == "LEXICAL" and m.right == "SPACE":
            return "redundant_hyphen_before_space_removed", ""
        if m.left == "APOSTROPHE" and m.right == "LEXICAL":
            return "apostrophe_hyphen_removed", ""
        if m.left == "LEXICAL" and m.right == "APOSTROPHES":
            return "hyphen_before_apostrophe_sequence_removed", ""
        if m.left == "LEXICAL" and m.right == "EDGE" and line_ends:
            return "trailing_hyphen_at_line_end_removed", ""
    return m.decision, None


def dehyphenated(text: str, *, line_ends: bool = True) -> tuple[str, Counter]:
    """Hyphens between words become spaces, those that a space, apostrophe or line end makes redundant go; all others stay."""
    counts: Counter = Counter()
    lines = []
    for line in text.split("\n"):
        by = {}
        for m in hyphen_marks(line) if "-" in line else ():
            rule, value = hyphen_action(m, line_ends=line_ends)
            counts[rule] += 1
            if value is not None:
                by[m.place] = value
        lines.append(_replaced(line, by))
    return "\n".join(lines), counts


# ---------------------------------------------------------------- prolated vowels

_PLUTA = re.compile(r"([^\W\d_])([\u0300-\u036f]*)3(?!\d)")
_ACCENTS = "\u0300\u0301\u030d\u0331\u0951\u0952"
_LONG = frozenset("āīūṝḹeo")


def pluta_marks(line: str) -> list[tuple[int, str, str]]:
    """(place of the 3, base, AUTO or REVIEW) of each vowel with a 3 after it, outside brackets and locators; long vowels and diphthongs are AUTO."""
    out = []
    bracketed = spans(line)
    for m in _PLUTA.finditer(line):
        if any(a <= m.start() < b for a, b in bracketed):
            continue
        letter = "".join(c for c in unicodedata.normalize("NFD", (m[1] + m[2]).lower()) if c not in _ACCENTS)
        plain, first = unicodedata.normalize("NFC", letter), m.start()
        if plain not in "aāiīuūṛṝḷḹeo":
            continue
        if plain in "iu" and first and line[first - 1] == "a":
            plain, first = "a" + plain, first - 1
        before = re.search(r"[\w.]*$", line[:first])[0]
        if re.search(r"[\d_]", before) or (line[m.end() :][:1] == "." and line[m.end() + 1 :][:1].isdigit()):
            continue  # a locator
        out.append((m.end() - 1, plain, "AUTO" if len(plain) > 1 or plain in _LONG else "REVIEW"))
    return out


def without_pluta(text: str) -> tuple[str, Counter]:
    """The 3 of AUTO vowels goes; REVIEW stays."""
    counts: Counter = Counter()
    lines = []
    for line in text.split("\n"):
        found = pluta_marks(line) if "3" in line else []
        counts.update(decision for *_, decision in found)
        by = {place: "" for place, _, decision in found if decision == "AUTO"}
        lines.append(unicodedata.normalize("NFC", _replaced(line, by)) if by else line)
    return "\n".join(lines), counts


# ---------------------------------------------------------------- laterals, closure, projection

_LATERAL_VOWELS = "aāiīuūṛṝeo"
_LATERAL = re.compile(rf"(?<=[{_LATERAL_VOWELS}])ḷ(h?)|ḷ(h?)(?=[{_LATERAL_VOWELS}])")


def lateral_to_d(text: str) -> tuple[str, Counter]:
    """ḷ and ḷh beside a vowel are ḍ and ḍh."""
    counts: Counter = Counter()

    def by(m: re.Match) -> str:
        h = m[1] or m[2] or ""
        counts["lh_to_dh" if h else "l_to_d"] += 1
        return "ḍ" + h

    return _LATERAL.sub(by, text), counts


def close_once(text: str) -> tuple[str, Counter]:
    """Composed letters, line feeds, single spaces, spaced dandas; no lines of a danda alone, one leading bar less, no blank lines at the ends or in a row."""
    counts: Counter = Counter()
    composed = unicodedata.normalize("NFC", text)
    counts["unicode_nfc"] += composed != text
    lines: list[str] = []
    for line in re.split(r"\r\n|\r|\n", composed):
        line = " ".join(re.sub(r"\|+", lambda m: f" {m[0]} ", line).split())
        if line in ("|", "||"):
            counts["standalone_single_danda_lines_removed" if line == "|" else "standalone_double_danda_lines_removed"] += 1
            continue
        if line.startswith("| "):
            counts["line_start_single_danda_removed"] += 1
            line = line[2:]
        if line or (lines and lines[-1]):
            lines.append(line)
    while lines and not lines[-1]:
        lines.pop()
    return "".join(f"{line}\n" for line in lines), +counts


def closed(text: str) -> tuple[str, Counter]:
    """`close_once` to its fixed point.  Line numbers change."""
    after, counts, _ = to_fixed_point(text, close_once)
    return after, counts


def valid_avagraha(text: str, place: int) -> bool:
    """Whether an apostrophe stands for an elided vowel: after e or o (a space may lie between) and right before a letter."""
    before, after = text[:place], text[place + 1 : place + 2]
    return bool(re.search(r"[eo] ?$", before)) and bool(after) and after in ALPHABET


def _foreign(unit: str) -> bool:
    """Whether a stretch holds editorial matter: words with letters that no Sanskrit word has, or brackets with sigla or numbers."""
    return bool(re.search(r"[fqwxz]|\d", unit, re.IGNORECASE)) and bool(re.search(r"(?i)\b[a-z]*[fqwxz][a-z]*\b|\b(?:ed|variant|apparatus|note|page)\b", unit))


def projected(text: str) -> tuple[str, Counter]:
    """Only lower-case letters, spaces, bars and apostrophes of elision: editorial stretches between bars or in brackets go whole, then sigla, numbers and marks."""
    counts: Counter = Counter()
    lines = []
    for line in re.split(r"\r\n|\r|\n", text):
        for a, b in reversed(spans(line)):
            if re.search(r"[A-Z\d]|\b(?:ed|variant|note)\b", line[a:b]):
                line = line[:a] + " " + line[b:]
                counts["bracketed_unit_removed"] += 1
        units = re.split(r"(\|+)", line)
        for k in range(0, len(units), 2):
            if _foreign(units[k]):
                units[k] = " "
                counts["editorial_unit_removed"] += 1
        line = "".join(units)
        line, n = re.subn(r"^\s*[A-Z][A-Za-z]*\.?\d+(?:[.,]\d+)*\s*|\b[A-Z][A-Za-z]{0,6}[._]\d+(?:[.,]\d+)*[a-d]*\b", " ", line)
        counts["compact_siglum_removed"] += n
        line, n = re.subn(r"\d+(?:[.,:]\d+)*", "", line)
        counts["number_removed"] += n
        low = line.lower()
        counts["textual_sanskrit_uppercase_lowered"] += sum(a != b for a, b in zip(line, low, strict=False)) if len(low) == len(line) else 1
        low = re.sub(r"[.^:;/!?]+", " ", low.replace("’", "'"))
        kept = re.sub(rf"[^{ALPHABET}'| ]", "", low)
        counts["projected"] += len(low) - len(kept)
        single = re.sub(" +", " ", kept)
        real = "".join(c for k, c in enumerate(single) if c != "'" or valid_avagraha(single, k))
        counts["apostrophe_removed"] += len(single) - len(real)
        lines.append(re.sub(" +", " ", real).strip())
    return "\n".join(lines), +counts


PASSES: dict[str, Callable[[str], tuple[str, Counter]]] = {
    "canonical": canonical,
    "mechanical": mechanical,
    "editorial": editorial,
    "separators": separated,
    "hyphens": dehyphenated,
    "pluta": without_pluta,
    "lateral": lateral_to_d,
    "closure": closed,
    "projection": projected,
}
