"""The letters of a text, for batches of texts at once.

"Letters" are what is left of a text without script, case, accents, spaces,
digits and marks.  Devanagari is read as its IAST equivalent, so a consonant
carries an ``a`` unless a vowel sign or a virama follows it.  The whole batch is
one array of code points that goes through lookup tables; nothing is done per
character in Python.

Null and empty texts have no letters.  Text of any length is taken whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np

# Devanagari letters and their IAST equivalents.
DEVANAGARI_VOWELS = {
    "अ": "a", "आ": "ā", "इ": "i", "ई": "ī", "उ": "u", "ऊ": "ū", "ऋ": "ṛ", "ॠ": "ṝ",
    "ऌ": "ḷ", "ॡ": "ḹ", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
}
DEVANAGARI_SIGNS = {
    "ा": "ā", "ि": "i", "ी": "ī", "ु": "u", "ू": "ū", "ृ": "ṛ", "ॄ": "ṝ",
    "ॢ": "ḷ", "ॣ": "ḹ", "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
}
DEVANAGARI_CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ṅ",
    "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "ñ",
    "ट": "ṭ", "ठ": "ṭh", "ड": "ḍ", "ढ": "ḍh", "ण": "ṇ",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "र": "r", "ल": "l", "व": "v", "ळ": "ḷ",
    "श": "ś", "ष": "ṣ", "स": "s", "ह": "h",
}
DEVANAGARI_MARKS = {"ँ": "m", "ं": "ṃ", "ः": "ḥ"}
DEVANAGARI_OM = {"ॐ": "oṃ"}
VIRAMA = "्"

_WIDTH = 3  # a code point gives three letters at most
_FAR = (0x3000, 0xF900)  # looked up as they come, like all beyond the first plane
_SIGN, _CONSONANT, _SKIP = 1, 2, 4


def _plain(text: str) -> str:
    """Letters of a text without Devanagari: lower case, no marks."""
    split = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in split if unicodedata.category(c)[0] == "L")


class _Table:
    """Code point to letters, for the blocks that hold alphabets with case or marks; other code points are looked up as they come."""

    def __init__(self) -> None:
        self.out = np.zeros((_WIDTH, 0x10000), dtype=np.int32)
        self.count = np.zeros(0x10000, dtype=np.int8)
        self.kind = np.zeros(0x10000, dtype=np.int8)
        #: Code points that need more than one lookup: several letters, an inherent vowel, or a mark that may stand before a vowel sign.
        self.special = np.zeros(0x10000, dtype=bool)
        self.special[_FAR[0] : _FAR[1]] = True
        for cp in (*range(_FAR[0]), *range(_FAR[1], 0x10000)):
            char = chr(cp)
            self._set(cp, _plain(char))
            if unicodedata.category(char) in ("Mn", "Me", "Cf"):
                self.kind[cp] = _SKIP
        for source in (DEVANAGARI_VOWELS, DEVANAGARI_SIGNS, DEVANAGARI_CONSONANTS, DEVANAGARI_MARKS, DEVANAGARI_OM):
            for char, iast in source.items():
                self._set(ord(char), _plain(iast))
        for cp in range(0x0929, 0x0962):  # letters with a nukta go with their base
            base = unicodedata.normalize("NFD", chr(cp))
            if len(base) == 2 and base[0] in DEVANAGARI_CONSONANTS:
                self._set(cp, _plain(DEVANAGARI_CONSONANTS[base[0]]))
                self.kind[cp] = _CONSONANT
        for char in (*DEVANAGARI_SIGNS, VIRAMA):
            self.kind[ord(char)] = _SIGN
        for char in DEVANAGARI_CONSONANTS:
            self.kind[ord(char)] = _CONSONANT
        self.special |= (self.count > 1) | (self.kind == _SIGN) | (self.kind == _CONSONANT)

    def _set(self, cp: int, letters: str) -> None:
        self.out[:, cp] = 0
        self.count[cp] = min(len(letters), _WIDTH)
        for k, c in enumerate(letters[:_WIDTH]):
            self.out[k, cp] = ord(c)


_TABLE: _Table | None = None


def _table() -> _Table:
    global _TABLE
    if _TABLE is None:
        _TABLE = _Table()
    return _TABLE


def code_points(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and where each text starts (one more entry at the end)."""
    parts = [("" if t is None else t) for t in texts]
    lengths = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, starts


def letters_batch(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each text as int32 code points in one array, and the start of each text in it (one more entry at the end)."""
    points, starts = code_points(texts)
    return letters_of_points(points, starts)


def letters_of_points(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As letters_batch, from code_points."""
    table = _table()
    special = table.special[np.minimum(points, _FAR[0])]
    if not special.any():
        return _one_to_one(table, points, starts)
    sizes = np.diff(starts)
    hard = np.zeros(len(sizes), dtype=bool)
    hard[np.searchsorted(starts, np.flatnonzero(special), side="right") - 1] = True
    if hard.all():
        return _one_to_many(table, points, starts)
    of_hard = np.repeat(hard, sizes)
    bounds = lambda x: np.append(0, np.cumsum(x))
    easy_out, easy_at = _one_to_one(table, points[~of_hard], bounds(sizes[~hard]))
    hard_out, hard_at = _one_to_many(table, points[of_hard], bounds(sizes[hard]))
    lengths = np.empty(len(sizes), dtype=np.int64)
    lengths[~hard], lengths[hard] = np.diff(easy_at), np.diff(hard_at)
    mask = np.repeat(hard, lengths)
    out = np.empty(len(mask), dtype=np.int32)
    out[mask], out[~mask] = hard_out, easy_out
    return out, bounds(lengths)


def _one_to_one(table: _Table, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = table.out[0].take(points)
    kept = out > 0
    return out[kept], np.append(0, np.cumsum(kept))[starts]


def _one_to_many(table: _Table, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    near = (points < _FAR[0]) | ((points >= _FAR[1]) & (points < 0x10000))
    low = np.where(near, points, 0)
    counts = table.count[low]
    kinds = table.kind[low]
    far: dict[int, str] = {}
    for cp in np.unique(points[~near]).tolist():
        found = "" if 0xD800 <= cp < 0xE000 else _plain(chr(cp))[:_WIDTH]
        if found:
            far[cp] = found
            counts[points == cp] = len(found)
    takes_a = np.zeros(len(points), dtype=bool)
    consonants = np.flatnonzero(kinds == _CONSONANT)
    if len(consonants):  # the next code point that isn't a mark to be left out decides
        seen = np.flatnonzero(kinds != _SKIP)
        at = np.searchsorted(seen, consonants) + 1
        following = np.append(seen, len(points))[np.minimum(at, len(seen))]
        sign = np.append(kinds == _SIGN, False)[following]
        same = np.append(owner, -1)[following] == owner[consonants]
        takes_a[consonants] = ~(sign & same)
    width = counts.astype(np.int64) + takes_a
    ends = np.cumsum(width)
    begins = ends - width
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    for k in range(_WIDTH):
        rows = np.flatnonzero((counts > k) & near)
        out[begins[rows] + k] = table.out[k, low[rows]]
    for cp, found in far.items():
        rows = np.flatnonzero(points == cp)
        for k, c in enumerate(found):
            out[begins[rows] + k] = ord(c)
    rows = np.flatnonzero(takes_a)
    out[ends[rows] - 1] = ord("a")
    return out, np.append(0, ends)[starts]


def letters_list(texts: Sequence[str | None]) -> list[str]:
    """Letters of each text as a string."""
    points, starts = letters_batch(texts)
    joined = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def letters(text: str | None) -> str:
    """Letters of one text."""
    return letters_list([text])[0]
