"""Words of texts as arrays of numbers, remembered per stretch of non-blank characters."""

from __future__ import annotations

import array
import re
import unicodedata
from collections.abc import Callable

_STRETCH = re.compile(r"\S+")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")

#: Stretches remembered by a worker; the memory is emptied when it is full.
MEMORY = 1 << 18


def fold(text: str) -> str:
    """Lower case without accents, composed or not."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def words(text: str) -> list[str]:
    """Unbroken runs of letters and digits, without case and accents."""
    return _WORD.findall(fold(text))


class WordNumbers:
    """Texts to arrays of 64-bit numbers, one per word; white space always ends a word, so stretches are independent."""

    def __init__(self, number: Callable[[str], int], letters_only: bool = False):
        self._number = number
        self._find = (_LETTERS if letters_only else _WORD).findall
        self._known: dict[str, array.array] = {}

    def __call__(self, text: str) -> array.array:
        out = array.array("q")
        known = self._known
        for s in _STRETCH.findall(text):
            got = known.get(s)
            if got is None:
                if len(known) >= MEMORY:
                    known.clear()
                got = array.array("q", [self._number(w) for w in self._find(fold(s))])
                if len(s) <= 64:
                    known[s] = got
            out.extend(got)
        return out
