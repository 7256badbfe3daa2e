"""Characters that look the same: the rules behind lookalike.py and pii.py."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("аеорсухіѕјһԁԛԝАВЕКМНОРСТХУІЅЈԚԜ", "aeopcyxisjhdqwABEKMHOPCTXYISJQW"))
GREEK = dict(zip("οναικρχυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovaikpxuABEZHIKMNOPTYX"))
LOOKALIKES = CYRILLIC | GREEK

#: Java pattern of a character that may need folding; texts without one are their own form.
ODD = r"[^\n\r\x20-\x7E¡-¬®-ÿ]"

_INVISIBLE_MARKS = {0x034F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


class _Shape(dict):
    """Code point -> its plain form, worked out once per character: '' for characters without
    width, a space for every kind of blank, the NFKC form of full- and half-width forms and of
    joined letters; all else, raised digits and ordinals too, stays."""

    def __missing__(self, cp: int):
        c = chr(cp)
        kind = unicodedata.category(c)
        how = unicodedata.decomposition(c).split(" ", 1)[0]
        if kind == "Cf" or cp in _INVISIBLE_MARKS:
            form = ""
        elif kind == "Zs" or c == "\t":
            form = " "
        elif how in ("<wide>", "<narrow>"):
            form = unicodedata.normalize("NFKC", c)
        elif how == "<compat>" and kind[0] == "L" and len(nfkc := unicodedata.normalize("NFKC", c)) > 1 and nfkc.isalpha():
            form = nfkc
        else:
            form = c
        self[cp] = form
        return form


SHAPE = _Shape()
_FOREIGN = re.compile(r"[Ͱ-ϿЀ-ԯἀ-῿]")
#: Letters with their accents; raised and lowered digits count as word characters for Python, but are no letters.
WORD = re.compile(r"(?:[^\W\d_²³¹⁰-₟¼-¾][̀-ͯ]*)+")


def compat(text: str) -> str:
    """Widths, blanks, joined letters and invisible characters in plain form, accents composed."""
    return unicodedata.normalize("NFC", text.translate(SHAPE))


def script(c: str) -> str:
    cp = ord(c)
    if 0x370 <= cp <= 0x3FF or 0x1F00 <= cp <= 0x1FFF:
        return "greek"
    if 0x400 <= cp <= 0x52F:
        return "cyrillic"
    return "latin" if c.isalpha() and (cp < 0x250 or 0x1E00 <= cp <= 0x1EFF) else "other"


def latin_form(token: str) -> str | None:
    """The token with every foreign letter replaced by its Latin look-alike; None where a letter has none."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        if script(c) in ("greek", "cyrillic"):
            c = LOOKALIKES.get(c)
            if c is None:
                return None
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def suspects(text: str) -> dict[str, str]:
    """Tokens of a compat() text that may be disguised Latin words, and their Latin forms.

    A token is a run of letters. It is suspect if it mixes scripts, or if all of it is
    foreign while Latin dominates the text, and if every foreign letter has a look-alike.
    """
    if not _FOREIGN.search(text):
        return {}
    out = {}
    latin = foreign = 0
    whole = []
    for m in WORD.finditer(text):
        token = m.group()
        n = len(_FOREIGN.findall(token))
        k = sum(script(c) == "latin" for c in token) if n else len(token)
        latin, foreign = latin + k, foreign + n
        if n and (form := latin_form(token)):
            if k:
                out[token] = form
            else:
                whole.append((token, form))
    if latin > foreign:
        out.update(whole)
    return out


def repair(text: str, confirmed: dict[str, str]) -> str:
    """compat() text with the confirmed tokens in Latin letters."""
    return WORD.sub(lambda m: confirmed.get(m.group(), m.group()), text)
