"""Candidate spans of personal information in one text, and their features."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick

from garimpo.llm import glyphs

# Words that announce a person, by kind.
KIN = """mae pai genitora genitor filho filha esposo esposa irmao irma neto neta avo vizinho vizinha cuidador cuidadora tio tia primo prima
sobrinho sobrinha marido mulher conjuge companheiro companheira namorado namorada amigo amiga padrasto madrasta enteado enteada sogro sogra
cunhado cunhada nora genro familiar responsavel acompanhante tutor tutora paciente visita relato rn ass assinado assinatura nome""".split()
TITLES = """sr sra srta dona seu dr dra enf enfermeiro enfermeira medico medica tec tecnico tecnica fisio fisioterapeuta psic psicologo psicologa
nutricionista prof professor professora doutor doutora""".split()
SHORTENED = {*"sr sra srta dr dra enf tec fisio psic prof ass".split()}
# Kinds of streets, also shortened.
STREETS = """rua r avenida av travessa tv trav alameda al rodovia rod estrada est estr praca pca largo beco viela ladeira via servidao""".split()
# Words before a name that is a place, an institution or a medical term.
PLACES = """hospital upa ubs caps clinica maternidade hemocentro casa santa pronto socorro centro posto bairro jardim vila parque sinal doenca
sindrome manobra escala sonda ritmo posicao triangulo teste reflexo""".split()
LINKS = {"de", "da", "do", "dos", "das", "d"}

TYPES = ("PESSOA", "TELEFONE", "EMAIL", "DOCUMENTO", "ENDERECO")

_NUMBER = re.compile(r"\d[\d()+ .\-]{5,}(?:\d|(?<=-)x\b|(?<=- )x\b)")
_WORD = re.compile(r"[^\W\d_]+")
#: Words of one name at most (a longer run is several findings, side by side), characters of an address before its @ (the standard's limit), and characters in which the words before a candidate are looked for.
NAME_WORDS, LOCAL_PART, LEFT_CONTEXT = 9, 64, 40
_STEP = re.compile(r"(?: ?\. ?| *- *| {1,3}|\n)")
_BEFORE = re.compile(r"[^\W_]+|[^\w\s]")
_SPLIT_LOCAL = re.compile(r"[a-z0-9]+(?:\s*[._%+\-]\s*[a-z0-9]+)*\s*$")
_AT = re.compile(r"@|[\[(]?\s*\barroba\b\s*[\])]?")
_AFTER_STREET = re.compile(r"\s*\.?\s*(?:(?:de|da|do|dos|das|a|o)\s+)?([^\W_]+)")
_AFTER_CUE = re.compile(r"((?:\s*\(\s*a\s*\))?[\s.:,;/()\-]*)(?:d[eao]s?\s+)?(?:(?:srt?a?|dona|seu|dra?|enf)\b(?:\s*\(\s*a\s*\))?[\s.:]*)?")
_DISTRICT = re.compile(r"\s*-\s*[^\W\d_]+(?:\s+[^\W\d_]+){0,3}(?=\s*[,.;\n]|$)")
_NEXT = re.compile(r"\s*([^\W\d_]+|\d|[^\w\s])")
_DIGITS, _TIGHT = re.compile(r"\d+"), re.compile(r"\s*([.\-()+])\s*")
_DOMAIN = re.compile(r"\s*[a-z0-9]+(?:\s*-\s*[a-z0-9]+)*(?:\s*(?:\.|[\[(]?\bponto\b[\])]?)\s*[a-z0-9]+(?:\s*-\s*[a-z0-9]+)*)*")

_PLAIN = {c: unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1}
_PLAIN |= {0xBA: "o", 0xB0: "o", 0xAA: "a", 0x2013: "-", 0x2014: "-", 0x2012: "-", 0x2011: "-", 0x2010: "-", 0x2212: "-", 0xA0: " ", 0x09: " ", 0x0D: "\n"}
_ODD = re.compile(r"[^\n\r\x20-\x7E¡-¬®-ÿ]")


def _byte(c: int) -> int:
    d = _PLAIN.get(ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c, chr(c).lower())
    d = d if isinstance(d, str) else chr(d)
    return ord(d) if len(d) == 1 and ord(d) < 256 else c


_BYTES = bytes(_byte(c) for c in range(256))
#: Everything but letters, digits and @ becomes a space, so that words can be searched with their borders.
_BORDERS = bytes(c if chr(c).isalnum() or c == 0x40 else 0x20 for c in range(256))


class _Folded(dict):
    def __missing__(self, c: str) -> str:
        form = "".join(
            d
            for x in unicodedata.normalize("NFD", c.translate(glyphs.SHAPE))
            if unicodedata.category(x) != "Mn"
            for d in (glyphs.LOOKALIKES.get(x, x).lower().translate(_PLAIN)[:1],)
        )
        self[c] = form
        return form


_FOLDED = _Folded()


def fold_text(text: str) -> tuple[str, list[int] | None]:
    """Lower-case text without accents, and for each of its characters the place in text (None: the same place).

    Texts with unusual characters are brought to their plain look first, so that encoded
    or disguised numbers and names read like any other.
    """
    if not _ODD.search(text):
        return text.encode("latin-1").translate(_BYTES).decode("latin-1"), None
    forms = [_FOLDED[c] for c in text]
    where = [i for i, f in enumerate(forms) for _ in f]
    return "".join(forms), where


@dataclass(slots=True)
class Candidate:
    tipo: str
    start: int
    end: int
    key: tuple  # what the features are made of


def build_machine(names: Iterable[str]) -> ahocorasick.Automaton:
    """Automaton over announcing words, street words and known name words."""
    machine = ahocorasick.Automaton()
    kinds: dict[str, str] = {}
    for w in names:
        kinds[w] = "name"
    for w in (*KIN, *TITLES):
        kinds[w] = "cue"
    for w in STREETS:
        kinds[w] = "street"
    kinds["@"] = kinds["arroba"] = "at"
    for w, k in kinds.items():
        machine.add_word(w if w == "@" else f" {w} ", (k, len(w)))
    machine.make_automaton()
    return machine


def _left(text: str, at: int, n: int = 2) -> tuple[str, ...]:
    """The last n words or signs before at, nearest first; digits read as 9."""
    near = _BEFORE.findall(text, max(0, at - LEFT_CONTEXT), at)[: -n - 1 : -1]
    return (*("9" * min(len(w), 5) if w[0].isdigit() else w for w in near), *["^"] * (n - len(near)))


def _right(text: str, at: int) -> str:
    m = _NEXT.match(text, at, min(len(text), at + 24))
    return m.group(1) if m else "$"


def person_span(text: str, start: int, names: frozenset[str], anywhere: bool) -> tuple[int, int, list[str]] | None:
    """Longest run of name words from start: known name words, initials and links between them.

    anywhere: the first word need not be a known name (it stands after an announcing word).
    """
    m = _WORD.match(text, start)
    if not m or (not anywhere and m.group() not in names):
        return None
    words, end = [m.group()], m.end()
    last_good = end
    while len(words) < NAME_WORDS:
        step = _STEP.match(text, end)
        if not step:
            break
        sep = step.group()
        nxt = _WORD.match(text, step.end())
        if not nxt:
            break
        w = nxt.group()
        if "." in sep and len(words[-1]) != 1:
            break
        if "-" in sep:
            break
        if w in names or (len(w) == 1 and text[nxt.end() : nxt.end() + 2].strip()[:1] == "."):
            good = w in names
        elif w in LINKS:
            good = False
        else:
            break
        words.append(w)
        end = nxt.end()
        if good:
            last_good = end
    kept = [w.group() for w in _WORD.finditer(text, m.start(), last_good)]
    return m.start(), last_good, kept


def candidates(text: str, machine: ahocorasick.Automaton, names: frozenset[str], common: frozenset[str]) -> list[Candidate]:
    """All spans that may be personal information, overlapping ones too.

    text: folded. names: known name words. common: words known to stand for no person.
    """
    out: list[Candidate] = []
    taken: set[int] = set()
    hits: dict[int, tuple[str, int]] = {}
    bare = text.encode("latin-1", "replace").translate(_BORDERS).decode("latin-1")
    for end, (kind, n) in machine.iter(f" {bare} "):
        hits[end - n if n == 1 and kind == "at" else end - n - 1] = (kind, n)
    # Addresses and e-mails first: names inside them are told apart by that.
    areas: list[tuple[int, int, str]] = []
    for start in sorted(hits):
        kind, n = hits[start]
        if kind == "at":
            m = _AT.search(text, max(0, start - 2), start + n + 2)
            if not m:
                continue
            local = _SPLIT_LOCAL.search(text[max(0, m.start() - LOCAL_PART) : m.start()])
            domain = _DOMAIN.match(text, m.end())
            left = m.start() - (len(local.group()) if local else 0)
            right = domain.end() if domain else m.end()
            body = domain.group() if domain else ""
            dots = len(re.findall(r"\.|\bponto\b", body))
            key = ("EMAIL", _left(text, left), _right(text, right), dots, bool(re.search("[a-z]{2}", body)), bool(local and re.search("[a-z]{2}", local.group())), n)
            out.append(Candidate("EMAIL", left, right, key))
            if dots and local:
                areas.append((left, right, "e"))
        elif kind == "street":
            end = start + n
            tail = _AFTER_STREET.match(text, end)
            first = tail.group(1) if tail else "$"
            short = n <= 4 and text[end : end + 2].strip()[:1] == "."
            key = ("ENDERECO", text[start:end], short, _left(text, start), first, _left(text, start)[0] in names, first in names)
            right = address_end(text, end)
            out.append(Candidate("ENDERECO", start, right, key))
            areas.append((start, right, "a"))
    inside = lambda at: next((k for a, b, k in areas if a <= at < b), "")
    done_until = -1
    for start in sorted(hits):
        kind, n = hits[start]
        if kind == "cue":
            gap = _AFTER_CUE.match(text, start + n)
            # A full stop or line end after a whole word ends the sentence; after a shortened one it does not.
            if ("." in gap.group(1) or "\n" in gap.group(1)) and text[start : start + n] not in SHORTENED:
                continue
            at = gap.end()
            if at in taken or at <= done_until:
                continue
            span = person_span(text, at, names, True)
            if not span or span[0] <= done_until:
                continue
            cue = text[start : start + n]
        elif kind == "name" and start > done_until and start not in taken:
            span = person_span(text, start, names, False)
            if not span:
                continue
            # A name joined to the one before by "e" is announced with it.
            cue = "e" if done_until >= 0 and text[done_until + 1 : start].strip() == "e" else "-"
        else:
            continue
        a, b, words = span
        if cue not in ("-", "e") and words[0] not in names and hits.get(a, ("", 0))[0] in ("cue", "street"):
            continue
        taken.add(a)
        if words[0] in names:
            done_until = b - 1
        score = sum(w in names for w in words if w not in LINKS) / max(1, sum(w not in LINKS for w in words))
        left = _left(text, a)
        key = ("PESSOA", cue, left, _right(text, b), words[0], "n" if words[0] in names else "c" if words[0] in common else "u", round(score, 1), min(len(words), 6), inside(a), any(w in PLACES or w in STREETS for w in left), left[0] in names)
        out.append(Candidate("PESSOA", a, b, key))
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        raw = m.group().rstrip(" .(-+")
        b = a + len(raw)
        while a > 0 and text[a - 1] in "(+":
            a -= 1
        if a > 0 and text[a - 1] in "0123456789,":
            continue
        shape = _DIGITS.sub(lambda d: str(len(d.group())), _TIGHT.sub(r"\1", text[a:b]).replace(" ", "_"))
        digits = sum(c.isdigit() for c in raw)
        left = _left(text, a, 3)
        # The announcing word may stand before 'no', ':' or a letter code.
        cue = next((w for w in left if w.isalpha() and w not in ("no", "n", "o", "numero", "xq", "mz", "wk") and len(w) > 1), "-")
        key = ("NUMERO", shape[:24], digits, left, cue, _right(text, b), inside(a))
        out.append(Candidate("NUMERO", a, b, key))
    return out


_PART = re.compile(
    r"\s*(?:,|-|;)?\s*(?:no?\s*\.?\s*\d+|s\s*/\s*n\b|km\s*\d+|casa\s*\d+|apto\.?\s*\d+|bloco\s*\w+|quadra\s*\d+(?:\s*lote\s*\d+)?|lote\s*\d+|cep:?\s*\d{5}\s*-?\s*\d{3}|\d+\b(?!\s*(?:mg|ml|,\d|x|/))|bairro(?:\s+[^\W\d_]+){1,4})"
)
_NAME_TAIL = re.compile(r"\s*\.?\s*[^\W\d_]+(?:\s+[^\W\d_]+){0,4}?(?=\s*(?:,|;|-|\.|\bno?\b\s*\d|\bs\s*/\s*n\b|\d|\n|$))")


def address_end(text: str, at: int) -> int:
    """End of the address whose street word ends at `at`: its name, then number, district and code in any order."""
    m = _NAME_TAIL.match(text, at)
    end = m.end() if m else at
    while part := _PART.match(text, end):
        end = part.end()
    district = _DISTRICT.match(text, end)
    if district:
        end = district.end()
        while part := _PART.match(text, end):
            end = part.end()
    return end
