"""Text functions on columns: cleaning, masking, segmentation, tokens and token features."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from garimpo.functions import patterns as P

#: Stands for the full stop of an abbreviation while sentences are split; a private-use character, so no text holds it.
_KEPT_STOP = "\ue000"


def _cheap_first(pattern: str) -> str:
    """The same pattern with a test of one character in front, which fails at once nearly everywhere, where a word border or look-behind would come first."""
    flag, rest = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    head, mark, after = rest.partition("{0,9})\\b")
    if mark and head.startswith("(?<!"):
        return rf"(?=\d)\b{head}{{0,9}}){after}"
    if rest.startswith((r"\b\d", r"\b3", r"\b(?:0?[1-9]", r"\b(?:(?:0?[1-9]", r"(?<!\d)\d")):
        return rf"{flag}(?=\d){rest}"
    words = re.match(r"\(?(?:\\b|\(\?:)?(\w[\w|?\\.\[\]]*)", rest)
    if flag and words:
        firsts = "".join(sorted({w[0].lower() for w in words[1].split("|")}))
        return f"{flag}(?=[{firsts}]){rest}"
    return pattern


def _rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules one after the other."""
    for pattern, to in rules:
        c = F.regexp_replace(c, f"(?U){_cheap_first(pattern)}", to)
    return c


def _bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) for a c that is needed more than once: a one-element array names it, so it is computed once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _stepwise(c: Column, rules: list[tuple[str, str]], needs: list[tuple[int, str]]) -> Column:
    """The rules one after the other; needs: (number of rules, what their matches hold) for runs of them, a sign or a cheap pattern.

    A run whose sign or pattern the text lacks is skipped; "" never.
    """

    def unless_absent(need: str, mine: list[tuple[str, str]]) -> Callable[[Column], Column]:
        return lambda v: F.when(F.contains(v, F.lit(need)) if len(need) == 1 else v.rlike(need), _rules(v, mine)).otherwise(v)

    at = 0
    for n, need in needs:
        mine = rules[at : at + n]
        at += n
        c = _bound(c, unless_absent(need, mine)) if need else _rules(c, mine)
    return _rules(c, rules[at:])


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Composed accents; null becomes the empty text. The JVM has no built-in, so only this step leaves it."""
    return _nfc(F.coalesce(c, F.lit("")))


def drop_controls(c: Column, compat: bool = False) -> Column:
    """Without control, format, surrogate and private characters except line ends; tabs become blanks first, not so with compat."""
    base = c if compat else F.translate(c, "\t", " ")
    return F.regexp_replace(base, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}&&[^\n]]", "")


def collapse_spaces(c: Column) -> Column:
    """One blank for several, and none at the ends of lines."""
    return F.regexp_replace(F.regexp_replace(c, " {2,}", " "), r"(?mdU)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")


#: What a match of the glue rules holds; most texts lack most of it.
_GLUE_NEEDS = [(2, rf"(?U)\d{P.UPPER}{{4}}"), (2, rf"\.{P.UPPER}{{4}}"), (1, "_"), (2, "/"), (1, rf"\.{P.UPPER}{P.LOWER}"), (1, ","), (1, r"(?U)\d,\d"), (1, rf"(?U)\d\.{P.UPPER}{{4}}")]


def split_glued(c: Column) -> Column:
    """Words that stick together, apart."""
    return _stepwise(c, P.GLUE, _GLUE_NEEDS)


def mask_dates(c: Column) -> Column:
    return _stepwise(c, P.DATES, [(2, r"(?U)-\d\d-"), (2, "/"), (1, r"(?U)[-–]\s*\d{1,2}\s*[-–]"), (1, "\\"), (1, r"(?U)\.\d{1,2}\.\d"), (1, r"(?iU)de\s+\d{4}")])


def mask_hours(c: Column) -> Column:
    return _stepwise(c, P.HOURS, [(5, r"(?U):\d"), (4, r"(?iU)\dh"), (1, "(?iU)às")])


def mask_cpf(c: Column) -> Column:
    return _stepwise(c, P.CPF, [(1, r"(?U)\.\d{3}\."), (1, r"(?U)\d{11}")])


def mask_phones(c: Column) -> Column:
    return _stepwise(c, P.PHONES, [(1, r"(?U)\.\d+\s*-"), (4, "("), (1, r"(?U)9\s+\d{4}"), (2, r"(?U)-\s*\d{4}"), (2, r"(?U)\d{9}"), (1, r"(?U)\.\d{4}"), (2, r"(?U)\d{8}"), (1, r"(?U)-\s*\d{4}")])


def mask_ceps(c: Column) -> Column:
    return _stepwise(c, P.CEP, [(1, r"(?U)-\d{3}"), (1, r"(?U)\d{8}")])


def mask_emails(c: Column) -> Column:
    return _stepwise(c, P.EMAIL, [(1, "@")])


def mask_all(c: Column) -> Column:
    """Masks in their order: dates, times, taxpayer numbers, telephones, postal codes, e-mails.

    Texts without a digit or @ skip all of them.
    """

    def masked(t: Column) -> Column:
        out = t
        for step in (mask_dates, mask_hours, mask_cpf, mask_phones, mask_ceps, mask_emails):
            out = step(out)
        return F.when(t.rlike(r"[\p{Nd}@]"), out).otherwise(t)

    return _bound(c, masked)


def normalize(c: Column, compat: bool = False) -> Column:
    """The whole normalisation of a text; null becomes the empty text."""
    return mask_all(split_glued(collapse_spaces(drop_controls(nfc(c), compat))))


def text_type(c: Column) -> Column:
    """'desconhecido' for null, 'template_estruturado' if a template mark occurs, else 'texto_livre'."""
    marked = F.lit(False)
    for mark in P.TEMPLATE_MARKS:
        marked = marked | F.contains(c, F.lit(mark))
    return F.when(c.isNull(), "desconhecido").when(marked, "template_estruturado").otherwise("texto_livre")


def blank_tokens(c: Column) -> Column:
    """Tokens between white space; none for null."""
    return F.coalesce(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != ""), F.array().cast("array<string>"))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def sentences(c: Column, least: int = 3) -> Column:
    """Sentences of a text with at least `least` words: by lines in templates, else after . ! ? and white space.

    Full stops of abbreviations end no sentence.
    """
    names = "|".join(P.ABBREVIATIONS)
    kept = F.regexp_replace(c, rf"(?U)\b({names})\.", f"$1{_KEPT_STOP}")
    parts = F.when(text_type(c) == "template_estruturado", F.split(kept, "\n")).otherwise(F.split(kept, r"(?U)(?<=[.!?])\s+"))
    whole = F.transform(_trimmed(parts), lambda s: F.translate(s, _KEPT_STOP, "."))
    return F.coalesce(F.filter(whole, lambda s: F.size(blank_tokens(s)) >= least), F.array().cast("array<string>"))


def word_tokens(c: Column, pattern: str = P.TOKEN) -> Column:
    """Words, numbers, placeholders and single signs of a text."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def token_offsets(text: Column, tokens: Column) -> Column:
    """(ini, fim) of each token by forward search from the end of the one before; fim is exclusive, places count from 0."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<ini:int,fim:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        # The found place is needed twice; a one-element transform names it.
        return F.transform(
            F.array(F.call_function("locate", t, text, acc["at"])),
            lambda p: F.struct(
                (p + F.length(t)).alias("at"), F.concat(acc["spans"], F.array(F.struct((p - 1).cast("int").alias("ini"), (p - 1 + F.length(t)).cast("int").alias("fim")))).alias("spans")
            ),
        )[0]

    return F.aggregate(tokens, start, step, lambda acc: acc["spans"])


def is_upper(t: Column) -> Column:
    return t.rlike(r"\p{IsUppercase}") & ~t.rlike(r"[\p{IsLowercase}\p{Lt}]")


def is_title(t: Column) -> Column:
    return t.rlike(r"^\P{L}*[\p{Lu}\p{Lt}]\p{Ll}*(?:\P{L}+[\p{Lu}\p{Lt}]\p{Ll}*)*\P{L}*$")


def token_features(tokens: Column) -> Column:
    """One struct per token: form, affixes, flags, and its neighbours (null at the ends)."""
    n = F.size(tokens)

    def at(i: Column, k: int) -> Column:
        return F.get(tokens, i + F.lit(k))

    def features(t: Column, i: Column) -> Column:
        stem = F.regexp_replace(t, r"\.$", "")
        own = {
            "lower": F.lower(t),
            "suffix2": F.right(F.lower(t), F.lit(2)),
            "suffix3": F.right(F.lower(t), F.lit(3)),
            "prefix2": F.left(F.lower(t), F.lit(2)),
            "prefix3": F.left(F.lower(t), F.lit(3)),
            "isupper": is_upper(t),
            "istitle": is_title(t),
            "isdigit": t.rlike(r"^[\p{Nd}²³¹]+$"),
            "is_abrev": stem.isin(P.ABBREVIATIONS),
            "is_placeholder": t.rlike(r"^__.*__$"),
            "is_first": i == 0,
            "is_last": i == n - 1,
        }
        near = {f"{name}_lower": F.lower(at(i, k)) for name, k in (("prev", -1), ("prev2", -2), ("next", 1), ("next2", 2))}
        near |= {f"{name}_is{kind}": f(at(i, k)) for name, k in (("prev", -1), ("next", 1)) for kind, f in (("upper", is_upper), ("title", is_title))}
        ends = {"BOS": i == 0, "EOS": i == n - 1}
        return F.struct(*[v.alias(k) for k, v in (own | near | ends).items()])

    return F.transform(tokens, features)


def detected_types(text: Column) -> Column:
    """Types of protected information that the detectors see in a text, in the detectors' order."""
    flags = [F.when(text.rlike(f"(?U){pattern}"), F.lit(name)) for name, (pattern, _) in P.DETECTORS.items()]
    return F.filter(F.array(*flags), lambda t: t.isNotNull())


def strip_outer_signs(t: Column) -> Column:
    """Upper case without outer punctuation: the form in which word lists are looked up."""
    return F.upper(F.regexp_replace(t, r"^[.,;:()]+|[.,;:()]+$", ""))


def pseudonym(code: Column, salt: str) -> Column:
    """Hex SHA-256 of salt and code; the salt is the caller's secret and has no default."""
    return F.sha2(F.concat(F.lit(salt), code), 256)


def slug(name: Column) -> Column:
    """File prefix of an experiment's name: signs off, white space to _, and a final _; empty for null."""
    return F.coalesce(F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s-]", ""), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "_"), F.lit("_")), F.lit(""))


def local_float(c: Column) -> Column:
    """Number with a decimal comma; null for empty or unreadable text."""
    return F.nullif(F.trim(F.translate(c, ",", ".")), F.lit("")).try_cast("double")


# Month names, with and without accents.
_MONTHS = {m: i for i, ms in enumerate((("janeiro",), ("fevereiro",), ("marco", "março"), ("abril",), ("maio",), ("junho",), ("julho",), ("agosto",), ("setembro",), ("outubro",), ("novembro",), ("dezembro",)), 1) for m in ms}


def iso_dates(text: str) -> str:
    """Text with its dates as yyyy-MM-dd: numbers parted by / - \\ or . and dates with month names.

    A slash date needs no plausible day; its numbers are swapped if a four-digit year
    follows a second number above 12. The other forms need a day and a month, in either
    order. Short years count from 2000. Dates already in ISO form stay.
    """

    def iso(day: int, month: int, year: str) -> str:
        return f"{int(year) if len(year) == 4 else 2000 + int(year):04d}-{month:02d}-{day:02d}"

    def numbers(m: re.Match) -> str:
        if m["iso"]:
            return m.group()
        if m["name"]:
            return iso(int(m["nd"]), _MONTHS[m["name"].lower()], m["ny"])
        a, b, year = int(m["a"]), int(m["b"]), m["y"]
        sign = m["sign"].strip()
        if sign == "/":
            return iso(b, a, year) if len(year) == 4 and b > 12 else iso(a, b, year)
        if 1 <= a <= 31 and 1 <= b <= 12:
            return iso(a, b, year)
        return iso(b, a, year) if 1 <= b <= 31 and 1 <= a <= 12 else m.group()

    return _ANY_DATE.sub(numbers, text)


_ANY_DATE = re.compile(
    r"(?P<iso>\b\d{4}-\d{2}-\d{2}\b)|\b(?P<a>\d{1,2})(?P<sign>\s*[/\-–\\]\s*|\.)(?P<b>\d{1,2})(?P=sign)(?P<y>\d{2,4})\b(?!\.\d)"
    r"|\b(?P<nd>0?[1-9]|[12]\d|3[01])\s+de\s+(?P<name>" + "|".join(_MONTHS) + r")\s+de\s+(?P<ny>\d{4})\b",
    re.IGNORECASE,
)


@F.pandas_udf(StringType())
def dates_to_iso(texts: pd.Series) -> pd.Series:
    """iso_dates() of a column; masks do not need it, only outputs that keep dates."""
    return texts.map(iso_dates, na_action="ignore")
