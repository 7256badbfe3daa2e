"""Folding of words and codes for comparison, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters of Portuguese and its neighbours, and what they fold to.
_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"

#: White space as Unicode has it, for trims beyond U+0020.
_OUTER = r"(?U)^\s+|\s+$"


def strip_accents(c: Column) -> Column:
    """Composed and decomposed accents off: combining marks go, accented letters map to plain ones."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), _ACCENTED, _PLAIN)


def fold_code(c: Column) -> Column:
    """A code for comparison without case, accents and outer blanks; null stays null."""
    return F.lower(strip_accents(F.regexp_replace(c, _OUTER, "")))


def patient_number(c: Column) -> Column:
    """The number a patient code spells ('0000010282', ' 10067', '10013.0'); null for null, blank, 0 or no number."""
    digits = F.regexp_extract(F.regexp_replace(c, r"(?U)\s", ""), r"^0*(\d{1,18})(?:[.,]0*)?$", 1)
    return F.nullif(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
