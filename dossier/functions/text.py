"""White space, folding and transliteration of text columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Serbian alphabet in both scripts, letter by letter.
CYRILLIC = "а б в г д ђ е ж з и ј к л љ м н њ о п р с т ћ у ф х ц ч џ ш".split()
LATIN = "a b v g d đ e ž z i j k l lj m n nj o p r s t ć u f h c č dž š".split()


def _accented() -> tuple[str, str]:
    """Letters whose canonical decomposition is one plain letter and marks, and those plain letters."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for i in r]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii() and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accented()


def normalize_whitespace(c: Column) -> Column:
    """Zero-width characters go, runs of white space become one space, ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[​‌‍﻿]", ""), r"[\s ]+", " "))


def has_cyrillic(c: Column) -> Column:
    return c.rlike(r"\p{IsCyrillic}")


def _cased(c: Column, letter: str, pair: str) -> Column:
    """An upper-case letter becomes a pair whose second half takes the case of the next letter, else of the one before."""
    up = letter.upper()
    both = F.regexp_replace(F.regexp_replace(c, rf"{up}(?=\p{{Lu}})", pair.upper()), rf"(?<=\p{{Lu}}){up}(?!\p{{Ll}})", pair.upper())
    return F.replace(F.replace(both, F.lit(up), F.lit(pair.title())), F.lit(letter), F.lit(pair))


def to_latin(c: Column) -> Column:
    pairs = list(zip(CYRILLIC, LATIN))
    c = reduce(lambda x, p: _cased(x, *p), [p for p in pairs if len(p[1]) == 2], c)
    one = [p for p in pairs if len(p[1]) == 1]
    return F.translate(c, "".join(a + a.upper() for a, _ in one), "".join(b + b.upper() for _, b in one))


def to_cyrillic(c: Column) -> Column:
    for a, b in sorted(zip(CYRILLIC, LATIN), key=lambda p: -len(p[1])):
        if len(b) == 2:
            for spelled, letter in ((b, a), (b.title(), a.upper()), (b.upper(), a.upper())):
                c = F.replace(c, F.lit(spelled), F.lit(letter))
    one = [(a, b) for a, b in zip(CYRILLIC, LATIN) if len(b) == 1]
    return F.translate(c, "".join(b + b.upper() for _, b in one), "".join(a + a.upper() for a, _ in one))


def fold_diacritics(c: Column) -> Column:
    """Plain letters for accented ones; the letter with a stroke becomes dj in the case of its neighbours."""
    c = F.regexp_replace(_cased(c, "đ", "dj"), "[̀-ͯ]", "")
    return F.translate(c, _FROM, _TO)


def fold(c: Column) -> Column:
    """The form that texts are compared in: Latin, without diacritics, white space normalised, lower case."""
    return F.lower(fold_diacritics(normalize_whitespace(to_latin(c))))


def diacritic_variants(c: Column) -> Column:
    return F.array_distinct(F.array(c, fold_diacritics(c)))
