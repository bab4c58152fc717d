"""Company names: legal forms, trade names in quotes, places at the end; how alike two of them are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .scoring import char_similarity, half_up

# Legal forms with the words that spell them, in the order they are looked for.
FORMS = {
    "zanatska radnja": ("zanatska radnja",), "preduzetnik": ("preduzetnik",), "d.o.o.": ("d o o", "doo"), "sztr": ("s z t r", "sztr"), "szr": ("s z r", "szr"), "str": ("s t r", "str"),
    "sur": ("sur",), "ptr": ("ptr",), "pr": ("pr",), "sr": ("sr",), "zr": ("zr",), "a.d.": ("a d", "ad"),
}
#: A form that is also an ordinary syllable counts at the ends only.
AT_ENDS = ("a.d.",)
NOISE = ("srbija", "serbia", "rs")
GENERIC = (
    "and bau beton braca centar co commerce company comp dom export fasada fasade fasader fasaderi fasaderske fasaderski grada gradjenje gradjevina gradjevinar gradjevinski gradjevinsko gradnja group grupa"
    " i import inzenjering invest izgradnja izolacija kompanija komerc komerce kuca materijal materijali plus prodaja projekt promet radnja radovi servis sin sinovi sistem sistemi sons stiropor stovariste"
    " termo termoizolacija trade trgovina usluge"
).split()
QUOTES = "\"'„“”‘’«»‹›"
GENERIC_WEIGHT, SAME_WORD, SAME_NAME, DISCOUNT, ALIKE = 0.35, 0.85, 0.92, 0.7, 0.82


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _without(c: Column, words: str, at_ends: bool = False) -> Column:
    """c without these words wherever they stand between others, but never without all of its words."""
    if at_ends:
        return F.regexp_replace(c, rf"^(?:{words})\s+(?=\S)|(?<=\S)\s+(?:{words})$", "")
    return F.regexp_replace(c, rf"(?<!\S)(?:{words})\s+(?=\S)|(?<=\S)\s+(?:{words})(?!\S)", "")


def without_forms(c: Column) -> Column:
    return reduce(lambda x, f: reduce(lambda y, w: _without(y, w, f in AT_ENDS), FORMS[f], x), FORMS, c)


def legal_form(c: Column) -> Column:
    """The first legal form, in their order, among single-spaced words; null if there is none."""
    found = lambda f: c.rlike(rf"^(?:{'|'.join(FORMS[f])})(?!\S)|(?<!\S)(?:{'|'.join(FORMS[f])})$" if f in AT_ENDS else rf"(?<!\S)(?:{'|'.join(FORMS[f])})(?!\S)")
    return F.coalesce(*[F.when(found(f), f) for f in FORMS])


def normalized(frame: DataFrame, raw: str, places: Sequence[str]) -> DataFrame:
    """frame with display, normalized, ascii, legal_form, trade_name, city_hint and tokens of the company name in column raw.

    places: names of the gazetteer, which a country bounds. A name in quotes is the business; the form and the place are read
    around it as well. A place goes from the end only, and no step leaves a name without words. Null stays null.
    """
    spelled: Mapping[str, str] = {key: p for p in places for key in (p.lower(), _plain(p))}
    some = "|".join(sorted(map(_escaped, spelled), key=lambda x: (-x.count(" "), -len(x), x)))
    city_map = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    city = lambda c: F.try_element_at(city_map, F.regexp_extract(c, rf"(?<=\S) ({some})$", 1))
    whole = lambda c: F.try_element_at(city_map, F.regexp_extract(c, rf"(?:^|\s)({some})$", 1))
    quoted = f"[{QUOTES}]([^{QUOTES}]{{2,}})[{QUOTES}]"
    display = text.normalize_whitespace(F.col(raw))
    out = frame.withColumn("display", display).withColumn("__latin", F.when(text.has_cyrillic(F.col("display")), text.to_latin(F.col("display"))).otherwise(F.col("display")))
    latin = F.col("__latin")
    out = out.withColumn("trade_name", F.when(latin.rlike(quoted), text.normalize_whitespace(F.regexp_extract(latin, quoted, 1))))
    trade = F.col("trade_name")
    out = out.withColumns({
        "__all": _words(latin), "__t0": _words(F.coalesce(trade, latin)),
        "__before": F.when(trade.isNotNull(), _words(F.regexp_extract(latin, f"(?s)^(.*?){quoted}", 1))), "__after": F.when(trade.isNotNull(), _words(F.regexp_extract(latin, f"(?s)^.*?{quoted}(.*)$", 2))),
    })
    for i in range(3):
        t = F.col(f"__t{i}")
        out = out.withColumn(f"__c{i}", city(t)).withColumn(f"__t{i + 1}", without_forms(F.regexp_replace(t, rf"(?<=\S) (?:{some})$", "")))
    out = out.withColumn("normalized", reduce(_without, NOISE, F.col("__t3")))
    around = [whole(without_forms(F.col(c))) for c in ("__before", "__after")]
    out = out.withColumn("legal_form", F.coalesce(legal_form(F.col("__all")), legal_form(F.col("__before")), legal_form(F.col("__after"))))
    out = out.withColumn("city_hint", F.coalesce("__c0", "__c1", "__c2", *around)).withColumn("ascii", F.lower(text.fold_diacritics(F.col("normalized"))))
    return out.withColumn("tokens", F.filter(F.split("ascii", " "), lambda x: x != "")).drop("__latin", "__all", "__before", "__after", *[f"__t{i}" for i in range(4)], *[f"__c{i}" for i in range(3)])


def _plain(name: str) -> str:
    import unicodedata

    return "".join(x for x in unicodedata.normalize("NFD", name.lower().replace("đ", "dj")) if not unicodedata.combining(x))


def _escaped(name: str) -> str:
    return "".join(x if x.isalnum() or x == " " else " " for x in name)


def weight(token: Column) -> Column:
    return F.when(token.isin(*GENERIC), GENERIC_WEIGHT).otherwise(1.0)


def token_similarity(a: Column, b: Column) -> Column:
    """Weight of the words that a and b share over their mean weight. Each word pairs once, the most alike first; ties go by place."""
    pairs = F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.struct((-char_similarity(x, y)).alias("near"), i.alias("i"), j.alias("j"), F.least(weight(x), weight(y)).alias("w")))))
    near = F.array_sort(F.filter(pairs, lambda p: -p["near"] >= SAME_WORD))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0.0).alias("sum"), none.alias("i"), none.alias("j"))
    taken = lambda acc, p: F.array_contains(acc["i"], p["i"]) | F.array_contains(acc["j"], p["j"])
    add = lambda acc, p: F.struct((acc["sum"] - p["w"] * p["near"]).alias("sum"), F.array_append(acc["i"], p["i"]).alias("i"), F.array_append(acc["j"], p["j"]).alias("j"))
    matched = F.aggregate(near, start, lambda acc, p: F.when(taken(acc, p), acc).otherwise(add(acc, p)), lambda acc: acc["sum"])
    total = lambda c: F.aggregate(F.transform(c, weight), F.lit(0.0), lambda x, y: x + y)
    mean = (total(a) + total(b)) / 2
    return F.when(mean == 0, 0.0).otherwise(F.least(F.lit(1.0), matched / mean))


def similarity(a: Column, b: Column) -> Column:
    """0 to 1 of two token arrays: the better of shared words and of letters, which count less unless nearly all agree."""
    letters = char_similarity(F.array_join(a, ""), F.array_join(b, ""))
    less = F.when(letters >= SAME_NAME, letters).otherwise(letters * DISCOUNT)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), letters).otherwise(half_up(F.greatest(token_similarity(a, b), less), 3))
