"""What a list shows: searched digits, numbers, percentages, short links, bands and label groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of a lead, those that name a buyer group, and what the list calls them.
IN_SCOPE = ("FACADE_CONTRACTOR", "CONSTRUCTION_MATERIAL_STORE", "BOTH")
OUT_OF_SCOPE, UNCLASSIFIED = "OUT_OF_SCOPE", "UNCLASSIFIED"
LABELS = {"FACADE_CONTRACTOR": "Fasaderi", "CONSTRUCTION_MATERIAL_STORE": "Stovarišta", "BOTH": "Oba", "UNCLASSIFIED": "Nerazvrstano", "OUT_OF_SCOPE": "Van opsega"}
#: Hosts of object stores, whose links open nothing.
STORE_HOST = r"(?i)[a-z0-9-]+\.s3\."


def search_digits(c: Column) -> Column:
    """Subscriber digits of a typed number: without signs, 00, the calling code and the trunk zero, in that order."""
    digits = F.regexp_replace(c, r"\D", "")
    for prefix in ("00", "381", "0"):
        digits = F.regexp_replace(digits, f"^{prefix}", "")
    return digits


def typed_digits(term: str) -> str:
    """`search_digits` of a term that the driver holds."""
    digits = "".join(x for x in term if x in "0123456789")
    for prefix in ("00", "381", "0"):
        digits = digits.removeprefix(prefix)
    return digits


def phone(e164: Column) -> Column:
    """+381641234567 as 064 123 4567; other numbers stay."""
    return F.when(e164.rlike(r"^\+381\d{8,9}$"), F.regexp_replace(e164, r"^\+381(\d{2})(\d{3})(\d{3,4})$", "0$1 $2 $3")).otherwise(e164)


def percent(part: Column, whole: Column) -> Column:
    """One decimal at most, halves up; a dash where there is nothing to share."""
    shown = F.regexp_replace((F.floor(part / whole * 1000 + 0.5) / 10).cast("string"), r"\.0$", "")
    return F.when(whole == 0, "—").otherwise(F.concat(shown, F.lit("%")))


def short_url(c: Column, width: int = 56) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, "^https?://", ""), "/$", "")
    return F.when(F.length(bare) <= width, bare).otherwise(F.concat(F.left(bare, F.lit(width - 1)), F.lit("…")))


def browsable(c: Column) -> Column:
    """Whether a link opens a page: http, not an object store's, and more than a directory before the fragment."""
    return c.rlike("(?i)^https?://") & ~c.rlike(STORE_HOST) & ~F.endswith(F.split_part(c, F.lit("#"), F.lit(1)), F.lit("/"))


def in_scope(label: Column) -> Column:
    return label.isin(*IN_SCOPE)


def label_text(label: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, label), label)
