"""Phone numbers of the Serbian numbering plan: raw text to E.164, type, area code, confidence or an error code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operator and service prefixes, and area codes that no gazetteer has.
MOBILE = ("60", "61", "62", "63", "64", "65", "66", "67", "68", "69")
SERVICE = ("800", "700")
AREA_ONLY = ("28", "29", "38", "39")
#: Area codes of the gazetteer in use; a parameter wherever it matters.
AREAS = ("10", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "21", "22", "23", "24", "25", "26", "27", "30", "31", "32", "33", "34", "35", "36", "37", "230", "280", "290", "390")
SCHEME = r"(?i)^(?:tel|callto|sms|phone|telefon)\s*:\s*"
CHARACTERS = r"^[\d\s+()./-]+$"
DATE = r"^(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\.?|\d{4}-\d{1,2}-\d{1,2})$"


def read(frame: DataFrame, raw: str) -> DataFrame:
    """frame with a struct `phone`: text (trimmed, no scheme), digits, form and national, the number without calling code and trunk zero.

    form is international, country-code or national, null where nothing says which; national is null for another
    country's number. The steps are columns of their own, so that each is computed once.
    """
    text = F.trim(F.regexp_replace(F.trim(F.regexp_replace(raw, r"\s+", " ")), SCHEME, ""))
    frame = frame.withColumn("phone", F.struct(text.alias("text")))
    frame = frame.withColumn("phone", F.struct("phone.text", F.regexp_replace("phone.text", r"\D", "").alias("digits")))
    t, d = F.col("phone.text"), F.col("phone.digits")
    plus = F.startswith(t, F.lit("+"))
    form = F.when(plus | F.startswith(d, F.lit("00")), "international").when(F.startswith(d, F.lit("381")), "country-code").when(F.startswith(d, F.lit("0")), "national")
    frame = frame.withColumn("phone", F.struct("phone.text", "phone.digits", form.alias("form"), F.when(plus, d).otherwise(F.substr(d, F.lit(3))).alias("abroad")))
    after = lambda x: F.regexp_replace(F.substr(x, F.lit(4)), "^0", "")
    abroad, form = F.col("phone.abroad"), F.col("phone.form")
    national = F.when((form == "international") & F.startswith(abroad, F.lit("381")), after(abroad)).when(form == "country-code", after(d)).when(form == "national", F.substr(d, F.lit(2)))
    return frame.withColumn("phone", F.struct("phone.text", "phone.digits", "phone.form", national.alias("national")))


def area_code(number: Column, areas: Sequence[str] = AREAS) -> Column:
    """The longest known prefix of a national number, with its trunk zero; null if none is known."""
    known = sorted({*areas, *AREA_ONLY, *MOBILE, *SERVICE}, key=lambda x: (-len(x), x))
    return F.concat(F.lit("0"), F.regexp_extract(number, f"^({'|'.join(known)})", 1)).alias("area_code")


def kind(number: Column) -> Column:
    """mobile, toll_free, unknown (shared-cost) or landline, by prefix and length; null if the plan has no such number."""
    n = F.length(number)
    return (
        F.when(number.rlike(f"^({'|'.join(MOBILE)})") & n.between(8, 9), "mobile").when(F.startswith(number, F.lit("800")) & n.between(6, 9), "toll_free")
        .when(F.startswith(number, F.lit("700")) & n.between(6, 9), "unknown").when(number.rlike("^[123]") & n.between(8, 9), "landline")
    )


def is_run(number: Column) -> Column:
    """Whether eight or more digits go up, or down, one by one."""
    return (F.length(number) >= 8) & (F.contains(F.lit("0123456789"), number) | F.contains(F.lit("9876543210"), number))


def error(phone: Column) -> Column:
    """Why what `read` gave is no number to call, or null. The first reason counts."""
    t, d, n = phone["text"], phone["digits"], phone["national"]
    return (
        F.when(d == "", "empty").when(t.rlike(DATE), "date").when(~t.rlike(CHARACTERS), "not-a-number").when(F.length(d) < 8, "too-short").when(F.length(d) > 15, "too-long")
        .when(phone["form"].isNull(), "ambiguous-national-number").when(n.isNull(), "foreign").when(n.rlike(r"^(\d)\1+$") | n.rlike(r"(\d)\1{5}$"), "repeated-digits").when(is_run(n), "sequential-digits")
        .when(kind(n).isNull(), "invalid-for-region")
    )


def normalized(frame: DataFrame, raw: str, areas: Sequence[str] = AREAS) -> DataFrame:
    """frame with e164, type, area_code, confidence, which are null where there is an error, and error."""
    frame = read(frame, raw)
    n = F.col("phone.national")
    frame = frame.withColumn("error", error(F.col("phone"))).withColumn("type", F.when(F.col("error").isNull(), kind(n))).withColumn("area_code", F.when(F.col("error").isNull(), area_code(n, areas)))
    unplaced = (F.col("type") == "landline") & ~F.col("area_code").isin([f"0{a}" for a in areas])
    sure = F.when(F.col("phone.form") == "national", 95).otherwise(100) - F.when(unplaced, 15).otherwise(0) - F.when(n.rlike(r"(\d)\1{3,}"), 5).otherwise(0)
    fine = lambda c: F.when(F.col("error").isNull(), c)
    out = frame.withColumn("e164", fine(F.concat(F.lit("+381"), n))).withColumn("confidence", fine(sure / 100))
    return out.withColumn("area_code", F.when(F.col("area_code") != "0", F.col("area_code"))).drop("phone")


def landline_block(e164: Column, areas: Sequence[str] = AREAS) -> Column:
    """struct(area, block): the area code, and all digits of the subscriber but the last two; null for mobiles, other countries and short ones."""
    n = F.substr(e164, F.lit(5))
    code = area_code(n, areas)
    subscriber = F.substr(n, F.length(code))
    return F.when(F.startswith(e164, F.lit("+381")) & (code != "0") & ~F.startswith(code, F.lit("06")) & (F.length(subscriber) >= 4), F.struct(code.alias("area"), F.substr(subscriber, F.lit(1), F.length(subscriber) - 2).alias("block")))
