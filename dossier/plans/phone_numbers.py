"""Numbers as listings write them, made from the orders' keys in each form that the plan knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sources
from dossier.functions import phones

from . import query

_FORMS = ("+381 (0)11 %s", "00381 64/%s", "38121%s", "063 %s-1", "tel: 010/%s", "%s", "12.05.2021", "0800 %s", "+43 1 %s5", "call %s", "018-222222", "06012345678", "030%s", "0%s")
_RAW = ", raw AS (SELECT o_orderkey AS claim_id, replace([" + ", ".join(f"'{f}'" for f in _FORMS) + f"][o_orderkey % {len(_FORMS)} + 1], '%s', lpad(CAST(o_orderkey * 7919 % 1000000 AS VARCHAR), 6, '0')) AS raw FROM orders) "
_KNOWN = "|".join(sorted({*phones.AREAS, *phones.AREA_ONLY, *phones.MOBILE, *phones.SERVICE}, key=lambda x: (-len(x), x)))
_NATIONAL = r""", c AS (SELECT *, trim(regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '^(?:tel|callto|sms|phone|telefon)\s*:\s*', '', 'i')) AS t FROM raw),
f AS (SELECT *, regexp_replace(t, '\D', '', 'g') AS d FROM c),
g AS (SELECT *, CASE WHEN t[1] = '+' OR d[1:2] = '00' THEN 'international' WHEN d[1:3] = '381' THEN 'country-code' WHEN d[1] = '0' THEN 'national' END AS form, CASE WHEN t[1] = '+' THEN d ELSE d[3:] END AS abroad FROM f),
n AS (SELECT *, CASE WHEN form = 'international' AND abroad[1:3] = '381' THEN regexp_replace(abroad[4:], '^0', '') WHEN form = 'country-code' THEN regexp_replace(d[4:], '^0', '') WHEN form = 'national' THEN d[2:] END AS num FROM g),
k AS (SELECT *, CASE WHEN regexp_matches(num, '^6') AND length(num) BETWEEN 8 AND 9 THEN 'mobile' WHEN num[1:3] = '800' AND length(num) BETWEEN 6 AND 9 THEN 'toll_free' WHEN num[1:3] = '700' AND length(num) BETWEEN 6 AND 9 THEN 'unknown'
WHEN regexp_matches(num, '^[123]') AND length(num) BETWEEN 8 AND 9 THEN 'landline' END AS kind FROM n),
e AS (SELECT *, CASE WHEN d = '' THEN 'empty' WHEN regexp_matches(t, '^(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\.?|\d{4}-\d{1,2}-\d{1,2})$') THEN 'date' WHEN NOT regexp_matches(t, '^[\d\s+()./-]+$') THEN 'not-a-number'
WHEN length(d) < 8 THEN 'too-short' WHEN length(d) > 15 THEN 'too-long' WHEN form IS NULL THEN 'ambiguous-national-number' WHEN num IS NULL THEN 'foreign'
WHEN regexp_matches(num, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') OR regexp_matches(num, '(0{6}|1{6}|2{6}|3{6}|4{6}|5{6}|6{6}|7{6}|8{6}|9{6})$') THEN 'repeated-digits'
WHEN length(num) >= 8 AND (contains('0123456789', num) OR contains('9876543210', num)) THEN 'sequential-digits' WHEN kind IS NULL THEN 'invalid-for-region' END AS error, '0' || regexp_extract(num, '^(""" + _KNOWN + r""")', 1) AS code FROM k) """
_AREAS = tuple(f"0{a}" for a in phones.AREAS)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    written = F.element_at(F.array(*map(F.lit, _FORMS)), (key % len(_FORMS) + 1).cast("int"))
    return sources.table(spark, d, "orders").select(key.alias("claim_id"), F.replace(written, F.lit("%s"), F.lpad((key * 7919 % 1_000_000).cast("string"), 6, "0")).alias("raw"))


@query(_RAW + _NATIONAL + f"""SELECT claim_id, CASE WHEN error IS NULL THEN '+381' || num END AS e164, CASE WHEN error IS NULL THEN kind END AS type, CASE WHEN error IS NULL AND code <> '0' THEN code END AS area_code,
CASE WHEN error IS NULL THEN (CASE WHEN form = 'national' THEN 95 ELSE 100 END - CASE WHEN kind = 'landline' AND code NOT IN {_AREAS} THEN 15 ELSE 0 END
- CASE WHEN regexp_matches(num, '0000|1111|2222|3333|4444|5555|6666|7777|8888|9999') THEN 5 ELSE 0 END) / 100.0::DOUBLE END AS confidence, error FROM e""")
def normalized_phones(spark: SparkSession, d: str) -> DataFrame:
    return phones.normalized(_raw(spark, d), "raw").select("claim_id", "e164", "type", "area_code", "confidence", "error")


@query(_RAW + _NATIONAL + "SELECT coalesce(error, 'accepted') AS outcome, count(*) AS n FROM e GROUP BY 1")
def phone_rejections(spark: SparkSession, d: str) -> DataFrame:
    return phones.read(_raw(spark, d), "raw").groupBy(F.coalesce(phones.error(F.col("phone")), F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query(_RAW + _NATIONAL + "SELECT code AS area, num[length(code):-3] AS block, count(DISTINCT num) AS n_numbers FROM e WHERE error IS NULL AND code <> '0' AND code[1:2] <> '06' AND length(num[length(code):]) >= 4 GROUP BY 1, 2")
def landline_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Landlines by area code and subscriber range, all digits but the last two."""
    found = phones.normalized(_raw(spark, d), "raw").withColumn("b", phones.landline_block(F.col("e164")))
    # rows without a block go after the count: before it the filter would be computed anew from the raw text
    return found.groupBy("b.area", "b.block").agg(F.count_distinct(F.when(F.col("b").isNotNull(), F.col("e164"))).alias("n_numbers")).where("n_numbers > 0")


@query(_RAW + _NATIONAL + "SELECT code AS area_code, count(*) AS n, count(*) FILTER (code NOT IN " + str(_AREAS) + ") AS n_unplaced FROM e WHERE error IS NULL AND kind = 'landline' GROUP BY 1")
def landline_areas(spark: SparkSession, d: str) -> DataFrame:
    found = phones.normalized(_raw(spark, d), "raw")
    line = F.coalesce(F.col("type") == "landline", F.lit(False))
    unplaced = F.coalesce(~F.col("area_code").isin(*_AREAS), F.lit(True))
    return found.groupBy(F.coalesce("area_code", F.lit("0")).alias("area_code")).agg(F.count_if(line).alias("n"), F.count_if(line & unplaced).alias("n_unplaced")).where("n > 0")
