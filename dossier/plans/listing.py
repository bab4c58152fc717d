"""Search over all of a lead's texts and numbers, the default working set, and what the list shows of a lead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sources
from dossier.functions import display, phones, text

from . import phone_numbers, query
from .phone_numbers import _NATIONAL, _RAW
from .resolution import _records

#: Fewer digits than these name no number.
MIN_DIGITS = 5
#: The segments of the driver's tables as labels of leads.
SEGMENTS = {"BUILDING": "FACADE_CONTRACTOR", "MACHINERY": "CONSTRUCTION_MATERIAL_STORE", "AUTOMOBILE": "BOTH", "FURNITURE": "OUT_OF_SCOPE", "HOUSEHOLD": "UNCLASSIFIED"}
_LISTED = ", listed AS (SELECT a.id, a.name, a.score, p.place AS city, CASE classification WHEN 'BUILDING' THEN 'FACADE_CONTRACTOR' WHEN 'MACHINERY' THEN 'CONSTRUCTION_MATERIAL_STORE' WHEN 'AUTOMOBILE' THEN 'BOTH' WHEN 'FURNITURE' THEN 'OUT_OF_SCOPE' ELSE 'UNCLASSIFIED' END AS label FROM active a LEFT JOIN places p ON p.municipality_id = a.municipality_id) "


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """id, name, score, city and label of the active leads."""
    label = F.create_map(*[F.lit(x) for pair in SEGMENTS.items() for x in pair])
    places = sources.places(spark, d).select("municipality_id", F.col("place").alias("city"))
    rows = sources.active(sources.leads(spark, d)).join(places, "municipality_id", "left")
    return rows.select("id", "name", "score", "city", F.coalesce(F.try_element_at(label, F.col("classification")), F.lit(display.UNCLASSIFIED)).alias("label"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """lead_id and e164 of each lead's numbers."""
    return _records(spark, d).select(F.col("id").alias("lead_id"), F.explode("phones").alias("e164"))


def searched(found: DataFrame, numbers: DataFrame, term: str) -> DataFrame:
    """Rows of found whose name or city holds term in any case, whose folded name holds the folded term, or one of whose numbers holds its digits.

    numbers has lead_id and e164; it is read only if the term has five digits or more. An empty term finds all.
    """
    term = term.strip()
    if not term:
        return found
    low = F.lit(term)
    holds = lambda c, t: F.coalesce(F.contains(c, t), F.lit(False))
    hit = holds(F.lower("name"), F.lower(low)) | holds(F.lower("city"), F.lower(low)) | holds(text.fold(F.col("name")), text.fold(low))
    digits = display.typed_digits(term)
    if len(digits) < MIN_DIGITS:
        return found.where(hit)
    called = numbers.where(F.contains("e164", F.lit(digits))).select(F.col("lead_id").alias("id")).distinct().withColumn("called", F.lit(True))
    return found.join(called, "id", "left").where(hit | F.coalesce("called", F.lit(False))).drop("called")


def working_set(found: DataFrame, labels: tuple[str, ...] = (), ruled_out: bool = False) -> DataFrame:
    """Leads of the labels asked for; without any, all but the ruled-out ones unless these are asked for."""
    if labels:
        return found.where(F.col("label").isin(*labels))
    return found if ruled_out else found.where(F.col("label") != display.OUT_OF_SCOPE)


@query(_RAW + "SELECT claim_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\D', '', 'g'), '^00', ''), '^381', ''), '^0', '') AS digits FROM raw")
def searched_digits(spark: SparkSession, d: str) -> DataFrame:
    return phone_numbers._raw(spark, d).select("claim_id", display.search_digits(F.col("raw")).alias("digits"))


@query(_LISTED + """, numbers AS (SELECT c_custkey AS lead_id, unnest(['+38111' || 1000000 + c_custkey * 7919 % 4999, '+3812' || c_custkey % 10 || 100000 + c_custkey * 31 % 899]) AS e164 FROM customer)
SELECT * FROM listed l WHERE contains(lower(name), '011/100-02') OR EXISTS (SELECT 1 FROM numbers x WHERE x.lead_id = l.id AND contains(e164, '1110002'))""")
def search_by_number(spark: SparkSession, d: str) -> DataFrame:
    return searched(_listed(spark, d), _numbers(spark, d), "011/100-02")


@query(_LISTED + "SELECT * FROM listed WHERE contains(lower(name), 'nation_1') OR contains(lower(city), 'nation_1')")
def search_by_place(spark: SparkSession, d: str) -> DataFrame:
    return searched(_listed(spark, d), _numbers(spark, d), " Nation_1 ")


@query(_LISTED + "SELECT label, count(*) AS n FROM listed WHERE label <> 'OUT_OF_SCOPE' GROUP BY 1")
def default_working_set(spark: SparkSession, d: str) -> DataFrame:
    return working_set(_listed(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


@query(_LISTED + "SELECT label, CASE label WHEN 'FACADE_CONTRACTOR' THEN 'Fasaderi' WHEN 'CONSTRUCTION_MATERIAL_STORE' THEN 'Stovarišta' WHEN 'BOTH' THEN 'Oba' WHEN 'OUT_OF_SCOPE' THEN 'Van opsega' ELSE 'Nerazvrstano' END AS shown, label IN ('FACADE_CONTRACTOR', 'CONSTRUCTION_MATERIAL_STORE', 'BOTH') AS in_scope, label = 'UNCLASSIFIED' AS open, count(*) AS n FROM listed GROUP BY 1")
def scope_of_labels(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("label")
    per = _listed(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return per.select("label", display.label_text(label).alias("shown"), display.in_scope(label).alias("in_scope"), (label == display.UNCLASSIFIED).alias("open"), "n")


@query(_RAW + _NATIONAL + "SELECT claim_id, CASE WHEN error IS NOT NULL THEN NULL WHEN regexp_matches(num, '^\\d{8,9}$') THEN '0' || num[1:2] || ' ' || num[3:5] || ' ' || num[6:] ELSE '+381' || num END AS shown, CASE WHEN error IS NULL THEN regexp_matches(num, '^[1-3]') END AS northern FROM e")
def shown_phones(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as they are dialled, and whether the area code is one of the 1 to 3 series; null for what is no number."""
    found = phones.normalized(phone_numbers._raw(spark, d), "raw")  # a filter on error would read every raw text anew
    return found.select("claim_id", display.phone(F.col("e164")).alias("shown"), F.col("e164").rlike(r"^\+381[1-3]").alias("northern"))


_LINKS = "WITH links AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '#top' WHEN 1 THEN url || '/' WHEN 2 THEN 'https://bucket.s3.example.org/x/#' || page_id WHEN 3 THEN 'ftp' || url ELSE url || '/a/long/path/below/the/page/that/no/cell/holds' END AS url FROM pages) "


@query(_LINKS + "SELECT page_id, regexp_matches(url, '^https?://', 'i') AND NOT regexp_matches(url, '[a-z0-9-]+\\.s3\\.', 'i') AND NOT ends_with(split_part(url, '#', 1), '/') AS browsable, CASE WHEN length(b) <= 56 THEN b ELSE left(b, 55) || '…' END AS shown FROM (SELECT *, regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') AS b FROM links)")
def shown_links(spark: SparkSession, d: str) -> DataFrame:
    k, url = F.col("page_id"), F.col("url")
    made = F.when(k % 5 == 0, F.concat(url, F.lit("#top"))).when(k % 5 == 1, F.concat(url, F.lit("/"))).when(k % 5 == 2, F.concat(F.lit("https://bucket.s3.example.org/x/#"), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit("ftp"), url)).otherwise(F.concat(url, F.lit("/a/long/path/below/the/page/that/no/cell/holds")))
    links = sources.table(spark, d, "pages").select("page_id", made.alias("url"))
    return links.select("page_id", display.browsable(F.col("url")).alias("browsable"), display.short_url(F.col("url")).alias("shown"))


@query(_LISTED + "SELECT label, count(*) AS n, regexp_replace(CAST(floor(count(*) FILTER (EXISTS (SELECT 1 FROM phones x WHERE x.lead_id = l.id AND x.valid)) / count(*) * 1000 + 0.5) / 10 AS VARCHAR), '\\.0$', '') || '%' AS with_phone FROM listed l GROUP BY 1")
def phone_share(spark: SparkSession, d: str) -> DataFrame:
    """Leads that can be called, by label."""
    valid = sources.phones(spark, d).where("valid").select(F.col("lead_id").alias("id")).distinct().withColumn("called", F.lit(1))
    per = _listed(spark, d).join(valid, "id", "left").groupBy("label").agg(F.count("*").alias("n"), F.count("called").alias("k"))
    return per.select("label", "n", display.percent(F.col("k"), F.col("n")).alias("with_phone"))
