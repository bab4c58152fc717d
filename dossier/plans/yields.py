"""Yield of a crawl by scope (unit and arm of the search), its plan and roll-up, overlaps, completeness, targets, rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier import sources
from dossier.functions import display

from . import query
from .resolution import _RECORDS, _records

#: Arms of a search in the order they are walked, with the categories that lead to the first two; the rest are found by name.
ARMS = {"contractor-category": ("BUILDING", "MACHINERY"), "store-category": ("HOUSEHOLD",), "name-match": ()}
UNASSIGNED = "unassigned"
# What each missing field of a lead would gain; what each field counts for the completeness of a record.
GAIN = {"phone": 42, "email": 6, "website": 8, "social": 4, "address": 2, "city": 10}

#: What a search found, by rules of the key, for the SQL side.
_FOUND = """WITH found AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 17 = 0 THEN 'unassigned' ELSE CAST(c_nationkey AS VARCHAR) END AS unit, CASE WHEN c_custkey % 5 <> 0 THEN 'city ' || c_custkey % 4 ELSE 'unassigned' END AS city,
CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'contractor-category' WHEN c_mktsegment IN ('HOUSEHOLD') THEN 'store-category' ELSE 'name-match' END AS arm, c_mktsegment AS category,
c_custkey % 3 <> 0 AS phone, c_custkey % 2 = 0 AS website, c_custkey % 7 = 0 AS email, c_custkey * 31 % 97 / 10::DOUBLE + 15 AS x, c_custkey * 17 % 89 / 10::DOUBLE + 38 AS y, CASE c_custkey % 6 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' END AS status FROM customer),
grid AS (SELECT unit, arm FROM (SELECT CAST(n_nationkey AS VARCHAR) AS unit FROM nation UNION ALL SELECT 'unassigned'), (SELECT unnest(['contractor-category', 'store-category', 'name-match']) AS arm)),
plan AS (SELECT g.unit, g.arm, count(id) AS records, count(*) FILTER (phone) AS with_phone, count(*) FILTER (website) AS with_website, count(*) FILTER (email) AS with_email, count(*) FILTER (website AND NOT phone) AS targets FROM grid g LEFT JOIN found f ON f.unit = g.unit AND f.arm = g.arm GROUP BY 1, 2) """


def arm_of(category: Column) -> Column:
    """The arm that finds a category; a null or unknown one is found by name."""
    first, second, last = ARMS
    return F.when(category.isin(*ARMS[first]), first).when(category.isin(*ARMS[second]), second).otherwise(last)


def _found(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return sources.table(spark, d, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.when(k % 17 == 0, UNASSIGNED).otherwise(F.col("c_nationkey").cast("string")).alias("unit"), F.when(k % 5 != 0, F.concat(F.lit("city "), (k % 4).cast("string"))).otherwise(UNASSIGNED).alias("city"),
        arm_of(F.col("c_mktsegment")).alias("arm"), F.col("c_mktsegment").alias("category"), (k % 3 != 0).alias("phone"), (k % 2 == 0).alias("website"), (k % 7 == 0).alias("email"), (k * 31 % 97 / 10.0 + 15).alias("x"), (k * 17 % 89 / 10.0 + 38).alias("y"),
        F.when(k % 6 == 0, "closed").when(k % 6 == 1, "open").alias("status"),
    )


def scope_yields(found: DataFrame) -> DataFrame:
    """Records by unit and arm, what they carry, and by_city, a map of counts. Cities are counted before they are gathered, so a map has one entry a city."""
    n = lambda c: F.count_if(c)
    cities = found.groupBy("unit", "arm", "city").agg(F.count("*").alias("records"), n(F.col("phone")).alias("with_phone"), n(F.col("website")).alias("with_website"), n(F.col("email")).alias("with_email"), n(F.col("website") & ~F.col("phone")).alias("targets"))
    sums = [F.sum(c).alias(c) for c in ("records", "with_phone", "with_website", "with_email", "targets")]
    return cities.groupBy("unit", "arm").agg(*sums, F.map_from_entries(F.array_sort(F.collect_list(F.struct("city", "records")))).alias("by_city"))


def plan_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Every unit by every arm with its yield, scopes without records included: those are a finding."""
    units = sources.places(spark, d).select(F.col("municipality_id").cast("string").alias("unit")).unionByName(spark.range(1).select(F.lit(UNASSIGNED).alias("unit")))
    grid = units.select("unit", F.explode(F.array(*map(F.lit, ARMS))).alias("arm"))
    return grid.join(scope_yields(_found(spark, d)).drop("by_city"), ["unit", "arm"], "left").na.fill(0)


@query(_FOUND + """, c AS (SELECT unit, arm, city, count(*) AS n FROM found GROUP BY 1, 2, 3) SELECT p.unit, p.arm, records, with_phone, with_website, with_email, targets, by_city FROM plan p
JOIN (SELECT unit, arm, string_agg(city || '=' || n, ', ' ORDER BY city) AS by_city FROM c GROUP BY 1, 2) x ON x.unit = p.unit AND x.arm = p.arm""")
def yield_by_scope(spark: SparkSession, d: str) -> DataFrame:
    shown = F.array_join(F.transform(F.map_entries("by_city"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    return scope_yields(_found(spark, d)).withColumn("by_city", shown)


@query(_FOUND + "SELECT * FROM plan")
def planned_scopes(spark: SparkSession, d: str) -> DataFrame:
    return plan_scopes(spark, d)


@query(_FOUND + """SELECT CAST(sum(records) AS BIGINT) AS records, CAST(sum(with_phone) AS BIGINT) AS with_phone, CAST(sum(with_website) AS BIGINT) AS with_website, CAST(sum(with_email) AS BIGINT) AS with_email, CAST(sum(targets) AS BIGINT) AS targets,
count(DISTINCT unit) FILTER (records > 0 AND unit <> 'unassigned') AS units_covered, count(DISTINCT unit) FILTER (unit <> 'unassigned') AS units_total, CAST(coalesce(sum(records) FILTER (unit = 'unassigned'), 0) AS BIGINT) AS unassigned FROM plan""")
def scope_summary(spark: SparkSession, d: str) -> DataFrame:
    known = F.col("unit") != UNASSIGNED
    sums = [F.sum(c).alias(c) for c in ("records", "with_phone", "with_website", "with_email", "targets")]
    return plan_scopes(spark, d).agg(*sums, F.count_distinct(F.when(known & (F.col("records") > 0), F.col("unit"))).alias("units_covered"), F.count_distinct(F.when(known, F.col("unit"))).alias("units_total"), F.sum(F.when(~known, F.col("records")).otherwise(0)).alias("unassigned"))


@query(_FOUND + "SELECT id, name, arm FROM found WHERE x BETWEEN 18.8 AND 23.1 AND y BETWEEN 42.2 AND 46.3 AND (status IS NULL OR status <> 'closed') AND name IS NOT NULL AND (arm <> 'name-match' OR regexp_matches(lower(name), '(1|7)\\d$'))")
def extract_filter(spark: SparkSession, d: str) -> DataFrame:
    """Places inside the box that are not closed and whose category or name fits."""
    box = F.col("x").between(18.8, 23.1) & F.col("y").between(42.2, 46.3)
    fits = (F.col("arm") != "name-match") | F.lower("name").rlike(r"(1|7)\d$")
    return _found(spark, d).where(box & ~F.coalesce(F.col("status") == "closed", F.lit(False)) & F.col("name").isNotNull() & fits).select("id", "name", "arm")


@query(_FOUND + "SELECT arm, category, count(*) AS n FROM found GROUP BY 1, 2")
def arm_routing(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).groupBy("arm", "category").agg(F.count("*").alias("n"))


_TEMPLATES = """WITH templates AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN ['FACADE_CONTRACTOR'] WHEN 1 THEN ['CONSTRUCTION_MATERIAL_STORE'] ELSE ['FACADE_CONTRACTOR', 'CONSTRUCTION_MATERIAL_STORE'] END AS lead_types,
CASE WHEN p_size < 15 THEN 'narrow' WHEN p_size < 35 THEN 'medium' ELSE 'broad' END AS precision FROM part) """


@query(_TEMPLATES + """SELECT lead_type, count(*) AS total, count(*) FILTER (precision = 'narrow') AS narrow, count(*) FILTER (precision = 'medium') AS medium, count(*) FILTER (precision = 'broad') AS broad
FROM (SELECT unnest(lead_types) AS lead_type, precision FROM templates) GROUP BY 1""")
def template_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Search templates by lead type and precision; a template of two types counts for both."""
    k, size = F.col("p_partkey"), F.col("p_size")
    both = F.array(F.lit("FACADE_CONTRACTOR"), F.lit("CONSTRUCTION_MATERIAL_STORE"))
    kinds = F.when(k % 3 == 0, F.slice(both, 1, 1)).when(k % 3 == 1, F.slice(both, 2, 1)).otherwise(both)
    rows = sources.table(spark, d, "part").select(F.explode(kinds).alias("lead_type"), F.when(size < 15, "narrow").when(size < 35, "medium").otherwise("broad").alias("precision"))
    return rows.groupBy("lead_type").agg(F.count("*").alias("total"), *[F.count_if(F.col("precision") == p).alias(p) for p in ("narrow", "medium", "broad")])


@query("""SELECT region_id, count(*) AS n, count(*) FILTER (n_sources > 1) AS shared, count(*) FILTER (n_sources = 1) AS single, regexp_replace(CAST(floor(count(*) FILTER (n_sources > 1) / count(*) * 1000 + 0.5) / 10 AS VARCHAR), '\\.0$', '') || '%' AS share
FROM (SELECT lead_id, count(DISTINCT source_id) AS n_sources FROM sightings GROUP BY 1) s JOIN active a ON a.id = s.lead_id JOIN places p ON p.municipality_id = a.municipality_id GROUP BY 1""")
def overlap_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Leads that one source, or several, have seen, by region."""
    seen = sources.sightings(spark, d).groupBy(F.col("lead_id").alias("id")).agg(F.count_distinct("source_id").alias("n_sources"))
    rows = sources.active(sources.leads(spark, d)).select("id", "municipality_id").join(seen, "id").join(sources.places(spark, d).select("municipality_id", "region_id"), "municipality_id")
    per = rows.groupBy("region_id").agg(F.count("*").alias("n"), F.count_if(F.col("n_sources") > 1).alias("shared"), F.count_if(F.col("n_sources") == 1).alias("single"))
    return per.withColumn("share", display.percent(F.col("shared"), F.col("n")))


@query(_RECORDS + "SELECT id, len(phones) * 3 + len(emails) * 2 + len(domains) * 2 + len(socials) + CASE WHEN city_id IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN coalesce(address, '') <> '' THEN 2 ELSE 0 END + CASE WHEN registration IS NOT NULL THEN 3 ELSE 0 END AS completeness FROM raw")
def record_completeness(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", completeness().cast("long").alias("completeness"))


def completeness() -> Column:
    """How much a comparison record holds; decides which of two equal records stays."""
    there = lambda c, w: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", w).otherwise(0)
    return F.size("phones") * 3 + F.size("emails") * 2 + F.size("domains") * 2 + F.size("socials") + there("city_id", 2) + there("address", 2) + there("registration", 3)


@query(_RECORDS + """SELECT id, gain, missing FROM (SELECT id, CASE WHEN len(phones) = 0 THEN 42 ELSE 0 END + CASE WHEN len(emails) = 0 THEN 6 ELSE 0 END + CASE WHEN len(domains) = 0 THEN 8 ELSE 0 END + CASE WHEN len(socials) = 0 THEN 4 ELSE 0 END
+ CASE WHEN coalesce(address, '') = '' THEN 2 ELSE 0 END + CASE WHEN city_id IS NULL THEN 10 ELSE 0 END AS gain, concat_ws(',', CASE WHEN len(phones) = 0 THEN 'phone' END, CASE WHEN len(emails) = 0 THEN 'email' END, CASE WHEN len(domains) = 0 THEN 'website' END,
CASE WHEN len(socials) = 0 THEN 'social' END, CASE WHEN coalesce(address, '') = '' THEN 'address' END, CASE WHEN city_id IS NULL THEN 'city' END) AS missing FROM raw) WHERE gain > 0 ORDER BY gain DESC, id LIMIT 100""")
def enrichment_targets(spark: SparkSession, d: str) -> DataFrame:
    """The hundred leads with most to gain, and what they lack."""
    empty = {"phone": F.size("phones") == 0, "email": F.size("emails") == 0, "website": F.size("domains") == 0, "social": F.size("socials") == 0, "address": F.coalesce("address", F.lit("")) == "", "city": F.col("city_id").isNull()}
    gain = sum((F.when(c, GAIN[f]).otherwise(0) for f, c in empty.items()), F.lit(0))
    rows = _records(spark, d).select("id", gain.alias("gain"), F.concat_ws(",", *[F.when(c, f) for f, c in empty.items()]).alias("missing"))
    return rows.where("gain > 0").orderBy(F.desc("gain"), "id").limit(100)


@query("SELECT status AS reason, source_id % 5 AS source_group, count(*) AS n FROM runs WHERE leads_created < 50 GROUP BY 1, 2")
def rejection_tally(spark: SparkSession, d: str) -> DataFrame:
    """What was turned away, by reason and group of sources."""
    return sources.runs(spark, d).where("leads_created < 50").groupBy(F.col("status").alias("reason"), (F.col("source_id") % 5).alias("source_group")).agg(F.count("*").alias("n"))


@query("SELECT place, row_number() OVER (ORDER BY tier, population DESC, municipality_id) AS position FROM places")
def crawl_order(spark: SparkSession, d: str) -> DataFrame:
    """Places in the order they are crawled. One window over the gazetteer, which a country bounds."""
    return sources.places(spark, d).select("place", F.row_number().over(Window.orderBy("tier", F.desc("population"), "municipality_id")).alias("position"))
