"""Dashboard, yield, coverage, growth and sampling reports; each child table is aggregated once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier import sources
from dossier.functions.scoring import half_up

from . import query


def _per_lead(spark: SparkSession, d: str) -> DataFrame:
    return sources.phones(spark, d).groupBy(F.col("lead_id").alias("id")).agg(F.bool_or("valid").alias("has_phone"))


def _leads_with_phone(spark: SparkSession, d: str) -> DataFrame:
    return sources.active(sources.leads(spark, d)).join(_per_lead(spark, d), "id", "left").withColumn("has_phone", F.coalesce("has_phone", F.lit(False)))


_WITH_PHONE = ", w AS (SELECT a.*, EXISTS (SELECT 1 FROM phones p WHERE p.lead_id = a.id AND p.valid) AS has_phone FROM active a) "


@query(_WITH_PHONE + "SELECT (SELECT count(*) FROM leads) AS n_all, count(*) AS n_active, count(*) FILTER (has_phone) AS n_with_phone, count(DISTINCT municipality_id) AS n_places, floor(avg(score) * 10 + 0.5) / 10 AS mean_score FROM w")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    alive = F.col("merged_into_id").isNull()
    found = sources.leads(spark, d).join(_per_lead(spark, d), "id", "left")
    return found.agg(
        F.count("*").alias("n_all"), F.count_if(alive).alias("n_active"), F.count_if(alive & F.col("has_phone")).alias("n_with_phone"),
        F.count_distinct(F.when(alive, F.col("municipality_id"))).alias("n_places"), half_up(F.avg(F.when(alive, F.col("score"))), 1).alias("mean_score"),
    )


@query(_WITH_PHONE + """, s AS (SELECT DISTINCT lead_id, source_id, has_phone, count(*) OVER (PARTITION BY lead_id, source_id) AS urls FROM sightings JOIN w ON w.id = lead_id)
SELECT source_id, count(*) AS n_leads, count(*) FILTER (has_phone) AS n_with_phone, count(*) FILTER (k = 1) AS n_exclusive, CAST(sum(urls) AS BIGINT) AS n_urls
FROM (SELECT *, count(*) OVER (PARTITION BY lead_id) AS k FROM s) GROUP BY source_id""")
def source_yield(spark: SparkSession, d: str) -> DataFrame:
    pairs = sources.sightings(spark, d).groupBy(F.col("lead_id").alias("id"), "source_id").agg(F.count("*").alias("urls"))
    pairs = pairs.withColumn("k", F.count("*").over(Window.partitionBy("id"))).join(_leads_with_phone(spark, d).select("id", "has_phone"), "id")
    return pairs.groupBy("source_id").agg(
        F.count("*").alias("n_leads"), F.count_if("has_phone").alias("n_with_phone"), F.count_if(F.col("k") == 1).alias("n_exclusive"), F.sum("urls").alias("n_urls")
    )


_COVERAGE = _WITH_PHONE + """, c AS (SELECT g.*, coalesce(n, 0) AS n_leads, coalesce(p, 0) AS n_with_phone, coalesce(b, 0) AS n_building FROM places g LEFT JOIN
(SELECT municipality_id, count(*) AS n, count(*) FILTER (has_phone) AS p, count(*) FILTER (classification = 'BUILDING') AS b FROM w GROUP BY municipality_id) x USING (municipality_id)) """


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    per = _leads_with_phone(spark, d).groupBy("municipality_id").agg(
        F.count("*").alias("n_leads"), F.count_if("has_phone").alias("n_with_phone"), F.count_if(F.col("classification") == "BUILDING").alias("n_building")
    )
    return sources.places(spark, d).join(per, "municipality_id", "left").na.fill(0, ["n_leads", "n_with_phone", "n_building"])


@query(_COVERAGE + "SELECT * FROM c")
def coverage_by_geo(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)


@query(_COVERAGE + "SELECT municipality_id, place, population, n_leads FROM c WHERE n_leads < 60 ORDER BY population DESC, municipality_id LIMIT 12")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).where("n_leads < 60").orderBy(F.desc("population"), "municipality_id").limit(12).select("municipality_id", "place", "population", "n_leads")


@query(_COVERAGE + """SELECT municipality_id, n_leads, floor(CAST(population AS DOUBLE) * tl / tp * 10 + 0.5) / 10 AS expected, floor((CAST(population AS DOUBLE) * tl / tp - n_leads) * 10 + 0.5) / 10 AS shortfall
FROM c, (SELECT CAST(sum(n_leads) AS DOUBLE) AS tl, CAST(sum(population) AS DOUBLE) AS tp FROM c)""")
def shortfall_vs_national_rate(spark: SparkSession, d: str) -> DataFrame:
    found = _coverage(spark, d)
    total = found.agg(F.sum("n_leads").cast("double").alias("tl"), F.sum("population").cast("double").alias("tp"))
    expected = F.col("population").cast("double") * F.col("tl") / F.col("tp")  # total is one row
    return found.join(F.broadcast(total)).select("municipality_id", "n_leads", half_up(expected, 1).alias("expected"), half_up(expected - F.col("n_leads"), 1).alias("shortfall"))


@query(", s AS (SELECT DISTINCT lead_id, source_id, tier FROM sightings JOIN active ON id = lead_id JOIN places USING (municipality_id)) SELECT source_id, count(*) FILTER (tier = 1) AS tier_1, count(*) FILTER (tier = 2) AS tier_2, count(*) FILTER (tier = 3) AS tier_3 FROM s GROUP BY source_id")
def source_tier_pivot(spark: SparkSession, d: str) -> DataFrame:
    tiers = sources.active(sources.leads(spark, d)).join(sources.places(spark, d), "municipality_id").select(F.col("id").alias("lead_id"), "tier")
    pairs = sources.sightings(spark, d).select("lead_id", "source_id").distinct().join(tiers, "lead_id")
    found = pairs.groupBy("source_id").pivot("tier", [1, 2, 3]).agg(F.count("lead_id")).na.fill(0)
    return found.select("source_id", *(F.col(str(t)).alias(f"tier_{t}") for t in (1, 2, 3)))


@query(", s AS (SELECT DISTINCT lead_id, source_id FROM sightings) SELECT a.source_id AS source_a, b.source_id AS source_b, count(*) AS n FROM s a JOIN s b ON a.lead_id = b.lead_id AND a.source_id < b.source_id GROUP BY 1, 2")
def source_pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    """A lead's sources are a set as small as the registry of sources, so its pairs come from one row's array."""
    per = sources.sightings(spark, d).groupBy("lead_id").agg(F.array_sort(F.collect_set("source_id")).alias("s"))
    pairs = per.select("s", F.explode("s").alias("source_a")).select("source_a", F.explode(F.filter("s", lambda x: x > F.col("source_a"))).alias("source_b"))
    return pairs.groupBy("source_a", "source_b").agg(F.count("*").alias("n"))


@query("SELECT n_sources, count(*) AS n_leads FROM (SELECT lead_id, count(DISTINCT source_id) AS n_sources FROM sightings GROUP BY lead_id) GROUP BY n_sources")
def sources_per_lead_histogram(spark: SparkSession, d: str) -> DataFrame:
    per = sources.sightings(spark, d).groupBy("lead_id").agg(F.count_distinct("source_id").alias("n_sources"))
    return per.groupBy("n_sources").agg(F.count("*").alias("n_leads"))


@query("SELECT source_id, run_id, CAST(sum(leads_created) OVER (PARTITION BY source_id ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM runs WHERE status = 'purchase'")
def growth_running_total(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    return sources.runs(spark, d).where(F.col("status") == "purchase").select("source_id", "run_id", F.sum("leads_created").over(w).alias("total"))


@query("SELECT municipality_id, id, score, k FROM (SELECT *, row_number() OVER (PARTITION BY municipality_id ORDER BY score DESC, id) AS k FROM active) WHERE k <= 5")
def top_per_partition(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("municipality_id").orderBy(F.desc("score"), "id")
    return sources.active(sources.leads(spark, d)).withColumn("k", F.row_number().over(w)).where("k <= 5").select("municipality_id", "id", "score", "k")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR || ':7'), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM documents)
WHERE k <= greatest(1, floor(n::DOUBLE / total * 100 + 0.5))""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """About 100 seeded documents over the sources by their sizes, one of each at least: a sampling operator."""
    docs = sources.table(spark, d, "documents").select("doc_id", "source")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    share = F.greatest(F.lit(1.0), half_up(F.col("n") / F.col("total") * 100))
    quota = sizes.join(F.broadcast(total)).select(F.col("source").alias("s"), share.alias("quota"))  # total is one row
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":7")), 256), "doc_id"))
    return docs.withColumn("k", k).join(quota, F.col("source").eqNullSafe(F.col("s"))).where("k <= quota").select("doc_id", "source")


@query("SELECT status, count(*) AS n, CAST(sum(leads_created) AS BIGINT) AS created, floor(avg(leads_created) * 10 + 0.5) / 10 AS mean_created FROM runs GROUP BY status")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return sources.runs(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("leads_created").alias("created"), half_up(F.avg("leads_created"), 1).alias("mean_created"))


@query("SELECT source_id, count(*) AS attempts, max(started_at) AS last_run, max(CASE WHEN status = 'purchase' THEN started_at END) AS completed_at, arg_max(status, struct_pack(a := started_at, b := run_id)) AS last_status FROM runs GROUP BY source_id")
def resume_state(spark: SparkSession, d: str) -> DataFrame:
    from dossier.streaming import scope_state

    return scope_state(sources.runs(spark, d))


@query(", m AS (SELECT max(started_at) AS now FROM runs) SELECT source_id FROM runs, m GROUP BY source_id, now HAVING max(started_at) < now - INTERVAL 1 HOUR")
def stale_scopes(spark: SparkSession, d: str) -> DataFrame:
    last = sources.runs(spark, d).groupBy("source_id").agg(F.max("started_at").alias("last"))
    return last.join(F.broadcast(last.agg(F.max("last").alias("now")))).where("last < now - INTERVAL 1 HOUR").select("source_id")  # now is one row


@query("WITH p AS (SELECT DISTINCT p_type AS term FROM part) SELECT term || ' ' || n_name AS query, r_regionkey AS region_id FROM p CROSS JOIN nation JOIN region ON n_regionkey = r_regionkey")
def query_plan_cross_product(spark: SparkSession, d: str) -> DataFrame:
    """The search plan is the product of terms and places: both are lists of the configuration, and the product is the result."""
    terms = sources.table(spark, d, "part").select(F.col("p_type").alias("term")).distinct()
    at = sources.places(spark, d).select("place", "region_id").join(sources.table(spark, d, "region").select(F.col("r_regionkey").alias("region_id")), "region_id")
    return at.join(terms).select(F.concat_ws(" ", "term", "place").alias("query"), F.col("region_id"))
