"""Claims: collapse, conflicts, survivorship, blanks, unpivot, archive, erasure and rejects, all derived from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sources

from . import query


@query("""SELECT lead_id, e164, coalesce(arg_min(type, struct_pack(a := seen_at, b := claim_id)) FILTER (type <> 'unknown'), 'unknown') AS type, bool_or(is_primary) AS is_primary, bool_or(valid) AS valid,
min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(DISTINCT source_id) AS n_sources FROM phones GROUP BY lead_id, e164""")
def distinct_identifier_collapse(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("seen_at", "claim_id")
    known = F.col("type") != "unknown"
    return sources.phones(spark, d).groupBy("lead_id", "e164").agg(
        F.coalesce(F.min_by(F.when(known, F.col("type")), F.when(known, at)), F.lit("unknown")).alias("type"), F.bool_or("is_primary").alias("is_primary"), F.bool_or("valid").alias("valid"),
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count_distinct("source_id").alias("n_sources"),
    )


@query("SELECT lead_id, arg_min(e164, struct_pack(a := NOT is_primary, b := type <> 'mobile', c := seen_at, d := claim_id)) AS e164 FROM phones WHERE valid GROUP BY lead_id")
def primary_phone(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct(~F.col("is_primary"), F.col("type") != "mobile", F.col("seen_at"), F.col("claim_id"))
    return sources.phones(spark, d).where("valid").groupBy("lead_id").agg(F.min_by("e164", order).alias("e164"))


@query("SELECT lead_id, field, count(DISTINCT value) AS n_values FROM claims GROUP BY lead_id, field HAVING count(DISTINCT value) >= 2")
def field_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return sources.claims(spark, d).groupBy("lead_id", "field").agg(F.count_distinct("value").alias("n_values")).where("n_values >= 2")


@query("SELECT lead_id, field, arg_max(value, struct_pack(a := CASE WHEN source_id <= 2 THEN 3 WHEN source_id <= 4 THEN 2 ELSE 1 END, b := seen_at, c := order_id, d := source_id, e := part_id, f := value)) AS value, count(*) AS n_claims FROM claims GROUP BY lead_id, field")
def survivorship_trust_recency(spark: SparkSession, d: str) -> DataFrame:
    """The most trusted source's latest value stays; ties go by ids."""
    trust = F.when(F.col("source_id") <= 2, 3).when(F.col("source_id") <= 4, 2).otherwise(1)
    best = F.max_by("value", F.struct(trust, "seen_at", "order_id", "source_id", "part_id", "value"))
    return sources.claims(spark, d).groupBy("lead_id", "field").agg(best.alias("value"), F.count("*").alias("n_claims"))


@query("SELECT lead_id, arg_min(NULLIF(source_id, '4-NOT SPECIFIED'), struct_pack(a := seen_at, b := url_id)) FILTER (source_id <> '4-NOT SPECIFIED') AS source_id, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS times_seen FROM sightings GROUP BY lead_id")
def fill_blanks_golden(spark: SparkSession, d: str) -> DataFrame:
    """The first value that is not blank fills a field and is never overwritten."""
    named = F.col("source_id") != "4-NOT SPECIFIED"
    first = F.min_by(F.when(named, F.col("source_id")), F.when(named, F.struct("seen_at", "url_id")))
    return sources.sightings(spark, d).groupBy("lead_id").agg(first.alias("source_id"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("times_seen"))


@query("SELECT s_suppkey AS lead_id, 'name' AS field, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'municipality', s_nationkey::VARCHAR FROM supplier")
def unpivot_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = F.array(F.struct(F.lit("name").alias("field"), F.col("s_name").alias("value")), F.struct(F.lit("municipality").alias("field"), F.col("s_nationkey").cast("string").alias("value")))
    return sources.table(spark, d, "supplier").select(F.col("s_suppkey").alias("lead_id"), F.inline(claims))


@query("SELECT source, sha256(text) AS content_hash, count(*) AS seen_count, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def raw_archive_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = sources.table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy("source", F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("seen_count"), F.min("doc_id").alias("first_id"))


@query("SELECT lead_id, count(*) AS n_phones FROM phones WHERE sha256(e164::VARCHAR) NOT IN (SELECT sha256(e164::VARCHAR) FROM phones p JOIN leads l ON l.id = p.lead_id WHERE l.score < -900) GROUP BY lead_id")
def erasure_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of erased leads stay away from every lead, by their hashes alone."""
    hashed = sources.phones(spark, d).withColumn("h", F.sha2(F.col("e164").cast("string"), 256))
    erased = sources.leads(spark, d).where("score < -900").select(F.col("id").alias("lead_id"))
    blocked = hashed.join(erased, "lead_id", "left_semi").select("h").distinct()
    return hashed.join(blocked, "h", "left_anti").groupBy("lead_id").agg(F.count("*").alias("n_phones"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'text: empty' END, CASE WHEN lang IS NULL THEN 'lang: missing' END, CASE WHEN n_chars < 100 THEN 'n_chars: under 100' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM documents WHERE coalesce(trim(text) = '', true) OR lang IS NULL OR n_chars < 100""")
def rejects_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fail a rule, with every rule that they fail."""
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("text") == "", F.lit(True)), "text: empty"), F.when(F.col("lang").isNull(), "lang: missing"), F.when(F.col("n_chars") < 100, "n_chars: under 100")
    ))
    return sources.table(spark, d, "documents").select("doc_id", errors.alias("e")).where(F.size("e") > 0).select("doc_id", F.array_join("e", "; ").alias("errors"))
