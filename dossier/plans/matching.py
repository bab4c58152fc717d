"""Entity resolution: quarantine of shared identifiers, blocking, pair scores, decisions, merge forests, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sources
from dossier.functions import scoring
from dossier.operators.components import components, resolve_roots

from . import query

#: More businesses than this on one identifier make it no identity.
SHARED = 4
#: A block of more rows is skipped whole and reported by oversized_blocks: a rule of the matching method itself.
BLOCK_ROWS = 2000


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of a brand: copies of a name are one business."""
    return sources.table(spark, d, "part").groupBy(F.col("p_brand").alias("block"), F.lower("p_name").alias("key")).agg(F.min("p_partkey").alias("id"))


_NAMES = ", n AS (SELECT p_brand AS block, lower(p_name) AS key, min(p_partkey) AS id FROM part GROUP BY 1, 2), size AS (SELECT block FROM n GROUP BY block HAVING count(*) <= 2000) "
_PAIRS = _NAMES + """, pairs AS (SELECT a.id AS a, b.id AS b, 1 - levenshtein(a.key, b.key)::DOUBLE / greatest(length(a.key), length(b.key)) AS s, split_part(a.key, ' ', 1) = split_part(b.key, ' ', 1) AS w
FROM n a JOIN n b ON a.block = b.block AND a.id < b.id JOIN size ON size.block = a.block) """


def candidate_pairs(names: DataFrame) -> DataFrame:
    """Pairs a < b of a block; equal keys were collapsed before, and blocks over BLOCK_ROWS are left out."""
    small = names.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") <= BLOCK_ROWS).select("block")
    kept = names.join(small, "block", "left_semi")
    left, right = kept.select("block", F.col("id").alias("a"), F.col("key").alias("ka")), kept.select("block", F.col("id").alias("b"), F.col("key").alias("kb"))
    return left.join(right, "block").where("a < b")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    same = F.split_part("ka", F.lit(" "), F.lit(1)) == F.split_part("kb", F.lit(" "), F.lit(1))
    s = scoring.char_similarity(F.col("ka"), F.col("kb"))
    return candidate_pairs(_names(spark, d)).select("a", "b", s.alias("s"), same.alias("w"))


@query(_NAMES + "SELECT block, count(*) AS n FROM n GROUP BY block HAVING count(*) > 2000")
def oversized_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)


@query(_PAIRS + "SELECT a, b, floor(s * 1000 + 0.5) / 1000 AS similarity FROM pairs WHERE s >= 0.6")
def name_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("s >= 0.6").select("a", "b", scoring.half_up(F.col("s"), 3).alias("similarity"))


_SCORE = _PAIRS + """, scored AS (SELECT a, b, s, w, floor((1 - (1 - CASE WHEN s >= 0.65 THEN 0.35 ELSE 0 END::DOUBLE) * (1 - CASE WHEN w THEN 0.45 ELSE 0 END::DOUBLE)) * 100 + 0.5) / 100 AS score FROM pairs) """


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    weights = F.array(F.when(F.col("s") >= 0.65, 0.35).otherwise(0.0), F.when(F.col("w"), 0.45).otherwise(0.0))
    return _scored(spark, d).withColumn("score", scoring.half_up(scoring.noisy_or(weights), 2))


@query(_SCORE + "SELECT a, b, score FROM scored WHERE score > 0")
def pair_score_noisy_or(spark: SparkSession, d: str) -> DataFrame:
    return _noisy(spark, d).where("score > 0").select("a", "b", "score")


@query(_SCORE + "SELECT CASE WHEN s >= 0.82 AND w THEN 'merge' WHEN s >= 0.82 OR w THEN 'review' ELSE 'distinct' END AS decision, count(*) AS n FROM scored GROUP BY 1")
def pair_decision(spark: SparkSession, d: str) -> DataFrame:
    strong = F.col("s") >= 0.82
    decision = F.when(strong & F.col("w"), "merge").when(strong | F.col("w"), "review").otherwise("distinct")
    return _noisy(spark, d).groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query(f"SELECT p_name AS value, count(DISTINCT p_brand) AS n_businesses, CASE WHEN count(DISTINCT p_brand) > {SHARED} THEN 'shared_across_businesses' END AS reason FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) >= 2")
def identifier_quarantine(spark: SparkSession, d: str) -> DataFrame:
    per = sources.table(spark, d, "part").groupBy(F.col("p_name").alias("value")).agg(F.count_distinct("p_brand").alias("n_businesses"), F.count_distinct("p_partkey").alias("k")).where("k >= 2")
    return per.select("value", "n_businesses", F.when(F.col("n_businesses") > SHARED, "shared_across_businesses").alias("reason"))


@query("WITH RECURSIVE up AS (SELECT c_custkey AS id, c_custkey AS root, c_acctbal < 0 AND c_custkey > 0 AS more FROM customer UNION ALL SELECT u.id, c.c_custkey, c.c_acctbal < 0 AND c.c_custkey > 0 FROM up u JOIN customer c ON u.more AND c.c_custkey = u.root - 1) SELECT id, root FROM up WHERE NOT more")
def resolve_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Every lead and the lead that it was merged into at last."""
    return resolve_roots(sources.leads(spark, d).select("id", F.when(F.col("merged_into_id") >= 0, F.col("merged_into_id")).alias("parent")))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS root FROM documents WHERE text IS NOT NULL")
def resolve_roots_of_copies(spark: SparkSession, d: str) -> DataFrame:
    """Components of the links between each document and the first of its text."""
    docs = sources.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    links = docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("first")), "h").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    return components(links).select(F.col("id").alias("doc_id"), "root")


@query("SELECT sha256(text) AS value, min(doc_id) AS survivor, count(*) - 1 AS n_merged, CAST(sum(doc_id) - min(doc_id) AS BIGINT) AS merged_id_sum FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1 HAVING count(*) > 1")
def merge_log_and_revert(spark: SparkSession, d: str) -> DataFrame:
    """The merges that stay when rows whose merge a label of no quality reverts are taken out of the log."""
    reverted = sources.table(spark, d, "labels").where("quality = 0").select("doc_id")
    docs = sources.table(spark, d, "documents").where("text IS NOT NULL").join(reverted, "doc_id", "left_anti")
    log = docs.groupBy(F.sha2("text", 256).alias("value")).agg(F.min("doc_id").alias("survivor"), (F.count("*") - 1).alias("n_merged"), (F.sum("doc_id") - F.min("doc_id")).alias("merged_id_sum"))
    return log.where("n_merged > 0")


_GRADE = """, g AS (SELECT a.id, count(DISTINCT CASE WHEN valid THEN e164 END) AS p, count(*) FILTER (type = 'mobile') AS m, count(DISTINCT source_id) AS s, date_diff('day', max(seen_at)::DATE, DATE '2001-01-01')::DOUBLE AS days, a.score AS r
FROM active a LEFT JOIN phones ON lead_id = a.id GROUP BY a.id, a.score),
c AS (SELECT id, r, p, CASE WHEN p > 0 THEN 44.0::DOUBLE ELSE 0 END + 7.0 * least(greatest(p - 1, 0), 2) + CASE WHEN m > 0 THEN 5.0 ELSE 0 END + 7.0 * greatest(0.0, least(1.0, (s - 1) / 2.0)) + 4.0 * greatest(0.0, least(1.0, (365.0 - coalesce(days, 9999)) / 335.0)) AS t FROM g),
k AS (SELECT id, CAST(floor(greatest(0.0, least(1.0, r / 10000.0)) * 100 + 0.5) AS INT) AS relevance, CAST(floor(least(t, CASE WHEN p > 0 THEN 100 ELSE 29 END) + 0.5) AS INT) AS contactability FROM c) """


@query(_GRADE + "SELECT id, relevance, contactability, CAST(floor(relevance * contactability / 100.0 + 0.5) AS INT) AS lead_score FROM k")
def lead_scores(spark: SparkSession, d: str) -> DataFrame:
    """Contactability of claims, relevance, and the lead's score: their product over 100."""
    per = sources.phones(spark, d).groupBy(F.col("lead_id").alias("id")).agg(
        F.count_distinct(F.when(F.col("valid"), F.col("e164"))).alias("p"), F.count_if(F.col("type") == "mobile").alias("m"), F.count_distinct("source_id").alias("s"),
        F.datediff(F.lit("2001-01-01").cast("date"), F.max("seen_at")).cast("double").alias("days"),
    )
    found = sources.active(sources.leads(spark, d)).join(per, "id", "left").na.fill(0, ["p", "m", "s"]).na.fill(9999.0, ["days"])
    relevance = scoring.half_up(scoring.clamp(F.col("score") / 10000.0) * 100).cast("int")
    graded = found.select("id", relevance.alias("relevance"), scoring.contactability(F.col("p"), F.col("m"), F.col("s"), F.col("days")).alias("contactability"))
    return graded.withColumn("lead_score", scoring.half_up(F.col("relevance") * F.col("contactability") / 100.0).cast("int"))


_SIGNALS = {"the": 0.5, "and": 0.3, "der": -0.4}


@query(f"""WITH c AS (SELECT doc_id, {" + ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z]){w}([^a-z]|$)') THEN {v}::DOUBLE ELSE 0 END" for w, v in _SIGNALS.items())} AS net FROM documents)
SELECT quality AS expected, CASE WHEN net >= 0.45 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM c JOIN labels USING (doc_id) GROUP BY 1, 2""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Weighted word signals decide a label; the matrix compares it with the labels."""
    net = sum((F.when(F.lower("text").rlike(f"(^|[^a-z]){w}([^a-z]|$)"), F.lit(v)).otherwise(0.0) for w, v in _SIGNALS.items()), F.lit(0.0))
    graded = sources.table(spark, d, "documents").select("doc_id", (F.when(net >= 0.45, 1).otherwise(0)).alias("predicted"))
    return sources.table(spark, d, "labels").join(graded, "doc_id").groupBy(F.col("quality").alias("expected"), "predicted").agg(F.count("*").alias("n"))
