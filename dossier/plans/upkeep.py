"""Upkeep of the records: matching a batch, survivors, the review queue, decisions replayed over derived values.

State is never changed in place: each operator derives the next table from the one before and a batch or a log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sources
from dossier.functions import text
from dossier.operators.components import components

from . import query
from .resolution import _RECORDS, _SIGNALS, _backed, _profiles, _records, _scored, comparable, merge_links, quarantined
from .yields import completeness

_COMPLETE = "len(phones) * 3 + len(emails) * 2 + len(domains) * 2 + len(socials) + CASE WHEN city_id IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN coalesce(address, '') <> '' THEN 2 ELSE 0 END + CASE WHEN registration IS NOT NULL THEN 3 ELSE 0 END"


def survivors(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """groups (id, root) with survivor: the group's most complete record, of equals the one seen first, then the smallest id.

    facts: id, completeness, first_seen; a null first_seen counts as last. Only the best of each group is kept while it is aggregated.
    """
    rank = F.struct(-F.col("completeness"), F.col("first_seen").isNull(), "first_seen", "id")
    best = groups.join(facts, "id").groupBy("root").agg(F.min_by("id", rank).alias("survivor"))
    return groups.join(best, "root").select("id", "root", "survivor")


def match_ladder(batch: DataFrame, known: DataFrame) -> DataFrame:
    """id, lead_id and signal of the batch's records that a known record matches: by phone, domain, e-mail, or name and city, the first that does.

    Both are comparable records, so quarantined identifiers match nothing. Of several known records of a key the smallest id
    counts; it is found before the join, so a common key doesn't multiply rows.
    """
    def keys(records: DataFrame) -> DataFrame:
        each = lambda rung, c: F.transform(c, lambda v: F.struct(F.lit(rung).alias("rung"), v.alias("value")))
        named = F.when(F.col("city_id").isNotNull() & (F.col("name") != ""), F.array(F.concat_ws("|", "name", F.col("city_id").cast("string")))).otherwise(F.array().cast("array<string>"))
        return records.select("id", F.explode(F.concat(each(1, F.col("phones")), each(2, F.col("domains")), each(3, F.col("emails")), each(4, named))).alias("k")).select("id", "k.rung", "k.value")

    owners = keys(known).groupBy("rung", "value").agg(F.min("id").alias("lead_id"))
    best = keys(batch).join(owners, ["rung", "value"]).groupBy("id").agg(F.min(F.struct("rung", "lead_id")).alias("m"))
    signals = F.array(*map(F.lit, ("phone", "website_domain", "email", "name_city")))
    return best.select("id", "m.lead_id", F.element_at(signals, F.col("m.rung")).alias("signal"))


def queue_upsert(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The review queue after a run. Pairs are known by both ids in either order; a pending pair takes the new score, a decided one keeps its own.

    queue: a, b, status, score, first_seen, last_seen; found: a, b, score, seen_at. Of repeated pairs in found the latest counts,
    of equally late ones the highest score; pairs of a record with itself are left out.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    new = found.where("a <> b").select(low.alias("a"), high.alias("b"), "score", "seen_at").groupBy("a", "b").agg(F.max(F.struct("seen_at", "score")).alias("new"), F.min("seen_at").alias("new_first"))
    both = queue.join(new, ["a", "b"], "full_outer")
    pending = F.coalesce(F.col("status"), F.lit("pending")) == "pending"
    return both.select(
        "a", "b", F.coalesce("status", F.lit("pending")).alias("status"), F.when(pending & F.col("new").isNotNull(), F.col("new.score")).otherwise(F.col("score")).alias("score"),
        F.coalesce("first_seen", "new_first").alias("first_seen"), F.greatest("last_seen", "new.seen_at").alias("last_seen"),
    )


def replayed(values: DataFrame, decisions: DataFrame) -> DataFrame:
    """values (lead_id, field, value) after the people's decisions (lead_id, field, value, undone, at, id): the last one not undone overrides, or adds.

    An overridden value is kept as `derived`, so that undoing is deriving anew.
    """
    last = decisions.where(~F.col("undone")).groupBy("lead_id", "field").agg(F.max_by("value", F.struct("at", "id")).alias("decided"))
    return values.join(last, ["lead_id", "field"], "full_outer").select("lead_id", "field", F.coalesce("decided", "value").alias("value"), F.col("value").alias("derived"), F.col("decided").isNotNull().alias("by_hand"))


def categories(payloads: DataFrame) -> DataFrame:
    """lead_id and its distinct categories in the order of first sight, out of JSON payloads whose name is the lead's.

    payloads: lead_id, name, position, payload. Payloads that don't parse, and blank categories, are passed over. Each category is
    reduced to its first place before they are gathered, so a list has no more entries than there are categories.
    """
    read = payloads.select("lead_id", "name", "position", F.from_json("payload", "name string, categories array<string>").alias("j"))
    same = F.lower(F.trim("j.name")) == F.lower(F.trim("name"))
    each = read.where(same).select("lead_id", "position", F.posexplode("j.categories").alias("i", "category")).where(F.trim("category") != "")
    first = each.groupBy("lead_id", "category").agg(F.min(F.struct("position", "i")).alias("at"))
    return first.groupBy("lead_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))), lambda x: x["category"]).alias("categories"))


@query(_SIGNALS.replace("WITH raw", "WITH RECURSIVE raw", 1) + f""", e AS MATERIALIZED (SELECT a, b FROM scored WHERE decision = 'merge' UNION SELECT b, a FROM scored WHERE decision = 'merge'),
walk AS (SELECT a AS id, a AS r FROM e UNION SELECT e.b, w.r FROM walk w JOIN e ON e.a = w.id AND w.r < e.b), g AS (SELECT id, min(r) AS root FROM walk GROUP BY id),
f AS (SELECT raw.id, {_COMPLETE} AS c, first_seen FROM raw LEFT JOIN (SELECT o_custkey AS id, min(o_orderdate) AS first_seen FROM orders GROUP BY 1) s ON s.id = raw.id)
SELECT id, root, first_value(id) OVER (PARTITION BY root ORDER BY c DESC, first_seen NULLS LAST, id) AS survivor FROM g JOIN f USING (id)""")
def merge_survivors(spark: SparkSession, d: str) -> DataFrame:
    groups = components(merge_links(_profiles(spark, d))).select("id", "root")
    seen = sources.sightings(spark, d).groupBy(F.col("lead_id").alias("id")).agg(F.min("seen_at").alias("first_seen"))
    return survivors(groups, _records(spark, d).select("id", completeness().alias("completeness")).join(seen, "id", "left"))


@query(_RECORDS + """, keys AS (SELECT id, 1 AS rung, unnest(phones) AS value FROM rec UNION ALL SELECT id, 2, unnest(domains) FROM rec UNION ALL SELECT id, 3, unnest(emails) FROM rec UNION ALL SELECT id, 4, name || '|' || city_id FROM rec WHERE city_id IS NOT NULL AND name <> ''),
m AS (SELECT i.id, k.rung, min(k.id) AS lead_id FROM keys i JOIN keys k ON k.rung = i.rung AND k.value = i.value AND i.id % 10 = 0 AND k.id % 10 <> 0 GROUP BY 1, 2)
SELECT id, arg_min(lead_id, rung) AS lead_id, ['phone', 'website_domain', 'email', 'name_city'][min(rung)] AS signal FROM m GROUP BY 1""")
def ladder_matches(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the records as a new batch against the others."""
    records = comparable(_records(spark, d))
    return match_ladder(records.where("id % 10 = 0"), records.where("id % 10 <> 0"))


_QUEUE = """WITH queue AS (SELECT o_orderkey AS a, o_orderkey + o_custkey AS b, CASE o_orderkey % 4 WHEN 0 THEN 'merged' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, o_custkey % 50 / 100::DOUBLE AS score, o_orderdate AS first_seen, o_orderdate AS last_seen FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey > 0),
found AS (SELECT o_orderkey + o_custkey AS a, o_orderkey AS b, o_custkey % 40 / 50::DOUBLE AS score, o_orderdate + INTERVAL 1 DAY AS seen_at FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey > 0) """


@query(_QUEUE + """SELECT coalesce(q.a, f.b) AS a, coalesce(q.b, f.a) AS b, coalesce(status, 'pending') AS status, CASE WHEN coalesce(status, 'pending') = 'pending' AND f.a IS NOT NULL THEN f.score ELSE q.score END AS score,
CAST(coalesce(first_seen, seen_at) AS DATE) AS first_seen, CAST(greatest(last_seen, seen_at) AS DATE) AS last_seen FROM queue q FULL JOIN found f ON q.a = f.b AND q.b = f.a""")
def review_queue_upsert(spark: SparkSession, d: str) -> DataFrame:
    orders = sources.table(spark, d, "orders").where("o_custkey > 0")
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    status = F.when(k % 4 == 0, "merged").when(k % 4 == 1, "rejected").otherwise("pending")
    queue = orders.where(k % 3 == 0).select(k.alias("a"), (k + c).alias("b"), status.alias("status"), (c % 50 / 100).alias("score"), day.alias("first_seen"), day.alias("last_seen"))
    return queue_upsert(queue, orders.where(k % 2 == 0).select((k + c).alias("a"), k.alias("b"), (c % 40 / 50).alias("score"), F.date_add(day, 1).alias("seen_at")))


@query(_RECORDS + ", merges AS (SELECT id, kind, value, id % 3 = 0 AS reverted FROM ident WHERE id % 2 = 0) SELECT DISTINCT id, kind, value FROM merges m WHERE NOT reverted AND EXISTS (SELECT 1 FROM quarantine q WHERE q.kind = m.kind AND q.value = m.value)")
def suspect_merges(spark: SparkSession, d: str) -> DataFrame:
    """Merges that rest on an identifier which has been quarantined since, but for those taken back."""
    records = _records(spark, d)
    parts = [records.select("id", F.lit(kind).alias("kind"), F.explode(c).alias("value")) for kind, c in (("phone", "phones"), ("website_domain", "domains"), ("email", "emails"))]
    merges = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("id % 2 = 0 AND id % 3 <> 0")
    return merges.join(quarantined(records).select("kind", "value"), ["kind", "value"], "left_semi").select("id", "kind", "value").distinct()


@query(_SIGNALS + "SELECT a AS id, arg_max(b, struct_pack(s := score, b := -b)) AS candidate, max(score) AS score FROM scored WHERE decision <> 'distinct' GROUP BY 1")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each record's best partner among later ones, the smallest id of equals."""
    pairs = _scored(spark, d, _backed()).where("decision <> 'distinct'")
    least = pairs.groupBy(F.col("a").alias("id"), "score").agg(F.min("b").alias("candidate"))  # of plain columns, so pairs are not sorted to be gathered
    return least.groupBy("id").agg(F.max_by("candidate", "score").alias("candidate"), F.max("score").alias("score"))


_DECISIONS = """, values_ AS (SELECT s_suppkey AS lead_id, 'name' AS field, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'status', 'new' FROM supplier), decisions AS (SELECT user_id AS lead_id, CASE WHEN event_type IN ('click', 'view') THEN 'status' ELSE 'name' END AS field,
event_type || ' ' || event_id AS value, event_id % 5 = 0 AS undone, ts AS happened, event_id AS id FROM events WHERE user_id IS NOT NULL), last AS (SELECT lead_id, field, arg_max(value, struct_pack(a := happened, i := id)) AS decided FROM decisions WHERE NOT undone GROUP BY 1, 2) """


@query(_DECISIONS + "SELECT lead_id, field, coalesce(decided, value) AS value, value AS derived, decided IS NOT NULL AS by_hand FROM values_ FULL JOIN last USING (lead_id, field)")
def decisions_replayed(spark: SparkSession, d: str) -> DataFrame:
    supplier = sources.table(spark, d, "supplier")
    fields = F.array(F.struct(F.lit("name").alias("field"), F.col("s_name").alias("value")), F.struct(F.lit("status").alias("field"), F.lit("new").alias("value")))
    values = supplier.select(F.col("s_suppkey").alias("lead_id"), F.inline(fields))
    field = F.when(F.col("event_type").isin("click", "view"), "status").otherwise("name")
    decisions = sources.table(spark, d, "events").where("user_id IS NOT NULL").select(
        F.col("user_id").alias("lead_id"), field.alias("field"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"), (F.col("event_id") % 5 == 0).alias("undone"), F.col("ts").alias("at"), F.col("event_id").alias("id")
    )
    return replayed(values, decisions)


_PAYLOADS = """, payloads AS (SELECT o_custkey AS lead_id, c_name AS name, o_orderkey AS position, CASE WHEN o_orderkey % 11 = 0 THEN '{"name": broken' ELSE '{"name": "' || CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE upper(c_name) END || ' ", "categories": ["' || o_orderpriority || '", " ", "c' || o_orderkey % 3 || '"]}' END AS payload
FROM orders JOIN customer ON c_custkey = o_custkey) """


@query(_PAYLOADS + """, j AS (SELECT lead_id, position, CAST(payload AS JSON) AS j FROM payloads WHERE json_valid(payload) AND lower(trim(payload ->> 'name')) = lower(trim(name))), c AS (SELECT lead_id, position, unnest([1, 2, 3]) AS i, j FROM j),
f AS (SELECT lead_id, j ->> ('$.categories[' || (i - 1) || ']') AS category, min(struct_pack(p := position, i := i)) AS place FROM c GROUP BY 1, 2) SELECT lead_id, string_agg(category, ',' ORDER BY place) AS categories FROM f WHERE trim(category) <> '' GROUP BY 1""")
def lead_categories(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 7 == 0, "other").otherwise(F.upper("c_name"))
    json = F.format_string('{"name": "%s ", "categories": ["%s", " ", "c%d"]}', name, F.col("o_orderpriority"), k % 3)
    named = sources.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = sources.table(spark, d, "orders").join(named, "o_custkey").select(F.col("o_custkey").alias("lead_id"), F.col("c_name").alias("name"), k.alias("position"), F.when(k % 11 == 0, '{"name": broken').otherwise(json).alias("payload"))
    return categories(rows).withColumn("categories", F.array_join("categories", ","))


@query(_RECORDS + """, manual AS (SELECT DISTINCT kind, value, id % 2 = 0 AS shared FROM ident WHERE id % 50 = 0), m AS (SELECT kind, value, bool_or(shared) AS shared FROM manual GROUP BY 1, 2)
SELECT kind, value, coalesce(m.shared, q.value IS NOT NULL) AS shared, m.shared IS NOT NULL AS by_hand, n_businesses FROM quarantine q FULL JOIN m USING (kind, value)""")
def shared_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that several businesses share, found or decided by hand; the hand's word counts."""
    records = _records(spark, d)
    parts = [records.select("id", F.lit(kind).alias("kind"), F.explode(c).alias("value")) for kind, c in (("phone", "phones"), ("website_domain", "domains"), ("email", "emails"))]
    manual = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("id % 50 = 0").groupBy("kind", "value").agg(F.bool_or(F.col("id") % 2 == 0).alias("hand"))
    both = quarantined(records).join(manual, ["kind", "value"], "full_outer")
    return both.select("kind", "value", F.coalesce("hand", F.col("n_businesses").isNotNull()).alias("shared"), F.col("hand").isNotNull().alias("by_hand"), "n_businesses")


@query("SELECT DISTINCT e164, lower(name) AS name, lead_id FROM phones p JOIN active a ON a.id = p.lead_id WHERE valid")
def identifier_occurrences(spark: SparkSession, d: str) -> DataFrame:
    named = sources.active(sources.leads(spark, d)).select(F.col("id").alias("lead_id"), F.lower(text.normalize_whitespace(F.col("name"))).alias("name"))
    return sources.phones(spark, d).where("valid").select("e164", "lead_id").distinct().join(named, "lead_id").select("e164", "name", "lead_id")


@query("SELECT id, name, CASE classification WHEN 'HOUSEHOLD' THEN 'UNCLASSIFIED' ELSE classification END AS classification, CASE WHEN classification = 'HOUSEHOLD' THEN 0 ELSE score END AS score FROM leads")
def relabelled_leads(spark: SparkSession, d: str) -> DataFrame:
    """A label that is given up becomes another, and its scores go, as a rewrite of the table."""
    old = F.col("classification") == "HOUSEHOLD"
    return sources.leads(spark, d).select("id", "name", F.when(old, "UNCLASSIFIED").otherwise(F.col("classification")).alias("classification"), F.when(old, 0.0).otherwise(F.col("score")).alias("score"))
