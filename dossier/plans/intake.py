"""Registries of sources merged, tables scaled up and cut down, hidden addresses, places in names, robots rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sources
from dossier.functions.scoring import name_key

from . import query


def merged_registry(files: Sequence[DataFrame]) -> DataFrame:
    """One row a source out of several registries (id, label, rank, enabled, delay): the best rank's label, flags joined by or, the longest delay, and in how many it is."""
    rows = files[0]
    for more in files[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("id").agg(F.min_by("label", F.struct("rank", "label")).alias("label"), F.min("rank").alias("rank"), F.bool_or("enabled").alias("enabled"), F.max("delay").alias("delay"), F.count("*").alias("n"))


def scaled(found: DataFrame, key: str, copies: int) -> DataFrame:
    """found and its copies, `copies` times as many rows in all, whose keys go on after the greatest one."""
    top = found.agg((F.max(key) + 1).alias("__span"))
    shifted = found.crossJoin(F.broadcast(top)).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))  # the other side is one row
    return shifted.withColumn(key, F.col(key) + F.col("__copy") * F.col("__span")).drop("__copy", "__span")


def decoded_address(c: Column) -> Column:
    """The text behind hexadecimal digits of which the first two are the key of all others; null if it isn't one."""
    byte = lambda at: F.conv(F.substr(c, at, F.lit(2)), 16, 10).cast("int")
    key = byte(F.lit(1))
    letters = F.transform(F.sequence(F.lit(3), F.length(c) - 1, F.lit(2)), lambda at: F.char(byte(at).bitwiseXOR(key)))
    return F.when(c.rlike(r"^(?:[0-9a-fA-F]{2}){2,}$"), F.array_join(letters, ""))


def decoded_entities(c: Column) -> Column:
    """c with decimal character references of up to four digits as their characters, hexadecimal ones as well."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(&#(?:[xX][0-9a-fA-F]{1,4}|[0-9]{1,4});|.)"), 1)
    code = lambda x: F.when(x.rlike("^&#[xX]"), F.conv(F.substr(x, F.lit(4), F.length(x) - 4), 16, 10)).otherwise(F.substr(x, F.lit(3), F.length(x) - 3)).cast("int")
    one = lambda x: F.when(x.rlike("^&#.+;$") & (code(x) > 0), F.decode(F.unhex(F.lpad(F.hex(code(x)), 4, "0")), "UTF-16BE")).otherwise(x)
    return F.array_join(F.transform(parts, one), "")


def places_in(found: DataFrame, key: str, words: Column, gazetteer: DataFrame) -> DataFrame:
    """key, place and rank of each gazetteer name (name, place) that a window of one to three words of `words` spells; rank 1 is the whole text.

    Windows join the names on equality; a place within a longer one found at the same words is dropped.
    """
    n = F.size("w")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), n - i + 1)), lambda k: F.struct(i.alias("start"), (i + k - 1).alias("end"), F.array_join(F.slice("w", i, k), " ").alias("name")))))
    rows = found.select(key, F.filter(words, lambda x: x != "").alias("w")).where(n > 0).select(key, n.alias("n"), F.explode(spans).alias("s")).select(key, "n", "s.*")
    hits = rows.join(gazetteer.select("name", "place"), "name")
    # an array has at most three times the text's windows that are names
    kept = hits.groupBy(key).agg(F.collect_set(F.struct("start", "end", "place", (F.when((F.col("start") == 1) & (F.col("end") == F.col("n")), 1).otherwise(2)).alias("rank"))).alias("h"))
    inside = lambda x, y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & ((y["end"] - y["start"]) > (x["end"] - x["start"]))
    best = F.filter("h", lambda x: ~F.exists("h", lambda y: inside(x, y)))
    return kept.select(key, F.explode(best).alias("b")).groupBy(key, "b.place").agg(F.min("b.rank").alias("rank"))


def robots_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url_id, host, path) with allowed: the longest rule (host, pattern, allow) that the path begins with decides, of equals the allowing one; none allows.

    A * in a pattern stands for anything, a $ at its end for the path's end.
    """
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"([\\.+?^${}()|\[\]])", r"\\$1"), r"\*", ".*")
    ready = rules.select("host", "allow", F.length("pattern").alias("n"), F.concat(F.lit("^"), F.regexp_replace(quoted, r"\\\$$", r"\$")).alias("rx"))
    fits = urls.join(ready, "host").where(F.rlike("path", F.col("rx")))
    best = fits.groupBy("url_id").agg(F.max(F.struct("n", "allow")).alias("r"))
    return urls.join(best, "url_id", "left").select("url_id", F.coalesce("r.allow", F.lit(True)).alias("allowed"))


@query("""SELECT id, arg_min(label, struct_pack(r := rank, l := label)) AS label, min(rank) AS rank, bool_or(enabled) AS enabled, max(delay) AS delay, count(*) AS n FROM (SELECT s_suppkey AS id, s_name AS label, s_suppkey * 7 % 11 AS rank, s_suppkey % 3 = 0 AS enabled, s_suppkey % 5 AS delay FROM supplier
UNION ALL SELECT c_custkey, c_name, c_custkey * 5 % 11, c_custkey % 4 = 0, c_custkey % 7 FROM customer) GROUP BY 1""")
def source_registry(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, k, n, a, b, c: sources.table(spark, d, t).select(F.col(k).alias("id"), F.col(n).alias("label"), (F.col(k) * a % 11).alias("rank"), (F.col(k) % b == 0).alias("enabled"), (F.col(k) % c).alias("delay"))
    return merged_registry([one("supplier", "s_suppkey", "s_name", 7, 3, 5), one("customer", "c_custkey", "c_name", 5, 4, 7)])


@query("SELECT s_suppkey + i * (SELECT max(s_suppkey) + 1 FROM supplier) AS s_suppkey, s_name FROM supplier, (SELECT unnest([0, 1, 2]) AS i)")
def scaled_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return scaled(sources.table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 3)


@query("SELECT id, name FROM leads WHERE id IN (SELECT lead_id FROM phones WHERE valid AND e164 = 7 UNION SELECT lead_id FROM sightings WHERE source_id = '1-URGENT' AND url_id % 10 = 0 UNION SELECT id FROM leads WHERE merged_into_id IS NOT NULL UNION SELECT merged_into_id FROM leads)")
def shaped_subset(spark: SparkSession, d: str) -> DataFrame:
    """The leads that any of the keep-sets names: shared numbers, urgent sightings, merged ones and what they are merged into."""
    leads = sources.leads(spark, d)
    keep = [sources.phones(spark, d).where("valid AND e164 = 7").select("lead_id"), sources.sightings(spark, d).where("source_id = '1-URGENT' AND url_id % 10 = 0").select("lead_id"), leads.where("merged_into_id IS NOT NULL").select("id"), leads.where("merged_into_id IS NOT NULL").select("merged_into_id")]
    ids = keep[0]
    for more in keep[1:]:
        ids = ids.union(more)
    return leads.join(ids.withColumnRenamed("lead_id", "id"), "id", "left_semi").select("id", "name")


_ADDRESS = "WITH a AS (SELECT c_custkey AS id, 'm' || c_custkey || '@' || lower(c_mktsegment) || '.rs' AS address, c_custkey % 200 + 1 AS key FROM customer) "


@query(_ADDRESS + "SELECT id, address, address AS decoded FROM a")
def hidden_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses hidden by a key, and read back."""
    k = F.col("c_custkey")
    rows = sources.table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("m"), k.cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".rs")).alias("address"), (k % 200 + 1).cast("int").alias("key"))
    two = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    bytes_ = F.transform(F.sequence(F.lit(1), F.length("address")), lambda i: two(F.ascii(F.substr("address", i, F.lit(1))).bitwiseXOR(F.col("key"))))
    hidden = rows.select("id", "address", F.concat(two(F.col("key")), F.array_join(bytes_, "")).alias("hidden"))
    return hidden.select("id", "address", decoded_address(F.col("hidden")).alias("decoded"))


_WORDS = r"""WITH t AS (SELECT p_partkey AS id, string_split(lower(p_name) || CASE p_partkey % 3 WHEN 0 THEN ' ' || lower(replace(n_name, '_', ' ')) ELSE '' END, ' ') AS w FROM part JOIN nation ON n_nationkey = p_partkey % 25),
g AS (SELECT lower(replace(n_name, '_', ' ')) AS name, n_name AS place FROM nation UNION ALL SELECT 'widget', 'WIDGET TOWN' UNION ALL SELECT 'widget nation', 'WIDGET NATION'), """


@query(_WORDS + """s AS (SELECT id, i, i + k - 1 AS j, len(w) AS n, array_to_string(w[i:i + k - 1], ' ') AS name FROM t, range(1, 9) r(i), range(1, 4) q(k) WHERE i + k - 1 <= len(w)), h AS (SELECT s.*, place FROM s JOIN g USING (name))
SELECT id, place, min(CASE WHEN i = 1 AND j = n THEN 1 ELSE 2 END) AS rank FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.id = x.id AND y.i <= x.i AND y.j >= x.j AND y.j - y.i > x.j - x.i) GROUP BY 1, 2""")
def places_in_names(spark: SparkSession, d: str) -> DataFrame:
    nation = sources.table(spark, d, "nation").select((F.col("n_nationkey")).alias("k"), F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("name"), F.col("n_name").alias("place"))
    more = spark.createDataFrame([("widget", "WIDGET TOWN"), ("widget nation", "WIDGET NATION")], "name string, place string")
    rows = sources.table(spark, d, "part").withColumn("k", F.col("p_partkey") % 25).join(nation, "k").select(F.col("p_partkey").alias("id"), F.concat(F.lower("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "name")).otherwise("")).alias("t"))
    return places_in(rows, "id", F.split(name_key(F.col("t")), " "), nation.select("name", "place").unionByName(more))


@query("""WITH u AS (SELECT page_id AS url_id, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) AS path FROM pages) SELECT url_id, CASE WHEN regexp_matches(path, '^/es/.*\\?utm') THEN false WHEN regexp_matches(path, '^/es/') THEN true WHEN regexp_matches(path, '^/en/.*8$') THEN false ELSE true END AS allowed FROM u""")
def robots_checked(spark: SparkSession, d: str) -> DataFrame:
    urls = sources.table(spark, d, "pages").select(F.col("page_id").alias("url_id"), F.lit("h").alias("host"), F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1).alias("path"))
    rules = spark.createDataFrame([("h", "/es/", True), ("h", "/es/*?utm", False), ("h", "/en/*8$", False), ("h", "/es/", False), ("other", "/", False)], "host string, pattern string, allow boolean")
    return robots_verdicts(urls, rules)
