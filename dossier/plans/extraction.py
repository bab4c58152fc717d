"""Contacts, links and keys out of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sources
from dossier.functions import contacts, text
from dossier.functions.scoring import name_key

from . import query

_EMAILS = f", e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '({contacts.EMAIL})', 1)) AS email FROM documents) "


def _emails(spark: SparkSession, d: str) -> DataFrame:
    return sources.table(spark, d, "documents").select("doc_id", F.explode(contacts.emails(F.col("text"))).alias("email"))


@query(_EMAILS + "SELECT doc_id, email FROM e")
def extract_emails(spark: SparkSession, d: str) -> DataFrame:
    return _emails(spark, d)


@query(_EMAILS + f"SELECT email, split_part(email, '@', 1) IN {tuple(contacts.ROLES)} AS is_role, split_part(email, '@', 2) IN {tuple(contacts.FREE)} AS is_free, count(*) AS n_docs FROM e GROUP BY ALL")
def email_role_and_provider_flags(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("email")
    return _emails(spark, d).groupBy("email").agg(F.count("*").alias("n_docs")).select(e, contacts.email_is_role(e).alias("is_role"), contacts.email_is_free(e).alias("is_free"), "n_docs")


@query(_EMAILS + r"""SELECT doc_id, email, CASE WHEN regexp_matches(split_part(email, '@', 2), '\.(png|jpe?g|gif|svg|webp)$') THEN 'asset-name' WHEN regexp_matches(split_part(email, '@', 2), '^(example\.(com|org|net)|domain\.com)$') THEN 'placeholder'
WHEN length(email) > 254 THEN 'too-long' END AS reason FROM e""")
def email_rejections(spark: SparkSession, d: str) -> DataFrame:
    return _emails(spark, d).withColumn("reason", contacts.email_rejection(F.col("email")))


@query(f", p AS (SELECT DISTINCT doc_id, '+' || regexp_replace(unnest(regexp_extract_all(text, '({contacts.PHONE})', 1)), '[^0-9]', '', 'g') AS e164 FROM documents) SELECT * FROM p WHERE length(e164) BETWEEN 9 AND 16")
def extract_phones(spark: SparkSession, d: str) -> DataFrame:
    return sources.table(spark, d, "documents").select("doc_id", F.explode(contacts.phones(F.col("text"))).alias("e164"))


_HOST = r"regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.|\.$', '', 'g')"


# web addresses of pages, and of others made from their ids: ports, keys in capitals, repeated keys, advert media
_URLS = """, u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, 'HTTP://WWW.Shop' || page_id % 7 || ['.com.ba', '.org.uk', '.rs', '.co.rs'][page_id % 4 + 1] || [':8080', ':443', ''][page_id % 3 + 1]
|| '/a/b//?b=' || page_id || '&UTM_Source=x&a=2&a=1&utm_medium=' || ['banner', 'email', 'CPC'][page_id % 3 + 1] || '#top' FROM pages) """
_KEPT = f"""list_transform(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN {tuple(contacts.TRACKING)}),
lambda x, i: {{'k': split_part(x, '=', 1), 'i': i, 'x': x}})), lambda s: s.x)"""


def _urls(spark: SparkSession, d: str) -> DataFrame:
    pages = sources.table(spark, d, "pages").select("page_id", "url")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    made = F.concat(
        F.lit("HTTP://WWW.Shop"), F.col("page_id") % 7, pick(4, ".com.ba", ".org.uk", ".rs", ".co.rs"), pick(3, ":8080", ":443", ""), F.lit("/a/b//?b="), F.col("page_id"),
        F.lit("&UTM_Source=x&a=2&a=1&utm_medium="), pick(3, "banner", "email", "CPC"), F.lit("#top"),
    )
    return pages.unionByName(pages.select((F.col("page_id") + 1_000_000).alias("page_id"), made.alias("url")))


@query(_URLS + f""", p AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, '^[^:/]*:?//(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)', 1) AS port, regexp_replace(regexp_extract(url, '^[^:/]*:?//[^/?#]*([^?#]*)', 1), '/+$', '') AS path, {_KEPT} AS q FROM u)
SELECT page_id, 'https://' || host || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || path || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical FROM p""")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("page_id", contacts.canonical_url(F.col("url")).alias("canonical"))


_DOMAIN = f"array_to_string(list_slice(string_split(host, '.'), CASE WHEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN {tuple(contacts.TWO_LABELS)} THEN -3 ELSE -2 END, -1), '.')"


@query(_URLS + f", h AS (SELECT {_HOST} AS host FROM u) SELECT {_DOMAIN} AS domain, split_part({_DOMAIN}, '.', 1) AS brand, count(*) AS n FROM h GROUP BY 1, 2")
def registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    host = contacts.host(F.col("url"))
    return _urls(spark, d).groupBy(contacts.registrable_domain(host).alias("domain"), contacts.brand_label(host).alias("brand")).agg(F.count("*").alias("n"))


@query(_URLS + f"SELECT page_id, regexp_matches(regexp_extract(split_part(url, '#', 1), '[?&]utm_medium=([^&]*)', 1), '{contacts.AD_MEDIUM}', 'i') OR regexp_matches(regexp_extract(split_part(url, '#', 1), '[?&]utm_campaign=([^&]*)', 1), '{contacts.AD_MEDIUM}', 'i') AS is_ad FROM u")
def ad_link_flag(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("page_id", contacts.is_ad_link(F.col("url")).alias("is_ad"))


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""".replace("\\\\", "\\"))
def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = sources.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return sources.table(spark, d, "part").select(F.col("p_partkey").alias("id"), name_key(text.fold(F.col("p_name"))).alias("key"))


@query(r"SELECT doc_id, sha256(lower(strip_accents(trim(regexp_replace(text, '[\s\x{00a0}]+', ' ', 'g'))))) AS folded_sha256 FROM documents WHERE text IS NOT NULL")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return sources.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded_sha256"))
