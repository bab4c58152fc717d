"""The list of leads: filters, search, sort keys, pages and the aggregates of one page."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from urllib.parse import parse_qs, urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sources

from . import query

SORT_KEYS = ("score", "name", "classification", "municipality_id", "id")


@dataclass(frozen=True)
class LeadQuery:
    """Filters that are None or empty do not apply. Pages start at 1 and are clamped; ties always go by id."""

    classifications: tuple[str, ...] = ()
    municipality_id: int | None = None
    source_id: str | None = None
    has_phone: bool | None = None
    min_score: float = 0
    text: str = ""
    sort: str = "score"
    descending: bool = True
    page: int = 1
    page_size: int = 50


#: Parameters of a list's link and the fields of LeadQuery that they set.
_PARAMETERS = {"q": "text", "opstina": "municipality_id", "type": "classifications", "minScore": "min_score", "phone": "has_phone", "izvor": "source_id", "sort": "sort", "dir": "descending", "page": "page", "perPage": "page_size"}


def parse(link: str, labels: tuple[str, ...] = ()) -> LeadQuery:
    """The query of a link's parameters. Values that the list doesn't know, and numbers that aren't any, leave the default; labels, if given, are those it knows."""
    given = parse_qs(link.partition("?")[2] if "?" in link else link)
    one = lambda name: given.get(name, [""])[0].strip()
    number = lambda name: int(one(name)) if re.fullmatch(r"-?[0-9]+", one(name)) else None
    kinds = tuple(dict.fromkeys(x.strip() for value in given.get("type", []) for x in value.split(",") if x.strip() and (not labels or x.strip() in labels)))
    found = {
        "text": one("q"), "municipality_id": number("opstina"), "classifications": kinds, "min_score": number("minScore"), "has_phone": {"yes": True, "no": False}.get(one("phone")), "source_id": one("izvor") or None,
        "sort": one("sort") if one("sort") in SORT_KEYS else None, "descending": {"asc": False, "desc": True}.get(one("dir")), "page": number("page"), "page_size": number("perPage"),
    }
    return LeadQuery(**{k: v for k, v in found.items() if v is not None})


def link(q: LeadQuery, **changes: object) -> str:
    """The parameters that `parse` reads back as q with changes, those of the default left out; a change goes back to the first page."""
    q = replace(q, **{"page": 1, **changes}) if changes else q
    write = {True: "yes", False: "no"}
    shown = {name: getattr(q, field) for name, field in _PARAMETERS.items() if getattr(q, field) != getattr(LeadQuery(), field)}
    text = {k: ",".join(v) if k == "type" else ("desc" if v else "asc") if k == "dir" else write[v] if k == "phone" else str(v) for k, v in shown.items()}
    return f"?{urlencode(text)}" if text else ""


def matching(spark: SparkSession, d: str, q: LeadQuery) -> DataFrame:
    found = sources.active(sources.leads(spark, d))
    if q.classifications:
        found = found.where(F.col("classification").isin(*q.classifications))
    if q.municipality_id is not None:
        found = found.where(F.col("municipality_id") == q.municipality_id)
    if q.min_score > 0:
        found = found.where(F.col("score") >= q.min_score)
    if q.text:
        found = found.where(F.contains(F.lower("name"), F.lit(q.text.lower())))
    if q.has_phone is not None:
        valid = sources.phones(spark, d).where("valid").select(F.col("lead_id").alias("id"))
        found = found.join(valid, "id", "left_semi" if q.has_phone else "left_anti")
    if q.source_id is not None:
        seen = sources.sightings(spark, d).where(F.col("source_id") == q.source_id).select(F.col("lead_id").alias("id"))
        found = found.join(seen, "id", "left_semi")
    return found


def page(spark: SparkSession, d: str, q: LeadQuery) -> DataFrame:
    """One page of leads with their phones and sources, in the list's order; a page beyond the last is the last. Only the page's leads are aggregated.

    The page's ids, 200 at most, come to the driver, so that list and aggregates don't plan the search twice.
    """
    if q.sort not in SORT_KEYS:
        raise ValueError(f"no sort key {q.sort}")
    size = max(1, min(200, q.page_size))
    key = F.desc(q.sort) if q.descending else F.asc(q.sort)
    found = matching(spark, d, q).select("id", "name", "municipality_id", "classification", "score")
    at = max(1, q.page) - 1
    rows = found.orderBy(key, "id").offset(at * size).limit(size).collect()
    if not rows and at and (total := found.count()):
        back = F.asc(q.sort) if q.descending else F.desc(q.sort)
        rows = found.orderBy(back, F.desc("id")).limit((total - 1) % size + 1).collect()  # the last page, from the end
    rows = spark.createDataFrame(rows, found.schema).coalesce(1)
    seen = sources.phones(spark, d).withColumnRenamed("lead_id", "id").join(F.broadcast(rows.select("id")), "id", "left_semi")
    per = seen.groupBy("id").agg(F.count_distinct("source_id").alias("n_sources"), F.count_distinct(F.when(F.col("valid"), F.col("e164"))).alias("n_phones"))
    return rows.join(per, "id", "left").na.fill(0, ["n_sources", "n_phones"]).orderBy(key, "id")


def page_count(spark: SparkSession, d: str, q: LeadQuery) -> DataFrame:
    """total and pages of a search."""
    size = max(1, min(200, q.page_size))
    return matching(spark, d, q).agg(F.count("*").alias("total")).select("total", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long").alias("pages"))


_PAGE = """, page AS (SELECT id, name, municipality_id, classification, score FROM active {where} ORDER BY {order}, id LIMIT {limit} OFFSET {offset})
SELECT p.*, coalesce(n_sources, 0) AS n_sources, coalesce(n_phones, 0) AS n_phones FROM page p LEFT JOIN (SELECT lead_id, count(DISTINCT source_id) AS n_sources,
count(DISTINCT CASE WHEN valid THEN e164 END) AS n_phones FROM phones GROUP BY lead_id) a ON a.lead_id = p.id"""


@query(_PAGE.format(where="WHERE score >= 100 AND EXISTS (SELECT 1 FROM phones x WHERE x.lead_id = active.id AND x.valid)", order="score DESC", limit=50, offset=0))
def list_leads_page(spark: SparkSession, d: str) -> DataFrame:
    return page(spark, d, LeadQuery(has_phone=True, min_score=100))


@query("SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 50.0) AS BIGINT), 1) AS pages FROM active WHERE score >= 100")
def list_leads_count(spark: SparkSession, d: str) -> DataFrame:
    return page_count(spark, d, LeadQuery(min_score=100))


@query(_PAGE.format(where="", order="score DESC", limit=50, offset=0).replace("OFFSET 0", "OFFSET (SELECT greatest((count(*) - 1) // 50, 0) * 50 FROM active)"))
def list_leads_last_page(spark: SparkSession, d: str) -> DataFrame:
    """A page beyond the last one, whatever its number, is the last one."""
    return page(spark, d, LeadQuery(page=page_count(spark, d, LeadQuery()).first()["pages"] + 1))


@query(_PAGE.format(where="", order="name", limit=50, offset=0).replace("OFFSET 0", "OFFSET (SELECT least(7, greatest((count(*) - 1) // 50, 0)) * 50 FROM active)"))
def list_leads_deep_page(spark: SparkSession, d: str) -> DataFrame:
    return page(spark, d, LeadQuery(sort="name", descending=False, page=8))


@query(_PAGE.format(where="""WHERE classification IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND NOT EXISTS (SELECT 1 FROM phones x WHERE x.lead_id = active.id AND x.valid)""", order="score", limit=200, offset=0))
def list_leads_without_phone(spark: SparkSession, d: str) -> DataFrame:
    return page(spark, d, LeadQuery(classifications=("BUILDING", "MACHINERY", "HOUSEHOLD"), has_phone=False, descending=False, page_size=500))


@query(_PAGE.format(where="""WHERE contains(lower(name), '#0000001') AND EXISTS (SELECT 1 FROM sightings x WHERE x.lead_id = active.id AND x.source_id = '1-URGENT')""", order="score DESC", limit=50, offset=0))
def list_leads_search(spark: SparkSession, d: str) -> DataFrame:
    return page(spark, d, LeadQuery(text="#0000001", source_id="1-URGENT"))


@query("SELECT classification, count(*) AS n FROM active GROUP BY classification")
def facets_classification(spark: SparkSession, d: str) -> DataFrame:
    return sources.active(sources.leads(spark, d)).groupBy("classification").agg(F.count("*").alias("n"))


@query("SELECT source_id, count(DISTINCT lead_id) AS n FROM sightings s JOIN active a ON a.id = s.lead_id GROUP BY source_id")
def facets_source(spark: SparkSession, d: str) -> DataFrame:
    ids = sources.active(sources.leads(spark, d)).select(F.col("id").alias("lead_id"))
    return sources.sightings(spark, d).select("lead_id", "source_id").distinct().join(ids, "lead_id").groupBy("source_id").agg(F.count("*").alias("n"))


@query("SELECT id FROM active WHERE EXISTS (SELECT 1 FROM sightings s WHERE s.lead_id = id)")
def semi_has_sighting(spark: SparkSession, d: str) -> DataFrame:
    return sources.active(sources.leads(spark, d)).select("id").join(sources.sightings(spark, d).select(F.col("lead_id").alias("id")), "id", "left_semi")


@query("SELECT id FROM active WHERE NOT EXISTS (SELECT 1 FROM sightings s WHERE s.lead_id = id AND s.source_id = '1-URGENT')")
def anti_not_urgent(spark: SparkSession, d: str) -> DataFrame:
    urgent = sources.sightings(spark, d).where(F.col("source_id") == "1-URGENT").select(F.col("lead_id").alias("id"))
    return sources.active(sources.leads(spark, d)).select("id").join(urgent, "id", "left_anti")


@query("SELECT id, CASE WHEN score >= 7500 THEN 'high' WHEN score >= 4500 THEN 'mid' ELSE 'low' END AS band FROM active")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("score") >= 7500, "high").when(F.col("score") >= 4500, "mid").otherwise("low")
    return sources.active(sources.leads(spark, d)).select("id", band.alias("band"))
