"""Company names as listings write them, their keys, and how alike names of one key's block are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sources
from dossier.functions import names

from . import query

PLACES = ("Novi Sad", "Beograd", "Čačak")
_WRITTEN = ("%s d.o.o.", 'SZR "%s" Novi Sad', "DOO %s Beograd", "%s PR Milan Ilić", "%s a.d.", "Zanatska radnja %s Čačak", "%s  Srbija", "d.o.o.")
_STEP = "trim(regexp_replace(replace(' ' || replace(x, ' ', '  ') || ' ', ' ' || replace(w, ' ', '  ') || ' ', ''), ' +', ' ', 'g'))"
_ENDS = "trim(regexp_replace(regexp_replace(x, '^' || w || ' ', ''), ' ' || w || '$', ''))"
_FORMS = [w for f in names.FORMS if f not in names.AT_ENDS for w in names.FORMS[f]]
_strip = lambda s, ws, step: f"list_reduce([{s}] || {ws}, lambda x, w: CASE WHEN {step} = '' THEN x ELSE {step} END)"
_forms = lambda s: _strip(_strip(s, _FORMS, _STEP), list(names.FORMS["a.d."]), _ENDS)
_COMPANIES = ("WITH raw AS (SELECT p_partkey AS id, p_brand AS brand, replace([" + ", ".join("'" + w + "'" for w in _WRITTEN) + f"][p_partkey % {len(_WRITTEN)} + 1], '%s', p_name) AS raw FROM part), "
+ r"""d AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS display FROM raw), q AS (SELECT *, nullif(regexp_extract(display, '"([^"]{2,})"', 1), '') AS trade_name FROM d),
t AS (SELECT *, trim(regexp_replace(lower(coalesce(trade_name, display)), '[^\pL\pN]+', ' ', 'g')) AS w, ' ' || trim(regexp_replace(lower(display), '[^\pL\pN]+', ' ', 'g')) || ' ' AS everything FROM q),
c AS (SELECT *, regexp_replace(w, '(\S) (novi sad|beograd|čačak)$', '\1') AS w1 FROM t), f AS (SELECT *, """ + _forms("w1") + """ AS w2 FROM c),
n AS (SELECT *, """ + _strip("w2", list(names.NOISE), _STEP) + """ AS normalized FROM f),
company AS (SELECT id, brand, display, normalized, strip_accents(normalized) AS ascii, CASE WHEN contains(everything, ' zanatska radnja ') THEN 'zanatska radnja' WHEN contains(everything, ' d o o ') OR contains(everything, ' doo ') THEN 'd.o.o.'
WHEN contains(everything, ' szr ') THEN 'szr' WHEN contains(everything, ' pr ') THEN 'pr' WHEN ends_with(everything, ' a d ') THEN 'a.d.' END AS legal_form, trade_name,
CASE WHEN ends_with(everything, ' novi sad ') THEN 'Novi Sad' WHEN ends_with(everything, ' beograd ') THEN 'Beograd' WHEN ends_with(everything, ' čačak ') THEN 'Čačak' END AS city_hint FROM n) """)  # fmt: skip


def _companies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    form = F.element_at(F.array(*map(F.lit, _WRITTEN)), (k % len(_WRITTEN) + 1).cast("int"))
    raw = sources.table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("brand"), F.replace(form, F.lit("%s"), F.col("p_name")).alias("raw"))
    return names.normalized(raw, "raw", PLACES).drop("raw")


@query(_COMPANIES + "SELECT id, display, normalized, ascii, legal_form, trade_name, city_hint FROM company")
def company_names(spark: SparkSession, d: str) -> DataFrame:
    return _companies(spark, d).select("id", "display", "normalized", "ascii", "legal_form", "trade_name", "city_hint")


@query(_COMPANIES + "SELECT legal_form, count(*) AS n, count(DISTINCT ascii) AS n_names FROM company GROUP BY 1")
def legal_forms(spark: SparkSession, d: str) -> DataFrame:
    return _companies(spark, d).groupBy("legal_form").agg(F.count("*").alias("n"), F.count_distinct("ascii").alias("n_names"))


_WEIGHT = "CASE WHEN list_contains(" + str(names.GENERIC) + ", x) THEN 0.35::DOUBLE ELSE 1 END"
_TOTAL = lambda c: f"list_sum(list_transform({c}, lambda x: {_WEIGHT}))"


@query(_COMPANIES + f""", word AS (SELECT DISTINCT brand, ascii, string_split(ascii, ' ') AS t FROM company), pair AS (SELECT a.brand, a.ascii AS a, b.ascii AS b, a.t AS x, b.t AS y FROM word a JOIN word b ON a.brand = b.brand AND a.t[1] = b.t[1] AND a.ascii < b.ascii),
s AS (SELECT *, 1 - levenshtein(replace(a, ' ', ''), replace(b, ' ', ''))::DOUBLE / greatest(length(replace(a, ' ', '')), length(replace(b, ' ', ''))) AS letters, least(1, coalesce({_TOTAL('list_intersect(x, y)')}, 0) / (({_TOTAL('x')} + {_TOTAL('y')}) / 2)) AS words FROM pair)
SELECT brand, a, b, floor(greatest(words, CASE WHEN letters >= 0.92 THEN letters ELSE letters * 0.7::DOUBLE END) * 1000 + 0.5) / 1000 AS similarity FROM s""")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """Different names of one brand that begin alike, and how alike they are. The words of the driver's names differ too much to be alike without being equal, so SQL can count the equal ones."""
    found = _companies(spark, d).select("brand", "ascii", "tokens", F.try_element_at("tokens", F.lit(1)).alias("first")).distinct()
    a, b = found.withColumnsRenamed({"ascii": "a", "tokens": "x"}), found.withColumnsRenamed({"ascii": "b", "tokens": "y"})
    return a.join(b, ["brand", "first"]).where("a < b").select("brand", "a", "b", names.similarity(F.col("x"), F.col("y")).alias("similarity"))
