"""Labels, confidences and relevance of leads, and how a classifier's labels compare with the expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import sources
from dossier.functions import display, grading, scoring

from . import query

_ROUND = lambda x, n: f"floor(({x}) * {10**n}::DOUBLE + 0.5) / {10**n}::DOUBLE"
_NET = lambda p: f"CASE WHEN {p}_gate THEN {p}_core + greatest(0, {p}_sup + least({p}_amb, {p}_core + {p}_sup) - {p}_pen) ELSE 0 END"

#: Evidence by axis, by rules of the key, and what is made of it, for the SQL side.
_GRADED = f"""WITH ev AS (SELECT c_custkey AS id, c_custkey * 7 % 13 / 8::DOUBLE AS c_core, c_custkey * 5 % 9 / 16::DOUBLE AS c_sup, c_custkey * 3 % 7 / 8::DOUBLE AS c_amb, c_custkey * 11 % 6 / 16::DOUBLE AS c_pen, c_custkey % 3 <> 0 AS c_gate,
c_custkey * 11 % 12 / 8::DOUBLE AS s_core, c_custkey * 7 % 5 / 16::DOUBLE AS s_sup, c_custkey * 13 % 5 / 8::DOUBLE AS s_amb, c_custkey * 17 % 8 / 16::DOUBLE AS s_pen, c_custkey % 4 <> 0 AS s_gate,
CASE c_custkey % 5 WHEN 0 THEN 'roofing' WHEN 1 THEN 'joinery' END AS industry, c_custkey % 9 = 0 AS asserted, c_custkey * 7919 % 101 AS contactability, c_mktsegment AS segment FROM customer),
net AS (SELECT *, {_ROUND(_NET('c'), 2)} AS c_net, {_ROUND(_NET('s'), 2)} AS s_net, CASE WHEN c_gate THEN c_core + c_sup ELSE 0 END + CASE WHEN s_gate THEN s_core + s_sup ELSE 0 END AS found FROM ev),
lab AS (SELECT *, CASE WHEN c_net >= 0.9 AND s_net >= 0.9 THEN 'BOTH' WHEN c_net >= 0.9 THEN 'FACADE_CONTRACTOR' WHEN s_net >= 0.9 THEN 'CONSTRUCTION_MATERIAL_STORE' WHEN industry IS NOT NULL AND found <= 0 THEN 'OUT_OF_SCOPE' ELSE 'UNCLASSIFIED' END AS label FROM net),
dec AS (SELECT *, CASE label WHEN 'BOTH' THEN least(c_net, s_net) WHEN 'FACADE_CONTRACTOR' THEN c_net WHEN 'CONSTRUCTION_MATERIAL_STORE' THEN s_net END AS decides FROM lab),
conf AS (SELECT *, {_ROUND("least(0.98::DOUBLE, 0.5::DOUBLE + 0.45::DOUBLE * least(1, coalesce(decides - 0.9::DOUBLE, 0.9::DOUBLE - greatest(c_net, s_net)) / 0.9::DOUBLE))", 2)} AS confidence, CASE WHEN NOT asserted THEN coalesce(decides, 0) END AS net FROM dec),
sure AS (SELECT *, greatest(0, least(1, (confidence - 0.5::DOUBLE) / (0.98::DOUBLE - 0.5::DOUBLE))) AS sure FROM conf),
graded AS (SELECT *, CAST(CASE WHEN decides IS NULL THEN 0 ELSE floor(50 + {_ROUND('25 * sure', 2)} + {_ROUND('25 * coalesce(greatest(0, least(1, net / 1.8::DOUBLE)), sure)', 2)} + 0.5) END AS INT) AS relevance FROM sure),
pairs AS (SELECT id, relevance, CASE segment WHEN 'BUILDING' THEN 'FACADE_CONTRACTOR' WHEN 'MACHINERY' THEN 'CONSTRUCTION_MATERIAL_STORE' WHEN 'AUTOMOBILE' THEN 'BOTH' WHEN 'FURNITURE' THEN 'OUT_OF_SCOPE' ELSE 'UNCLASSIFIED' END AS expected, label AS predicted FROM graded) """


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """id, segment, contactability, label, confidence, net and relevance of every lead."""
    k = F.col("c_custkey")
    part = lambda a, m, over: k * a % m / float(over)
    axis = lambda c, s, a, p, gate: (part(*c, 8), part(*s, 16), part(*a, 8), part(*p, 16), k % gate != 0)
    one, two = axis((7, 13), (5, 9), (3, 7), (11, 6), 3), axis((11, 12), (7, 5), (13, 5), (17, 8), 4)
    open_ = lambda x: F.when(x[4], x[0] + x[1]).otherwise(0.0)
    rows = sources.table(spark, d, "customer").select(
        k.alias("id"), F.col("c_mktsegment").alias("segment"), (k * 7919 % 101).alias("contactability"), (k % 9 == 0).alias("asserted"), F.when(k % 5 == 0, "roofing").when(k % 5 == 1, "joinery").alias("industry"),
        scoring.half_up(grading.axis_net(*one), 2).alias("c_net"), scoring.half_up(grading.axis_net(*two), 2).alias("s_net"), (open_(one) + open_(two)).alias("found"),
    )
    c, s, label = F.col("c_net"), F.col("s_net"), F.col("label")
    rows = rows.withColumn("label", grading.label(c, s, F.col("industry"), F.col("found")))
    rows = rows.withColumn("confidence", grading.confidence(label, c, s)).withColumn("net", grading.deciding_net(label, c, s, F.col("asserted")))
    return rows.withColumn("relevance", grading.relevance(label, F.col("confidence"), F.col("net")))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    named = {"BUILDING": "FACADE_CONTRACTOR", "MACHINERY": "CONSTRUCTION_MATERIAL_STORE", "AUTOMOBILE": "BOTH", "FURNITURE": "OUT_OF_SCOPE"}
    expected = F.lit(None).cast("string")
    for segment, label in named.items():
        expected = F.when(F.col("segment") == segment, label).otherwise(expected)
    return _graded(spark, d).select("id", "relevance", F.coalesce(expected, F.lit("UNCLASSIFIED")).alias("expected"), F.col("label").alias("predicted"))


def evaluation(pairs: DataFrame) -> DataFrame:
    """Counts, precision, recall, false-positive rate by label and the accuracy over all, out of pairs (expected, predicted).

    Labels that are neither expected nor predicted have rows of zeros: precision and recall are 1 there, the rate is 0.
    """
    cells = pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    every = F.explode(F.array(*map(F.lit, display.LABELS))).alias("label")
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    a, p = F.col("expected") == F.col("label"), F.col("predicted") == F.col("label")
    per = cells.select("*", every).groupBy("label").agg(F.sum("n").alias("total"), of(a).alias("actual"), of(p).alias("predicted"), of(a & p).alias("true_positives"), of(F.col("expected") == F.col("predicted")).alias("correct"))
    share = lambda x, y, none: F.when(y == 0, float(none)).otherwise(x / y)
    tp, actual, predicted, total = (F.col(c) for c in ("true_positives", "actual", "predicted", "total"))
    return per.select(
        "label", "actual", "predicted", "true_positives", (predicted - tp).alias("false_positives"), (actual - tp).alias("false_negatives"), share(tp, predicted, 1).alias("precision"), share(tp, actual, 1).alias("recall"),
        share(predicted - tp, total - actual, 0).alias("false_positive_rate"), (F.col("correct") / total).alias("accuracy"),
    )


@query(_GRADED + "SELECT id, label, confidence, net, relevance, CAST(floor(relevance * contactability / 100 + 0.5) AS INT) AS lead_score FROM graded")
def graded_leads(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).select("id", "label", "confidence", "net", "relevance", grading.lead_score(F.col("relevance"), F.col("contactability")).alias("lead_score"))


@query(_GRADED + """, l AS (SELECT unnest(['FACADE_CONTRACTOR', 'CONSTRUCTION_MATERIAL_STORE', 'BOTH', 'UNCLASSIFIED', 'OUT_OF_SCOPE']) AS label), t AS (SELECT label, count(*) AS total, count(*) FILTER (expected = label) AS actual,
count(*) FILTER (predicted = label) AS predicted, count(*) FILTER (predicted = label AND expected = label) AS true_positives, count(*) FILTER (expected = predicted) AS correct FROM l, pairs GROUP BY 1)
SELECT label, actual, predicted, true_positives, predicted - true_positives AS false_positives, actual - true_positives AS false_negatives, CASE WHEN predicted = 0 THEN 1 ELSE true_positives / predicted END AS precision,
CASE WHEN actual = 0 THEN 1 ELSE true_positives / actual END AS recall, CASE WHEN total = actual THEN 0 ELSE (predicted - true_positives) / (total - actual) END AS false_positive_rate, correct / total AS accuracy FROM t""")
def classifier_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return evaluation(_pairs(spark, d))


@query(_GRADED + "SELECT expected, " + ", ".join(f"count(*) FILTER (predicted = '{x}') AS {x.lower()}" for x in display.LABELS) + " FROM pairs GROUP BY 1")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    named = {x: x.lower() for x in display.LABELS}
    return _pairs(spark, d).groupBy("expected").pivot("predicted", list(named)).agg(F.count("*")).na.fill(0).withColumnsRenamed(named)


@query(_GRADED + "SELECT expected AS before, predicted AS after, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY expected) AS share, sum(relevance) / count(*) AS mean_relevance FROM pairs GROUP BY 1, 2")
def label_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Leads by label before and after, with their share of the label before and mean relevance."""
    cells = _pairs(spark, d).groupBy(F.col("expected").alias("before"), F.col("predicted").alias("after")).agg(F.count("*").alias("n"), (F.sum("relevance") / F.count("*")).alias("mean_relevance"))
    before = cells.groupBy("before").agg(F.sum("n").alias("of"))
    return cells.join(before, "before").select("before", "after", "n", (F.col("n") / F.col("of")).alias("share"), "mean_relevance")


@query(_GRADED + "SELECT label, count(*) AS n, min(relevance) AS lowest FROM (SELECT * FROM graded ORDER BY relevance DESC, id LIMIT 200) GROUP BY 1")
def top_label_mix(spark: SparkSession, d: str) -> DataFrame:
    """Labels among the 200 most relevant leads."""
    return _graded(spark, d).orderBy(F.desc("relevance"), "id").limit(200).groupBy("label").agg(F.count("*").alias("n"), F.min("relevance").alias("lowest"))
