"""From the evidence of a classifier's axes to a label, its confidence and the relevance of a lead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import display
from .scoring import clamp, half_up

# Evidence an axis needs, weights of relevance, the span of confidences, the evidence that earns all points.
THRESHOLD = 0.9
LABEL, CONFIDENCE, EVIDENCE = 50.0, 25.0, 25.0
FLOOR, CEILING, FULL = 0.5, 0.98, 1.8


def axis_net(core: Column, supporting: Column, ambiguous: Column, penalty: Column, gate: Column) -> Column:
    """Evidence left on an axis. Ambiguous words count only as far as others speak for it; a closed gate leaves nothing."""
    credit = F.least(ambiguous, core + supporting)
    return F.when(gate, core + F.greatest(F.lit(0.0), supporting + credit - penalty)).otherwise(0.0)


def label(contractor: Column, store: Column, industry: Column, in_scope_evidence: Column) -> Column:
    """Out of scope only where another trade is found and nothing speaks for a buyer group."""
    a, b = contractor >= THRESHOLD, store >= THRESHOLD
    return (
        F.when(a & b, "BOTH").when(a, "FACADE_CONTRACTOR").when(b, "CONSTRUCTION_MATERIAL_STORE")
        .when(industry.isNotNull() & (in_scope_evidence <= 0), display.OUT_OF_SCOPE).otherwise(display.UNCLASSIFIED)
    )


def confidence(label: Column, contractor: Column, store: Column) -> Column:
    """0.5 to 0.98 by the distance from the threshold, of the axis that decides: the weaker of two, the better one of a miss."""
    decides = F.when(label == "BOTH", F.least(contractor, store)).when(label == "FACADE_CONTRACTOR", contractor).when(label == "CONSTRUCTION_MATERIAL_STORE", store)
    far = F.coalesce(decides - THRESHOLD, THRESHOLD - F.greatest(contractor, store))
    return half_up(F.least(F.lit(CEILING), 0.5 + 0.45 * F.least(F.lit(1.0), far / THRESHOLD)), 2)


def deciding_net(label: Column, contractor: Column, store: Column, asserted: Column) -> Column:
    """The evidence a label rests on; 0 where it is undecided, null where the source asserted it."""
    return F.when(~asserted, F.when(label == "BOTH", F.least(contractor, store)).when(label == "FACADE_CONTRACTOR", contractor).when(label == "CONSTRUCTION_MATERIAL_STORE", store).otherwise(0.0))


def relevance(label: Column, confidence: Column, net: Column) -> Column:
    """0 to 100; without net evidence the confidence stands in for it. Undecided labels earn nothing."""
    sure = clamp((confidence - FLOOR) / (CEILING - FLOOR))
    points = LABEL + half_up(CONFIDENCE * sure, 2) + half_up(EVIDENCE * F.coalesce(clamp(net / FULL), sure), 2)
    return F.when(display.in_scope(label), half_up(points)).otherwise(0.0).cast("int")


def lead_score(relevance: Column, contactability: Column) -> Column:
    return half_up(relevance * contactability / 100).cast("int")
