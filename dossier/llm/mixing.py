"""Mixing sources to target weights by subset-sum budget fitting.

Sources, by code point and null last, weigh 1, 2, 3, repeating, and share all words. A target stops at
MOST times its source's words; the excess is shared anew by weight until none is above.

A source with target T and S words takes each document floor(T / S) times. What is then left of T is
filled by taking some documents once more: documents are counted by exact length, each length gives its
proportional share, and a bounded-knapsack over the lengths' remaining documents fits the rest. Which
documents of a length are taken follows from a seeded hash of their id.

Words are runs of [^\\x20\\x09-\\x0D]; a null text has none. A document without words takes none. Sources
without words have target 0. An empty table gives no rows. Rows that repeat an id are taken each for
itself. Other columns are not looked at.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, materialize, ordinal

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20
#: Words that the knapsack's table spans beyond four times the longest document.
WINDOW = 65_536
#: Documents of one length that are ranked together.
RANKED = 256


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with a double target. Each round is one aggregate over the sources; the driver sees one row a round."""
    table = materialize(ordinal(sources, "source", "place").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")), "sources")
    cap = F.col("source_size") * most
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rate, share = None, F.lit(0.0)
    while total:
        over = (cap < share) if rate is not None else F.lit(False)
        row = table.agg(F.sum(F.when(over, cap).otherwise(0)).alias("capped"), F.sum(F.when(~over, F.col("weight")).otherwise(0.0)).alias("weight")).first()
        new = (total - row["capped"]) / row["weight"] if row["weight"] else rate
        if new == rate:
            break
        rate, share = new, F.lit(float(new)) * F.col("weight")
    return table.select("source", "source_size", F.least(cap.cast("double"), share).alias("target"))


def fit(sizes: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length (ascending, positive) to take so that their words come nearest to budget.

    Shares proportional to the counts come first; then long before short while over a window of words is
    left; then the knapsack: reachable sums as bits of an integer, a length's remaining count in powers of
    two, until the rest is hit exactly or all lengths are in.
    """
    whole = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget <= 0 or not whole:
        return [0] * len(sizes)
    if budget >= whole:
        return list(counts)
    taken = [c * budget // whole for c in counts]
    rest = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    for i in range(len(sizes) - 1, -1, -1):
        if rest > window:
            more = min(counts[i] - taken[i], (rest - window) // sizes[i])
            taken[i] += more
            rest -= more * sizes[i]
    limit = rest + sizes[-1]
    keep = (1 << (limit + 1)) - 1
    reach, layers = 1, []
    for i, s in enumerate(sizes):
        left, step = min(counts[i] - taken[i], limit // s), 1
        while left > 0 and not reach >> rest & 1:
            n = min(step, left)
            layers.append((i, n, reach))
            reach |= (reach << (s * n)) & keep
            left, step = left - n, step * 2
    low = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    high = reach >> (rest + 1)
    best = low
    if high:
        above = rest + 1 + (high & -high).bit_length() - 1
        best = above if above - rest < rest - low else low
    for i, n, before in reversed(layers):
        if not before >> best & 1:
            best -= n * sizes[i]
            taken[i] += n
    return taken


def _plan(window: int):
    def plan(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = int(target // whole)
        rest = round(target - base * whole)
        pdf["base"] = base
        pdf["more"] = fit(pdf["size"].tolist(), pdf["n"].tolist(), rest, max(window, 4 * int(pdf["size"].max())))
        return pdf[["of", "none", "size", "n", "source_size", "target", "base", "more"]]

    return plan


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, and times, how often the mix takes the document."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("of"), F.col(source_col).isNull().alias("none"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = materialize(sized.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(0x7FFFFFFF)), "sized")
    counts = materialize(sized.groupBy("of", "none", "size").agg(F.count("*").alias("n")), "counts")
    sources = counts.groupBy("of", "none").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(sources.select(F.when(~F.col("none"), F.col("of")).alias("source"), "source_size"), weights, most)
    aims = materialize(aims.select(F.coalesce("source", F.lit("")).alias("of"), F.col("source").isNull().alias("none"), "source_size", "target"), "aims")

    lengths = counts.where("size > 0").join(aims, ["of", "none"])
    plan = lengths.groupBy("of", "none").applyInPandas(_plan(WINDOW), "of string, none boolean, size long, n long, source_size long, target double, base long, more long")
    nothing = counts.where("size = 0").join(aims, ["of", "none"]).select("of", "none", "size", "n", "source_size", "target", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("more"))
    plan = materialize(plan.unionByName(nothing), "plan")

    # of a length's documents the ones with the smallest draws are taken once more: whole buckets of draws, and part of one
    bucket = F.floor(F.col("draw") * F.ceil(F.col("n") / RANKED) / F.lit(float(1 << 31))).cast("long")
    dealt = materialize(sized.join(plan, ["of", "none", "size"]).withColumn("bucket", bucket), "dealt")
    open_ = F.col("more").between(F.lit(1), F.col("n") - 1)
    buckets = dealt.where(open_).groupBy("of", "none", "size", "bucket").agg(F.count("*").alias("here"), F.first("more").alias("more"))
    before = F.sum("here").over(Window.partitionBy("of", "none", "size").orderBy("bucket")) - F.col("here")
    buckets = buckets.select("of", "none", "size", "bucket", "here", F.least("here", F.greatest(F.lit(0).cast("long"), F.col("more") - before)).alias("need"))
    ranked = dealt.where(open_).join(buckets, ["of", "none", "size", "bucket"])
    rank = F.row_number().over(Window.partitionBy("of", "none", "size", "bucket").orderBy("draw", F.col("doc_id")))
    ranked = ranked.select("doc_id", "size", "source_size", "target", (F.col("base") + (rank <= F.col("need")).cast("long")).alias("times"))
    plain = dealt.where(~open_).select("doc_id", "size", "source_size", "target", (F.col("base") + (F.col("more") >= F.greatest("n", F.lit(1))).cast("long")).alias("times"))
    return ranked.unionByName(plain).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, all columns, each row as often as the mix takes it. Of rows that repeat an id all take as much as the first."""
    of, times, copy = free_names(docs.columns, "of", "times", "copy")
    wanted = mix(docs, id_col, text_col, source_col).where("times > 0").groupBy(F.col("doc_id").alias(of)).agg(F.max("times").alias(times))
    joined = docs.join(wanted, F.col(id_col).eqNullSafe(F.col(of)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)
