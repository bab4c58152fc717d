"""Secret scans with multipart credential linking, in built-in expressions only.

Base spans, leftmost and non-overlapping for each kind, always reported:
  assign  a password, secret, token or key with a value of MIN_VALUE or more characters
  access  an AKIA identifier of MIN_ACCESS or more characters
  hex     a run of MIN_HEX or more lower-case hexadecimal digits
Weak candidates, reported only where complementary parts lie within SCOPE code points:
  ident     a user, login, account or client named by an assignment; needs a secret (assign, hex, blob, short)
  blob      a bare run of exactly 40 base64 characters with a digit and both cases; needs an identifier (access, ident)
  short     an assign whose value is too short for the base; needs an identifier
  endpoint  a URL or IPv4 address; needs an identifier and a secret
A part never supports itself. Positions are code points, ends exclusive.

A null text is empty, and a text without parts has no spans. Rows that repeat an id are each judged by
their own text. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16
SCOPE = 160
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run that is long enough is what a shorter bound would have matched there, and a failing run holds no later match.
ACCESS = rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}"
HEX = rf"[0-9a-f]{{{MIN_HEX},}}"
IDENT = r"""(?i)\b(?:user(?:name|_?id)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
BLOB = r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""https?://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"""
KINDS = ("assign", "access", "hex", "ident", "blob", "short", "endpoint")
SPAN = "array<struct<start:int,end:int,value:int>>"


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value): where the matches of pattern lie, and the length of the given group.

    The text between matches and the matches alternate, so their lengths add up to the positions.
    """
    between = F.split(text, pattern, -1)
    pieces = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, v: F.struct(F.length(m).alias("n"), F.length(v).alias("v")))
    pieces = F.zip_with(F.slice(between, 1, F.size(pieces)), pieces, lambda g, p: F.struct(F.length(g).alias("gap"), p["n"].alias("n"), p["v"].alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["v"].alias("value"))
        return F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(SPAN)), F.array(span)).alias("out"))

    found = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found)


def _tagged(found: Column, kind: str) -> Column:
    return F.transform(F.coalesce(found, F.array().cast(SPAN)), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _joined(array: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(array), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs: doc_id, base and linked, arrays of (start, kind, end) sorted by start and kind; kind counts into KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("print"), spans(text, ASSIGN, 2).alias("pairs"),
        *(spans(text, p).alias(k) for k, p in (("access", ACCESS), ("hex", HEX), ("ident", IDENT), ("blob", BLOB), ("endpoint", ENDPOINT))),
    )
    base = F.concat(_tagged(F.filter("pairs", lambda s: s["value"] >= MIN_VALUE), "assign"), _tagged(F.col("access"), "access"), _tagged(F.col("hex"), "hex"))
    weak = F.concat(*(_tagged(F.col(k), k) for k in ("ident", "blob", "endpoint")), _tagged(F.filter("pairs", lambda s: s["value"] < MIN_VALUE), "short"))
    parts = materialize(raw.select("doc_id", "print", F.array_sort(base).alias("base"), weak.alias("weak")), "parts")

    # interval join as a sweep: the nearest complementary part before and after each candidate
    k = {name: i for i, name in enumerate(KINDS)}
    open_ = parts.where("size(weak) > 0 AND size(weak) + size(base) > 1").select("doc_id", "print", F.explode(F.concat("base", "weak")).alias("p")).select("doc_id", "print", "p.*").distinct()
    order = Window.partitionBy("doc_id", "print").orderBy("start", "kind", "end")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def near(*kinds: str) -> Column:
        mine = F.col("kind").isin([k[x] for x in kinds])
        return F.coalesce(F.max(F.when(mine, F.col("end"))).over(before) >= F.col("start") - scope, F.lit(False)) | F.coalesce(F.min(F.when(mine, F.col("start"))).over(after) <= F.col("end") + scope, F.lit(False))

    swept = open_.withColumn("identified", near("access", "ident")).withColumn("secret", near("assign", "hex", "blob", "short"))
    kind = F.col("kind")
    linked = swept.where(((kind == k["ident"]) & F.col("secret")) | (kind.isin(k["blob"], k["short"]) & F.col("identified")) | ((kind == k["endpoint"]) & F.col("secret") & F.col("identified")))
    linked = linked.groupBy(F.col("doc_id").alias("of"), F.col("print").alias("of_print")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    out = parts.join(linked, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")), "left")
    return out.select("doc_id", "base", F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("linked"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "linked")).alias("spans"))
