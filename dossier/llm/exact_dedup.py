"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each partition packs its rows' 64-bit fingerprints, sorted, in chunks ("senders"), which are kept.
2. A sender splits its sorted fingerprints by owner (the top bits) and sends each owner the Golomb-Rice
   coded gaps: about two bits over the information they hold.
3. An owner decodes what it got, finds the fingerprints that occur more than once, within a sender or
   across senders, and returns each sender a bitmap over the order in which that sender sent them.
4. Only rows whose bit is set are suspects. Their texts alone are grouped by fingerprint and bytes, each
   text once from each partition, which decides equality.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] became one space; null counts as empty.
Of equal texts the row with the smallest doc_id stays (null doc_ids come last; of rows that repeat that
doc_id, one). An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, letting_go, materialize, normalized_space, shuffle_partitions

#: Rows of a sender; bounds the memory of packing and of a bitmap.
CHUNK = 32_768
#: Fingerprints that an owner decodes at once, on average at most.
OWNED = 1_000_000


def rice_parameter(n: int, span: int) -> int:
    """Remainder bits for n sorted values spread over span: log2 of the mean gap times ln 2."""
    return max(0, int(math.log2(max(1.0, span / max(1, n) * math.log(2)))))


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code of the gaps of sorted uint64 values: each quotient in ones and a zero, then k remainder bits."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1 + k)
    bits = np.zeros(int(ends[-1]), np.uint8)
    starts = ends - (quotient + 1 + k)
    ones = np.repeat(starts - np.concatenate(([0], np.cumsum(quotient)[:-1])), quotient) + np.arange(int(quotient.sum()))
    bits[ones] = 1
    at = starts + quotient + 1
    for bit in range(k):
        bits[at + bit] = (gaps >> np.uint64(k - 1 - bit)) & np.uint64(1)
    return np.packbits(bits).tobytes()


def golomb_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    bits = (np.unpackbits(np.frombuffer(blob, np.uint8)) + 48).tobytes()
    out, at, value = np.empty(n, np.uint64), 0, 0
    for i in range(n):
        end = bits.index(b"0", at)
        value += (end - at) << k
        if k:
            value += int(bits[end + 1 : end + 1 + k], 2)
        out[i], at = value, end + 1 + k
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, chunk, held, rows = TaskContext.get().partitionId(), 0, [], 0

    def packed():
        table = pa.Table.from_batches(held)
        prints = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(prints, kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        column = lambda name: table[name].chunk(0) if table[name].num_chunks else pa.array([], table[name].type)
        rows = [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), column(c)) for c in ("id", "fp", "sha")]
        return pa.RecordBatch.from_arrays([pa.array([(part << 24) + chunk], pa.int64()), *rows], names=["sender", "ids", "fps", "shas"])

    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            if held and rows + piece.num_rows > CHUNK:
                yield packed()
                held, rows, chunk = [], 0, chunk + 1
            held.append(piece)
            rows += piece.num_rows
    if rows:
        yield packed()


def _edges(owners: int) -> np.ndarray:
    """The first fingerprint of each owner, and the end."""
    return np.array([(i << 64) // owners for i in range(owners)], np.uint64)


def _send(owners: int):
    starts = _edges(owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sender, fps in zip(batch["sender"].to_pylist(), batch["fps"], strict=True):
                prints = fps.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                cuts = np.searchsorted(prints, starts)
                out = []
                for owner, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(prints)], strict=True)):
                    if b > a:
                        k = rice_parameter(b - a, (1 << 64) // owners)
                        out.append((owner, sender, int(b - a), k, golomb_encode(prints[a:b] - starts[owner], k)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["owner", "sender", "n", "k", "blob"])

    return send


def _mark(table: pa.Table) -> pa.Table:
    """What an owner returns: for each message, a bit for each fingerprint, set if it occurs more than once."""
    sent = [golomb_decode(b, n, k) for b, n, k in zip(table["blob"].to_pylist(), table["n"].to_pylist(), table["k"].to_pylist(), strict=True)]
    everything = np.concatenate(sent)
    values, counts = np.unique(everything, return_counts=True)
    twice = values[counts > 1]
    bits = [np.packbits(np.isin(x, twice, kind="sort")).tobytes() for x in sent]
    return pa.table({"sender": table["sender"], "owner": table["owner"], "n": table["n"], "bits": pa.array(bits, pa.binary())})


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sender's rows with their bits, which came by owner, in the order of the fingerprints."""
    for batch in batches:
        for i in range(batch.num_rows):
            replies = sorted(batch["replies"][i].as_py(), key=lambda r: r["owner"])
            bits = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: r["n"]] for r in replies]).astype(bool)
            ids, fps, shas = (batch[c][i].values for c in ("ids", "fps", "shas"))
            rows = pa.array((batch["sender"][i].as_py() << 16) + np.arange(len(bits)), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, fps, shas, rows, pa.array(bits)], names=["id", "fp", "sha", "row", "suspect"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. See the module for what equal means."""
    spark = docs.sparkSession
    norm = normalized_space(F.col(text_col))
    prints = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm")).select("id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    packed = materialize(prints.mapInArrow(letting_go(_pack), "sender long, ids array<long>, fps array<long>, shas array<binary>"), "packed")

    rows = packed.agg(F.sum(F.size("fps"))).first()[0] or 0
    owners = max(1, min(shuffle_partitions(spark), math.ceil(rows / 64)), math.ceil(rows / OWNED))
    messages = packed.select("sender", "fps").mapInArrow(letting_go(_send(owners)), "owner int, sender long, n int, k int, blob binary")
    replies = messages.groupBy("owner").applyInArrow(_mark, "sender long, owner int, n int, bits binary")
    replies = replies.groupBy("sender").agg(F.collect_list(F.struct("owner", "n", "bits")).alias("replies"))
    marked = materialize(packed.join(replies, "sender").mapInArrow(letting_go(_unpack), "id long, fp long, sha binary, row long, suspect boolean"), "marked")

    suspects = marked.where("suspect")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(suspects.select(F.col("id").alias("of")).distinct().hint("merge"), F.col("id").eqNullSafe(F.col("of")), "left_semi")
    texts = texts.select(normalized_space(F.col("text")).alias("norm"))
    classes = texts.groupBy(F.xxhash64("norm").alias("fp"), "norm").agg(F.count("*").alias("copies"))
    classes = classes.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "copies")
    groups = suspects.groupBy("fp", "sha").agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    groups = groups.join(classes, ["fp", "sha"]).select(
        "fp", "sha", F.when(F.col("copies") >= F.col("group_size"), F.col("group_size")).otherwise(F.raise_error(F.lit("texts of one digest differ"))).alias("group_size"), "first"
    )
    joined = marked.join(groups, ["fp", "sha"], "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that exact_dedup drops. Where rows repeat the kept doc_id and text, the one whose columns hash lowest stays."""
    columns = docs.columns
    kept_id, sha, own, at = free_names(columns, "kept_id", "sha", "own", "at")
    decided = materialize(exact_dedup(docs, id_col, text_col), "decided")
    kept = decided.where("kept").select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(sha))
    marked = docs.withColumn(own, F.unhex(F.sha2(normalized_space(F.col(text_col)), 256)))
    out = marked.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(sha)), "left_semi")
    if not decided.where("NOT kept AND doc_id <=> keep_id").isEmpty():
        first = F.row_number().over(Window.partitionBy(id_col, own).orderBy(F.xxhash64(*columns)))
        out = out.withColumn(at, first).where(F.col(at) == 1)
    return out.select(*columns)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""
