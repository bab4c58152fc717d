"""Document fingerprints by content-defined chunking.

A gear hash over the last WINDOW bytes of the UTF-8 text picks boundaries: before NORMAL bytes a harder
mask must be met, after it an easier one (normalised chunking), from MIN to MAX bytes. A fingerprint is
the set of chunk digests with the chunks' lengths; what is inserted or removed moves boundaries only
nearby. Likeness is containment: the share of a fingerprint's length whose chunks the other has too.

A null text is empty and has the empty fingerprint. Two empty fingerprints are alike to 1, an empty one
and another to 0. Equal texts have equal fingerprints. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

MIN, NORMAL, MAX = 16, 48, 192
WINDOW = 16
HARD, EASY = 7, 4
GEAR = np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """For each byte the hash of the WINDOW bytes that end there: each the sum of table values, shifted by age. Built by doubling."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks of data[start:], where start is an end itself or 0. The last is the end of data."""
    n, out = len(data), []
    if start >= n:
        return out
    context = max(0, start - WINDOW + 1)
    h = gear(np.frombuffer(data, np.uint8, offset=context))
    easy = np.flatnonzero(h >> np.uint32(32 - EASY) == 0)
    hard = (easy[h[easy] >> np.uint32(32 - HARD) == 0] + (context + 1)).tolist()
    easy = (easy + (context + 1)).tolist()
    while start < n:
        if n - start <= MIN:
            out.append(n)
            break
        i = bisect_left(hard, start + MIN)
        end = hard[i] if i < len(hard) and hard[i] < start + NORMAL else 0
        if not end:
            i = bisect_left(easy, start + NORMAL)
            end = easy[i] if i < len(easy) and easy[i] < start + MAX else start + MAX
        start = min(end, n)
        out.append(start)
    return out


def chunks(data: bytes, ends: list[int], start: int = 0) -> dict[str, int]:
    digest, out = xxhash.xxh3_64_hexdigest, {}
    for end in ends:
        out[digest(data[start:end])[:12]] = end - start
        start = end
    return out


def fingerprint(data: bytes) -> dict[str, int]:
    """Chunk digest to length in bytes."""
    return chunks(data, cuts(data))


def written(print_: dict[str, int]) -> str:
    return ",".join([f"{d}:{n}" for d, n in sorted(print_.items())])


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    return sum([n for d, n in a.items() if d in b]) / sum(a.values())


class _Doc:
    def __init__(self, doc_id: int | None, text: str):
        self.id, self.text, self.data = doc_id, text, text.encode()
        self.ends = cuts(self.data)
        self.print = chunks(self.data, self.ends)

    def edited(self, after: str) -> tuple[bytes, dict[str, int]]:
        """The text with its last third from `after`, and the fingerprint; chunks that end before the edit are not cut again."""
        third = len(self.text) // 3
        kept = self.text[: len(self.text) - third].encode()
        data = kept + after[:third].encode()
        same = self.ends[: max(0, min(bisect_left(self.ends, len(kept)), len(self.ends) - 1))]
        start = same[-1] if same else 0
        return data, chunks(data, same + cuts(data, start))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's rows in their order, then its guest, the first of the next bucket; each with the row that follows."""
    rows: list[tuple] = []

    def packed() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for doc_id, text, guest in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), part["guest"].to_pylist(), strict=True):
                if guest and held is None:
                    continue  # of rows that repeat the first id only the first is the guest
                doc = _Doc(doc_id, text or "")
                if held is not None:
                    data, print_ = held.edited(doc.text)
                    rows.append((held.id, len(held.text), hashlib.sha256(data).hexdigest(), written(held.print), written(print_), likeness(held.print, print_), likeness(held.print, doc.print)))
                held = None if guest else doc
            if len(rows) >= 64:
                yield packed()
                rows.clear()
    if rows:
        yield packed()


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of the next lower id (null last, repeated ids by their texts' hash), after the last the first.
    Documents go by ranges of ids to buckets, once; a bucket also gets the first document of the bucket after it.
    The driver sees the ranges' borders and first ids, one of each for a partition.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(1 << 63)).cast("long")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), lowest).alias("key"))
    n = shuffle_partitions(spark)
    borders = keyed.agg(F.percentile_approx("key", [i / n for i in range(n - 1, 0, -1)], 20 * n)).first()[0] if n > 1 else []
    borders = sorted(set(borders or []), reverse=True)
    step = max(1, int(len(borders) ** 0.5))
    # the bucket is the number of borders above the key: first among every step-th border, then within that step
    coarse = F.array(*[F.lit(b).cast("long") for b in borders[step - 1 :: step]])
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in borders[i : i + step]]) for i in range(0, len(borders), step)])
    above = lambda array: F.size(F.filter(array, lambda b: b > F.col("key")))
    if borders:
        keyed = keyed.withColumn("leap", above(coarse))
        within = F.coalesce(F.try_element_at(fine, F.col("leap") + 1), F.array().cast("array<bigint>"))
        keyed = keyed.withColumn("bucket", F.col("leap") * step + above(within)).drop("leap")
    else:
        keyed = keyed.withColumn("bucket", F.lit(0))
    firsts = sorted((r["bucket"], r["first"]) for r in keyed.groupBy("bucket").agg(F.max("key").alias("first")).collect())
    if not firsts:
        firsts = [(0, 0)]
    host = {bucket: firsts[i - 1][0] for i, (bucket, _) in enumerate(firsts)}
    as_map = lambda pairs: F.create_map(*[F.lit(x) for p in pairs for x in p])
    first = F.element_at(as_map(firsts), F.col("bucket")) == F.col("key")
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest"))
    guest = F.struct(F.element_at(as_map(host.items()), F.col("bucket")).alias("to"), F.lit(True).alias("guest"))
    sent = keyed.withColumn("sent", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", "text", "key", "sent.*")
    dealt = sent.repartitionById(len(borders) + 1, F.col("to")).sortWithinPartitions("guest", F.desc("key"), F.xxhash64("text"), "text")
    return dealt.select("doc_id", "text", "guest").mapInArrow(
        _follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
