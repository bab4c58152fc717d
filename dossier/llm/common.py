"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import materialize, release

__all__ = ["SPACE", "WORD", "free_names", "hash_filter", "let_go", "letting_go", "materialize", "normalized_space", "ordinal", "passes", "release", "shuffle_partitions", "small_batches"]

#: The white space that the operators' contracts mean, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Python gets texts in batches of `rows`, not of 10,000, which may be long: bounds what JVM and Python hold of them at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(rows, int(spark.conf.get(key)) or rows)))


def let_go() -> None:
    """Gives the memory that Arrow and Python's C library hold unused back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def letting_go(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which lets go of memory when a task's batches are done."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        let_go()

    return whole


def free_names(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so, upper and lower case being the same."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def normalized_space(text: Column) -> Column:
    """Each run of white space becomes one space. Single spaces already are what they become, so the pattern passes them by."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def ordinal(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a long column `name`: the row's place, from 0, in the order of `column`, nulls last.

    Rows are dealt by ranges and numbered within them; the driver sees one count for each range only.
    """
    from pyspark.sql import Window

    n = shuffle_partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, F.col(column).asc_nulls_last()).withColumn("__range", F.spark_partition_id())
    placed = materialize(dealt, "ordinal")
    local = placed.withColumn("__local", F.row_number().over(Window.partitionBy("__range").orderBy(F.col(column).asc_nulls_last())).cast("long") - 1)
    at, before = 0, {}
    for row in sorted(placed.groupBy("__range").count().collect()):
        before[row["__range"]], at = at, at + row["count"]
    if not before:
        return local.withColumn(name, F.col("__local")).drop("__range", "__local")
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    return local.withColumn(name, F.col("__local") + F.element_at(offsets, F.col("__range"))).drop("__range", "__local")


#: Bits of a filter of 64-bit hashes: fixed, so that it can be broadcast. What passes it wrongly must be dropped later.
FILTER = 1 << 24


def hash_filter(df: DataFrame, column: str) -> bytes:
    """The filter of a column of hashes; the driver gets its non-zero words, FILTER / 64 at most."""
    slot = F.col(column).bitwiseAND(FILTER - 1)
    words = df.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits.tobytes()


def passes(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes pass the filter."""
    slot = (hashes & np.uint64(FILTER - 1)).astype(np.int64)
    return (np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
