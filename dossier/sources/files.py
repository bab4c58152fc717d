"""Files as input: several of them as one table, checks of their columns and rows, results kept by the query that made them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SchemaChanged(ValueError):
    """A source lacks columns that it had, or has them with another type."""


def parquet(spark: SparkSession, paths: Sequence[str], required: str | StructType) -> DataFrame:
    """The files as one table with the required columns; raises SchemaChanged before any row is read where one is missing or of another type."""
    if not paths:
        raise ValueError("no files to read")
    found = spark.read.parquet(*paths)
    check(found, required)
    return found.select(*[f"`{f}`" for f in _schema(required).fieldNames()])


def check(found: DataFrame, required: str | StructType) -> None:
    """Raises SchemaChanged with every column that found lacks or has with another type. More columns are no change."""
    have = {f.name: f.dataType.simpleString() for f in found.schema}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')} instead of {f.dataType.simpleString()}" for f in _schema(required) if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise SchemaChanged("; ".join(wrong))


def _schema(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str | StructType, strict: bool = True) -> DataFrame:
    """One row for each line. strict: a line that isn't of the schema fails the run; else it is a row of nulls with the line in `rejected`."""
    reader = spark.read
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(paths if isinstance(paths, str) else list(paths))
    wide = StructType([*_schema(schema), *StructType.fromDDL("rejected string")])
    return reader.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "rejected").json(paths if isinstance(paths, str) else list(paths))


def as_json(found: DataFrame) -> Column:
    """Each row as a JSON text with all its fields, nulls included; keys that don't fit a double stay whole numbers."""
    return F.to_json(F.struct(*[f"`{c}`" for c in found.columns]), {"ignoreNullFields": "false"})


def rows_or_fail(found: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """found, whose reading fails at the first row that breaks a rule (name: a condition that must hold), with the rule's name. Null breaks it."""
    broken = F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()])
    return found.where(F.when(broken.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("row breaks the rule "), broken)).cast("boolean")))


def kept_result(spark: SparkSession, folder: str, parts: Iterable[str], make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, written once below folder under a hash of parts (the query, its release) and read from there afterwards.

    A write that did not end leaves no _SUCCESS and is written anew.
    """
    target = f"{folder}/q={hashlib.sha256(chr(0).join(parts).encode()).hexdigest()[:16]}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
