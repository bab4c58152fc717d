"""Registry of the queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier import plans
from dossier.plans import claims, extraction, grading, intake, leads, listing, matching, naming, phone_numbers, reports, resolution, upkeep, yields  # noqa: F401  each registers its queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.list_leads_page(spark, sf_dir)


def queries() -> dict[str, plans.Query]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
