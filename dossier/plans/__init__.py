"""Read models, reports, claim plans and matching plans; each module registers its queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The adapter views of dossier.sources, for the SQL side.
VIEWS = """WITH leads AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS municipality_id, c_mktsegment AS classification, c_acctbal AS score,
  CASE WHEN c_acctbal < 0 THEN c_custkey - 1 END AS merged_into_id FROM customer),
active AS (SELECT * FROM leads WHERE merged_into_id IS NULL),
sightings AS (SELECT o_custkey AS lead_id, o_orderpriority AS source_id, o_orderkey AS url_id, o_orderdate AS seen_at FROM orders),
phones AS (SELECT o_custkey AS lead_id, o_orderkey % 97 AS e164, CASE o_orderstatus WHEN 'O' THEN 'mobile' WHEN 'F' THEN 'landline' ELSE 'unknown' END AS type,
  o_orderstatus = 'F' AS valid, o_orderpriority = '1-URGENT' AS is_primary, o_orderpriority AS source_id, o_orderdate AS seen_at, o_orderkey AS claim_id FROM orders),
claims AS (SELECT l_suppkey AS lead_id, l_returnflag AS field, CAST(trunc(l_quantity) AS INT) AS value, l_linenumber AS source_id, l_shipdate AS seen_at,
  l_orderkey AS order_id, l_partkey AS part_id FROM lineitem),
places AS (SELECT n_nationkey AS municipality_id, n_name AS place, n_regionkey AS region_id, n_nationkey % 3 + 1 AS tier, (n_nationkey * 7919) % 25 * 1000 + 5000 AS population FROM nation),
runs AS (SELECT event_id AS run_id, ts AS started_at, user_id AS source_id, event_type AS status, CAST(floor(value) AS BIGINT) AS leads_created FROM events)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else VIEWS + sql
        return f

    return add
