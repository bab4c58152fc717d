"""Pages of a long list."""

import duckdb

from dossier import catalog
from dossier.plans import leads
from tests.test_catalog import _rows

N = 500_020


def test_last_page_beyond_page_9999(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT i AS c_custkey, 'n' || i AS c_name, i % 25 AS c_nationkey, 'BUILDING' AS c_mktsegment, CAST(i * 7919 % 1000 AS DOUBLE) AS c_acctbal FROM range({N}) t(i)) TO '{tmp_path}/customer.parquet'")
    con.sql(f"COPY (SELECT i AS o_orderkey, i AS o_custkey, 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority, DATE '2020-01-01' AS o_orderdate FROM range({N}) t(i) WHERE i % 1000 = 0) TO '{tmp_path}/orders.parquet'")
    for table in ("customer", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    con.sql("CREATE VIEW lineitem AS SELECT 1 AS l_suppkey, 'A' AS l_returnflag, 1.0 AS l_quantity, 1 AS l_linenumber, DATE '2020-01-01' AS l_shipdate, 1 AS l_orderkey, 1 AS l_partkey")
    con.sql("CREATE VIEW nation AS SELECT 1 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey")
    con.sql("CREATE VIEW events AS SELECT 1 AS event_id, DATE '2020-01-01' AS ts, 1 AS user_id, 'view' AS event_type, 1.0 AS value")
    found, said = catalog.queries()["list_leads_last_page"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["list_leads_last_page"])
    rows = found.collect()
    assert len(rows) == N % 50
    assert _rows([tuple(r) for r in rows], found.columns) == _rows(said.fetchall(), said.columns)
    assert rows == sorted(rows, key=lambda r: (-r["score"], r["id"]))
    ascending = leads.page(spark, str(tmp_path), leads.LeadQuery(descending=False, page=20_000)).collect()
    assert len(ascending) == N % 50 and ascending == sorted(ascending, key=lambda r: (r["score"], r["id"])) and ascending[-1]["score"] == 999
