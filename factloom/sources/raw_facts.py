"""Raw facts derived from the star schema. The text is SQL that Spark and DuckDB read alike, so that queries and
their oracles begin with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["nation", "customer", "orders", "supplier"]

RAW_FACTS_SQL = """
WITH rev AS (
  SELECT n_name, n_nationkey AS n, year(o_orderdate) AS y,
         cast(floor(sum(cast(round(o_totalprice * 100) AS bigint)) / 100000000.0) AS bigint) + 2 AS v,
         cast(floor(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN cast(round(o_totalprice * 100) AS bigint) ELSE 0 END) / 100000000.0) AS bigint) + 1 AS v1
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, n_nationkey, year(o_orderdate)
), heads AS (
  SELECT n_name, n_nationkey AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey
), names AS (
  SELECT n_name, n_nationkey AS n, 'Asha K' || translate(cast(n_nationkey AS string), '0123456789', 'abcdefghij') AS p1,
         'Ravi M' || translate(cast(n_nationkey AS string), '0123456789', 'abcdefghij') AS p2 FROM nation
)
SELECT (n * 100 + y - 1990) * 10 + 1 AS ingest_ord, n_name AS entity, 'total_revenue' AS attribute, 'INR ' || cast(v AS string) || ' million' AS value,
       cast(NULL AS string) AS unit, 'FY' || cast(y AS string) AS period, 0.9E0 AS confidence, 'orders_' || cast(y AS string) || '.pdf' AS source_document,
       cast(n % 20 + 1 AS int) AS page_number, n_name || ' reported total revenue of INR ' || cast(v AS string) || ' million in FY' || cast(y AS string) AS evidence_text FROM rev
UNION ALL
SELECT (n * 100 + y - 1990) * 10 + 2, n_name, 'Revenue', 'Approximately ' || cast(v AS string), 'million', 'FY ' || cast(y AS string), 0.8E0,
       'review_' || cast(y AS string) || '.pdf', cast((n + 3) % 20 + 1 AS int), 'Revenue of ' || n_name || ' was approximately ' || cast(v AS string) || ' million' FROM rev
UNION ALL
SELECT (n * 100 + y - 1990) * 10 + 3, n_name, 'consolidated revenue', '₹' || cast(v + cast(floor(v * (n % 5) / 20.0) AS bigint) AS string) || ' million', cast(NULL AS string),
       'FY' || cast(y AS string), 0.6E0, 'restated_' || cast(y AS string) || '.pdf', cast(n % 20 + 1 AS int), 'Restated revenue of ' || n_name || ' for FY' || cast(y AS string) FROM rev
UNION ALL
SELECT (n * 100 + y - 1990) * 10 + 4, n_name, 'product_revenue', 'INR ' || cast(v1 AS string) || ' million', cast(NULL AS string), 'FY' || cast(y AS string), 0.7E0,
       'orders_' || cast(y AS string) || '.pdf', cast(n % 20 + 2 AS int), 'Product revenue of ' || n_name || ' was INR ' || cast(v1 AS string) || ' million' FROM rev
UNION ALL
SELECT (n * 100 + y - 1990) * 10 + 5, n_name, 'services_revenue', 'INR ' || cast(v - v1 AS string) || ' million', cast(NULL AS string), 'FY' || cast(y AS string), 0.7E0,
       'orders_' || cast(y AS string) || '.pdf', cast(n % 20 + 9 * (n % 2) + 1 AS int), 'Services revenue of ' || n_name || ' was INR ' || cast(v - v1 AS string) || ' million' FROM rev
UNION ALL
SELECT (n * 100 + y - 1990) * 10 + 6, n_name, 'Revenue', cast(v AS string) || ' million', cast(NULL AS string), cast(NULL AS string), 0.5E0, 'notes.pdf', cast(y % 20 + 1 AS int),
       'Revenue ' || cast(v AS string) || ' million' FROM rev
UNION ALL
SELECT 1000000 + n * 10 + 1, n_name, 'headcount', 'Approximately ' || cast(k AS string), cast(NULL AS string), 'FY2000', 0.6E0, 'people.pdf', cast(n % 20 + 1 AS int), n_name || ' has approximately ' || cast(k AS string) || ' staff' FROM heads
UNION ALL
SELECT 1000000 + n * 10 + 2, n_name, 'number of employees', cast(k AS string), cast(NULL AS string), 'FY2000', 0.7E0, 'people.pdf', cast(n % 20 + 2 AS int), n_name || ' employs ' || cast(k AS string) || ' people' FROM heads
UNION ALL
SELECT 1100000 + n * 10 + 1, n_name, 'CEO', p1, cast(NULL AS string), cast(NULL AS string), 0.8E0, 'board.pdf', cast(n % 20 + 1 AS int),
       CASE WHEN n % 3 = 0 THEN p1 || ' resigned as CEO of ' || n_name ELSE p1 || ' is CEO of ' || n_name END FROM names
UNION ALL
SELECT 1100000 + n * 10 + 2, n_name, 'chief executive', p2, cast(NULL AS string), cast(NULL AS string), 0.7E0, 'board.pdf', cast(n % 20 + 2 AS int), p2 || ' leads ' || n_name FROM names
UNION ALL
SELECT 1200000 + n * 10 + 1, n_name, 'operating_margin', cast(10 + n % 7 AS string) || '%', cast(NULL AS string), cast(NULL AS string), 0.8E0, 'orders_1998.pdf', cast(n % 20 + 1 AS int), 'Operating margin of ' || n_name FROM names
UNION ALL
SELECT 1200000 + n * 10 + 2, n_name, 'operating margin', cast(12 + n % 9 AS string) || '%', cast(NULL AS string), cast(NULL AS string), 0.6E0, 'orders_1999.pdf', cast(n % 20 + 1 AS int), 'Margin of ' || n_name FROM names
UNION ALL
SELECT 2000000 + c_custkey * 2, c_name, 'account balance', 'USD ' || cast(cast(floor(abs(c_acctbal)) AS bigint) AS string), cast(NULL AS string), cast(NULL AS string), 0.5E0 + (c_custkey % 5) / 10.0E0,
       'ledger_' || cast(c_nationkey AS string) || '.pdf', cast(c_custkey % 20 + 1 AS int), 'Balance of ' || c_name FROM customer
UNION ALL
SELECT 2000001 + c_custkey * 2, c_name, 'account_balance', CASE WHEN c_custkey % 2 = 0 THEN '$' || cast(cast(floor(abs(c_acctbal)) AS bigint) AS string) ELSE cast(cast(floor(abs(c_acctbal)) AS bigint) + 7 AS string) || ' usd' END,
       cast(NULL AS string), cast(NULL AS string), 0.6E0, 'audit_' || cast(c_nationkey AS string) || '.pdf', cast(c_custkey % 20 + 1 AS int), 'Audited balance of ' || c_name FROM customer
"""


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ingest_ord, entity, attribute, value, unit, period, confidence and one piece of evidence per row."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    sql = RAW_FACTS_SQL
    for t in TABLES:  # names of the views are the call's own, so that calls on other folders don't meet
        frames[t].createOrReplaceTempView(f"raw_{t}")
        for before in ("FROM ", "JOIN "):
            sql = sql.replace(f"{before}{t} ", f"{before}raw_{t} ").replace(f"{before}{t}\n", f"{before}raw_{t}\n")
    return spark.sql(sql)
