"""Inputs derived from the given tables, as SQL that Spark and DuckDB both run.

Every definition covers its whole source tables. Fixtures stand for what a
metadata catalog would hold: raw tables, lineage edges, assets with owners,
model texts, usage and schema snapshots.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

PHYSICAL = "'urn:li:dataset:(urn:li:dataPlatform:postgres,warehouse.public.' || {n} || ',PROD)'"
LOGICAL = "'urn:li:dataset:(urn:li:dataPlatform:dbt,warehouse.public.' || {n} || ',PROD)'"
DASHBOARD = "'urn:li:dashboard:(bi,' || {n} || ')'"


def _key(kind: str, column: str) -> str:
    return f"'{kind}_' || CAST({column} AS STRING)"


# Customers with a profile of their own, whose model reads one column and may filter by it.
_PROFILED = "c_mktsegment = 'BUILDING' AND c_acctbal > 9000"

FIXTURES: dict[str, str] = {}

# --- warehouse -----------------------------------------------------------------

FIXTURES["fx_raw_customers"] = """
SELECT c_custkey AS cust_id,
       split_part(c_name, '#', 1) AS first_name,
       split_part(c_name, '#', 2) AS last_name,
       CASE WHEN c_mktsegment <> 'MACHINERY'
            THEN lower(c_mktsegment) || '.' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
       CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2023-01-01 00:00:00'
            ELSE TIMESTAMP '2024-06-01 12:30:00' END AS created_at
FROM customer
"""

FIXTURES["fx_raw_orders"] = """
SELECT o_orderkey AS order_id,
       o_custkey AS cust_id,
       o_orderdate AS order_date,
       CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'refunded'
            WHEN o_orderstatus = 'F' THEN 'completed'
            WHEN o_orderstatus = 'O' THEN 'pending'
            ELSE 'cancelled' END AS status,
       CAST(o_totalprice AS DECIMAL(10, 2)) AS amount
FROM orders
"""

FIXTURES["fx_raw_payments"] = """
SELECT row_number() OVER (ORDER BY order_id) AS payment_id,
       order_id,
       CASE WHEN amount < 100000 THEN 'gift_card' WHEN amount < 200000 THEN 'paypal'
            WHEN amount < 350000 THEN 'credit_card' ELSE 'bank_transfer' END AS payment_method,
       amount,
       order_date AS payment_date
FROM fx_raw_orders
WHERE status <> 'cancelled'
"""

FIXTURES["fx_fct_orders"] = """
SELECT order_id, cust_id AS customer_key, order_date, status, amount FROM fx_raw_orders
"""

FIXTURES["fx_dim_customers"] = """
SELECT cust_id AS customer_key, first_name, last_name, email, created_at FROM fx_raw_customers
"""

FIXTURES["fx_fct_revenue"] = """
SELECT o.order_id, o.order_date, o.status, o.amount,
       c.customer_key, c.first_name, c.last_name, c.email, c.created_at
FROM fx_fct_orders o JOIN fx_dim_customers c ON o.customer_key = c.customer_key
WHERE o.status <> 'cancelled'
"""

# A rebuilt orders mart that lost some rows, gained some and changed some.
FIXTURES["fx_candidate_orders"] = """
SELECT order_id, customer_key, order_date, status,
       CAST(CASE WHEN status = 'pending' AND amount > 400000 THEN amount + 1 ELSE amount END
            AS DECIMAL(10, 2)) AS amount
FROM fx_fct_orders
WHERE NOT (status = 'cancelled' AND amount < 20000)
UNION ALL
SELECT -order_id - 1 AS order_id, customer_key, order_date, status, amount
FROM fx_fct_orders
WHERE status = 'refunded' AND amount < 20000
"""

# --- lineage -------------------------------------------------------------------

FIXTURES["fx_first_supplier"] = """
SELECT l_orderkey AS orderkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY l_orderkey
"""

FIXTURES["fx_first_order"] = """
SELECT o_custkey AS custkey, min(o_orderkey) AS orderkey FROM orders GROUP BY o_custkey
"""

FIXTURES["fx_first_customer"] = """
SELECT c_nationkey AS nationkey, min(c_custkey) AS custkey FROM customer GROUP BY c_nationkey
"""

# One load job per order: its inlets are the suppliers of the order's lines.
FIXTURES["fx_job_inlets"] = f"""
SELECT DISTINCT {_key("load", "l_orderkey")} AS job_id, {_key("supplier", "l_suppkey")} AS node
FROM lineitem
"""

FIXTURES["fx_job_outlets"] = f"""
SELECT DISTINCT {_key("load", "l_orderkey")} AS job_id, {_key("order", "l_orderkey")} AS node
FROM lineitem
"""

# Reports and their digests stand below the nations; archives are known to lineage alone.
FIXTURES["fx_edges"] = f"""
SELECT {_key("supplier", "l.suppkey")} AS src, {_key("order", "l.orderkey")} AS dst,
       CASE WHEN l.suppkey = f.suppkey THEN 'model' ELSE 'job' END AS kind
FROM (SELECT DISTINCT l_suppkey AS suppkey, l_orderkey AS orderkey FROM lineitem) l
JOIN fx_first_supplier f ON l.orderkey = f.orderkey
UNION ALL
SELECT {_key("order", "o_orderkey")}, {_key("customer", "o_custkey")}, 'model' FROM orders
UNION ALL
SELECT {_key("customer", "c_custkey")}, {_key("nation", "c_nationkey")}, 'model' FROM customer
UNION ALL
SELECT {_key("nation", "n_nationkey")}, {_key("region", "n_regionkey")}, 'model' FROM nation
UNION ALL
SELECT {_key("nation", "n_nationkey")}, {_key("report", "n_nationkey")}, 'model' FROM nation WHERE n_regionkey <> 0
UNION ALL
SELECT {_key("report", "n_nationkey")}, {_key("digest", "n_nationkey")}, 'model' FROM nation WHERE n_regionkey <> 0
UNION ALL
SELECT {_key("report", "n_nationkey")}, {_key("board", "n_regionkey")}, 'model' FROM nation WHERE n_regionkey IN (1, 2)
UNION ALL
SELECT {_key("report", "n_nationkey")}, {_key("archive", "n_nationkey")}, 'model' FROM nation WHERE n_regionkey = 3
UNION ALL
SELECT {_key("customer", "c_custkey")}, {_key("profile", "c_custkey")}, 'model' FROM customer WHERE {_PROFILED}
"""

# Columns a, n and r (the return flags) travel supplier -> order -> customer and,
# renamed, on to the nations of two customer segments.
FIXTURES["fx_column_edges"] = f"""
SELECT {_key("supplier", "suppkey")} AS src, flag AS src_col, {_key("order", "orderkey")} AS dst, flag AS dst_col
FROM (SELECT DISTINCT l_suppkey AS suppkey, l_orderkey AS orderkey, lower(l_returnflag) AS flag FROM lineitem) l
UNION ALL
SELECT {_key("order", "orderkey")}, flag, {_key("customer", "o_custkey")}, flag
FROM (SELECT DISTINCT l_orderkey AS orderkey, lower(l_returnflag) AS flag FROM lineitem) l
JOIN orders ON orderkey = o_orderkey
WHERE o_orderstatus <> 'P'
UNION ALL
SELECT {_key("customer", "c_custkey")}, 'a', {_key("nation", "c_nationkey")}, 'total_a'
FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
UNION ALL
SELECT {_key("customer", "c_custkey")}, 'n', {_key("nation", "c_nationkey")}, 'total_n'
FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
UNION ALL
SELECT {_key("customer", "c_custkey")}, 'r', {_key("nation", "c_nationkey")}, 'total_r'
FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
UNION ALL
SELECT {_key("customer", "c_custkey")}, 'r', {_key("profile", "c_custkey")}, 'r' FROM customer WHERE {_PROFILED}
"""

# Every supplier and every customer table announces one change, and so do large urgent orders.
FIXTURES["fx_changes"] = f"""
SELECT 'chg_' || {_key("supplier", "s_suppkey")} AS change_id,
       {_key("supplier", "s_suppkey")} AS node,
       CASE WHEN s_acctbal < 3000 THEN 'a' WHEN s_acctbal < 6000 THEN 'n' ELSE 'r' END AS column_name,
       'new_' || CAST(s_nationkey AS STRING) AS new_column,
       CASE n_regionkey WHEN 0 THEN 'rename' WHEN 1 THEN 'drop_column' WHEN 2 THEN 'add_column'
            WHEN 3 THEN 'widen_type' ELSE 'possible_rename' END AS change_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT 'chg_' || {_key("customer", "c_custkey")},
       {_key("customer", "c_custkey")},
       CASE WHEN c_acctbal < 3000 THEN 'a' WHEN c_acctbal < 6000 THEN 'n' ELSE 'r' END,
       'new_' || CAST(c_nationkey AS STRING),
       CASE n_regionkey WHEN 0 THEN 'rename' WHEN 1 THEN 'drop_column' WHEN 2 THEN 'add_column'
            WHEN 3 THEN 'widen_type' ELSE 'possible_rename' END
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 'chg_' || {_key("order", "o_orderkey")}, {_key("order", "o_orderkey")},
       CASE WHEN o_totalprice < 440000 THEN 'a' WHEN o_totalprice < 480000 THEN 'n' ELSE 'r' END,
       'new_' || CAST(o_custkey AS STRING),
       CASE o_orderstatus WHEN 'F' THEN 'rename' WHEN 'O' THEN 'possible_rename' ELSE 'drop_column' END
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000
"""

# --- assets and their models ---------------------------------------------------


def _null() -> str:
    return "CAST(NULL AS STRING)"


FIXTURES["fx_assets"] = f"""
SELECT {_key("supplier", "s_suppkey")} AS node, 'raw' AS layer, 'DATASET' AS type,
       {PHYSICAL.format(n=_key("supplier", "s_suppkey"))} AS physical_urn,
       {_null()} AS logical_urn, {_null()} AS file_path,
       'urn:li:corpuser:sourcing' AS technical_owner, {_null()} AS business_owner
FROM supplier
UNION ALL
SELECT {_key("order", "o_orderkey")}, 'staging', 'DATASET',
       {PHYSICAL.format(n=_key("order", "o_orderkey"))},
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN {LOGICAL.format(n=_key("order", "o_orderkey"))} END,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
            THEN 'models/orders/' || {_key("order", "o_orderkey")} || '.sql' END,
       'urn:li:corpuser:orders_' || lower(substr(o_orderpriority, 3, 3)), {_null()}
FROM orders
UNION ALL
SELECT {_key("customer", "c_custkey")}, 'marts', 'DATASET',
       {PHYSICAL.format(n=_key("customer", "c_custkey"))},
       {LOGICAL.format(n=_key("customer", "c_custkey"))},
       'models/customers/' || {_key("customer", "c_custkey")} || '.sql',
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
            THEN 'urn:li:corpuser:crm_' || CAST(c_nationkey AS STRING) END,
       CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD')
            THEN 'urn:li:corpuser:sales_' || CAST(c_nationkey AS STRING) END
FROM customer
UNION ALL
SELECT {_key("nation", "n_nationkey")}, 'marts',
       CASE WHEN n_regionkey = 0 THEN 'DASHBOARD' ELSE 'DATASET' END,
       CASE WHEN n_regionkey = 0 THEN {DASHBOARD.format(n=_key("nation", "n_nationkey"))}
            WHEN n_regionkey <> 3 THEN {PHYSICAL.format(n=_key("nation", "n_nationkey"))} END,
       CASE WHEN n_regionkey <> 0 THEN {LOGICAL.format(n=_key("nation", "n_nationkey"))} END,
       CASE WHEN n_regionkey <> 0 THEN 'models/nations/' || {_key("nation", "n_nationkey")} || '.sql' END,
       {_null()}, 'urn:li:corpuser:finance'
FROM nation
UNION ALL
SELECT {_key("region", "r_regionkey")}, 'marts', 'DATASET',
       {PHYSICAL.format(n=_key("region", "r_regionkey"))}, {_null()}, {_null()}, {_null()}, {_null()}
FROM region
UNION ALL
SELECT {_key("report", "n_nationkey")}, 'marts', 'DATASET', {PHYSICAL.format(n=_key("report", "n_nationkey"))},
       {LOGICAL.format(n=_key("report", "n_nationkey"))}, 'models/reports/' || {_key("report", "n_nationkey")} || '.sql',
       {_null()}, 'urn:li:corpuser:finance'
FROM nation WHERE n_regionkey <> 0
UNION ALL
SELECT {_key("digest", "n_nationkey")}, 'marts', 'DATASET', {PHYSICAL.format(n=_key("digest", "n_nationkey"))},
       {LOGICAL.format(n=_key("digest", "n_nationkey"))}, 'models/reports/' || {_key("digest", "n_nationkey")} || '.sql',
       'urn:li:corpuser:reporting', {_null()}
FROM nation WHERE n_regionkey <> 0
UNION ALL
SELECT {_key("profile", "c_custkey")}, 'marts', 'DATASET', {PHYSICAL.format(n=_key("profile", "c_custkey"))},
       {LOGICAL.format(n=_key("profile", "c_custkey"))}, 'models/profiles/' || {_key("profile", "c_custkey")} || '.sql',
       'urn:li:corpuser:crm', {_null()}
FROM customer WHERE {_PROFILED}
UNION ALL
SELECT {_key("board", "r_regionkey")}, 'marts', 'DASHBOARD', {DASHBOARD.format(n=_key("board", "r_regionkey"))},
       {_null()}, {_null()}, {_null()}, 'urn:li:corpuser:finance'
FROM region WHERE r_regionkey IN (1, 2)
"""

# Source text of each asset's model; a nation in region 4 lost its compiled form.
FIXTURES["fx_asset_models"] = f"""
SELECT 'models/orders/' || {_key("order", "o_orderkey")} || '.sql' AS path,
       '-- keeps a, n and r of its first supplier' || chr(10) || 'select' || chr(10)
       || '    s.order_id,' || chr(10)
       || CASE WHEN o_orderpriority = '5-LOW' THEN '    s.*,' || chr(10) ELSE '' END
       || '    s.a,' || chr(10) || '    s.N,' || chr(10) || '    s.r' || chr(10)
       || 'from {{{{ source(''public'', ''' || {_key("supplier", "f.suppkey")} || ''') }}}} as s' || chr(10) AS source_text,
       true AS is_compiled
FROM orders JOIN fx_first_supplier f ON o_orderkey = f.orderkey
WHERE o_orderpriority <> '4-NOT SPECIFIED'
UNION ALL
SELECT 'models/customers/' || {_key("customer", "c_custkey")} || '.sql',
       'select' || chr(10)
       || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '    o.*' ELSE '    o.a,' || chr(10) || '    count(*) as n_rows' END
       || chr(10) || 'from {{{{ ref(''order_' || coalesce(CAST(f.orderkey AS STRING), 'none') || ''') }}}} as o' || chr(10),
       true
FROM customer LEFT JOIN fx_first_order f ON c_custkey = f.custkey
UNION ALL
SELECT 'models/nations/' || {_key("nation", "n_nationkey")} || '.sql',
       CASE WHEN n_regionkey IN (1, 2) THEN 'select *' ELSE 'select' || chr(10) || '    a,' || chr(10) || '    total_a' END
       || chr(10) || 'from {{{{ ref(''customer_' || coalesce(CAST(f.custkey AS STRING), 'none') || ''') }}}}' || chr(10),
       n_regionkey <> 4
FROM nation LEFT JOIN fx_first_customer f ON n_nationkey = f.nationkey
WHERE n_regionkey <> 0
UNION ALL
SELECT 'models/reports/' || {_key("report", "n_nationkey")} || '.sql',
       'select *' || chr(10) || 'from {{{{ ref(''' || {_key("nation", "n_nationkey")} || ''') }}}}' || chr(10), true
FROM nation WHERE n_regionkey <> 0
UNION ALL
SELECT 'models/reports/' || {_key("digest", "n_nationkey")} || '.sql',
       'select' || chr(10) || '    r.*' || chr(10) || 'from {{{{ ref(''' || {_key("report", "n_nationkey")} || ''') }}}} as r' || chr(10), true
FROM nation WHERE n_regionkey <> 0
UNION ALL
SELECT 'models/profiles/' || {_key("profile", "c_custkey")} || '.sql',
       'select' || chr(10) || '    c.r' || chr(10) || 'from {{{{ ref(''' || {_key("customer", "c_custkey")} || ''') }}}} as c' || chr(10)
       || CASE WHEN c_nationkey < 12 THEN 'where c.r is not null' || chr(10) ELSE '' END, true
FROM customer WHERE {_PROFILED}
""".replace("{{{{", "{{").replace("}}}}", "}}")

# One model text per part; size, type and brand decide what the text contains.
FIXTURES["fx_corpus"] = f"""
SELECT {_key("part", "p_partkey")} AS model,
       'models/parts/' || {_key("part", "p_partkey")} || '.sql' AS path,
       CASE WHEN p_brand = 'Brand#7' THEN '{{{{ config(materialized=''table'') }}}}' || chr(10) ELSE '' END
       || '-- cust_id of ' || p_name || chr(10)
       || CASE WHEN p_brand = 'Brand#9' THEN '/* joins raw.from_notes' || chr(10) || 'p.* */' || chr(10) ELSE '' END
       || CASE WHEN p_brand = 'Brand#8' THEN 'with q(a) as (select x.part_id from {{{{ ref(''part_' || CAST(p_partkey + p_size AS STRING)
            || ''') }}}} as x where x.part_id is distinct from 0)' || chr(10) ELSE '' END
       || CASE WHEN p_size = 50 THEN 'select *' ELSE 'select' || chr(10) || '    p.part_id,'
          || CASE WHEN p_size <= 10 THEN chr(10) || '    p.*,' WHEN p_size <= 20 THEN chr(10) || '    count(*) as n_rows,' ELSE '' END
          || CASE WHEN p_brand = 'Brand#5' THEN chr(10) || '    s.part_id as other, *,' ELSE '' END
          || CASE WHEN p_brand = 'Brand#6' THEN chr(10) || '    extract(year from p.part_date) * 2 as part_year,' ELSE '' END
          || CASE WHEN p_size = 33 THEN chr(10) || '    coalesce(p.part_name, 0,' ELSE '' END END
       || chr(10)
       || CASE p_type WHEN 'ECONOMY' THEN '    cust_id,' || chr(10)
                      WHEN 'LARGE' THEN '    p.cust_id,' || chr(10)
                      WHEN 'MEDIUM' THEN '    cust_id as customer_key,' || chr(10)
                      WHEN 'STANDARD' THEN '    CUST_ID,' || chr(10) ELSE '' END
       || CASE WHEN p_size = 50 THEN '' ELSE '    p.part_name' || chr(10) END
       || 'from {{{{ source(''raw'', ''raw_parts_' || CAST(p_size AS STRING) || ''') }}}} as p'
       || CASE WHEN p_brand = 'Brand#8' THEN ' cross join q' WHEN p_brand = 'Brand#4' THEN ',' ELSE '' END || chr(10)
       || CASE WHEN p_brand = 'Brand#4' THEN '    ' ELSE 'inner join ' END
       || '{{{{ ref(''part_' || CAST(p_partkey + p_size AS STRING) || ''') }}}} as s' || chr(10)
       || CASE WHEN p_brand = 'Brand#4' THEN 'where' ELSE '    on' END
       || CASE WHEN p_type = 'PROMO' THEN ' p.cust_id = s.cust_id' ELSE ' p.part_id = s.part_id' END
       || chr(10) AS source_text
FROM part
""".replace("{{{{", "{{").replace("}}}}", "}}")

FIXTURES["fx_declared_sources"] = """
SELECT DISTINCT 'raw' AS source_name, 'raw_parts_' || CAST(p_size AS STRING) AS table_name
FROM part WHERE p_brand <> 'Brand#3' AND p_size < 49
"""

# --- usage ---------------------------------------------------------------------

FIXTURES["fx_usage_log"] = f"""
SELECT event_id AS query_id, {_key("customer", "user_id")} AS node, event_type AS actor, ts
FROM events
"""

FIXTURES["fx_statements"] = "SELECT doc_id AS statement_id, text AS statement FROM documents"

# Ordered names looked for in the statements, in the order in which they win.
FIXTURES["fx_known_tables"] = """
SELECT * FROM (VALUES (1, 'thor'), (2, 'eaux'), (3, 'ring'), (4, 'ation'), (5, 'email'),
                      (6, 'licen'), (7, 'der'), (8, 'que'), (9, 'the')) AS t(priority, table_name)
"""

# --- schema snapshots ----------------------------------------------------------

FIXTURES["fx_snapshot_fields"] = f"""
SELECT 'postgres' AS platform,
       CASE WHEN user_id < 40 THEN 'staging' ELSE 'public' END AS schema_name,
       {_key("user", "user_id")} AS table_name,
       CAST(CAST(ts AS DATE) AS TIMESTAMP) AS captured_at,
       event_type AS name,
       CASE WHEN max(value) > 20 THEN 'numeric(10,2)' ELSE 'integer' END AS type
FROM events
GROUP BY user_id, CAST(ts AS DATE), event_type
"""

# --- traces --------------------------------------------------------------------

FIXTURES["fx_calls"] = """
SELECT 'run_' || CAST(user_id AS STRING) AS run_id, event_id AS call_number, event_type AS tool, props,
       'value ' || CAST(event_id AS STRING) AS rationale,
       regexp_extract(props, '([0-9]+)', 1) || ' ' || event_type || 's' AS result_summary
FROM events
"""

# A turn of a conversation plays an attempt: two checks on its text.
FIXTURES["fx_attempt_checks"] = """
SELECT conv_id AS run_id, turn + 1 AS attempt_number, text AS candidate_content,
       length(text) < 400 AS static_ok, role = 'assistant' AS compile_ok
FROM conversations
"""

_NAMES = re.compile(r"\bfx_[a-z_]+\b")


def needed(sql: str) -> list[str]:
    """The fixtures ``sql`` mentions, each after the ones it is built from."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAMES.findall(text):
            if name in FIXTURES and name not in order:
                visit(FIXTURES[name])
                order.append(name)

    visit(sql)
    return order


def with_fixtures(body: str, ctes: dict[str, str] | None = None) -> str:
    """``body`` as one statement, with the fixtures and CTEs it needs in front."""
    ctes = ctes or {}
    parts = [f"{name} AS ({FIXTURES[name]})" for name in needed(body + " ".join(ctes.values()))]
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Inputs:
    """The given tables and the fixtures over them as DataFrames of one session."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self._dir = sf_dir
        self._registered: set[str] = set()

    def _register(self, sql: str) -> str:
        for table in TABLES:
            if table not in self._registered and re.search(rf"\b{table}\b", sql):
                self.spark.read.parquet(f"{self._dir}/{table}.parquet").createOrReplaceTempView(table)
                self._registered.add(table)
        return sql

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.sql(self._register(f"SELECT * FROM {name}"))
        if f"fx_{name}" not in FIXTURES:
            raise AttributeError(name)
        return self.spark.sql(self._register(with_fixtures(f"SELECT * FROM fx_{name}")))
