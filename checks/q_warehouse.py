"""Warehouse models, workload, data tests, digests and parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixtures import Inputs
from checks.registry import query
from faultline.operators import quality, warehouse, workload
from faultline.plans.warehouse import run_models, shadow_parity
from faultline.session import run_path
from faultline.sources import files, schemas

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
ORDER_DATE, CREATED = TS.format(c="order_date"), TS.format(c="created_at")
AMOUNT = "CAST(amount AS DOUBLE) AS amount"


def payment_method():
    return (
        F.when(F.col("amount") < 100000, "gift_card").when(F.col("amount") < 200000, "paypal")
        .when(F.col("amount") < 350000, "credit_card").otherwise("bank_transfer")
    )


def payments(i: Inputs) -> DataFrame:
    return warehouse.derive_payments(i.raw_orders, payment_method())


def revenue(i: Inputs) -> DataFrame:
    return run_models(i.raw_customers, i.raw_orders)["fct_revenue"]


def orders(i: Inputs) -> DataFrame:
    return warehouse.fct_orders(warehouse.stg_orders(i.raw_orders))


# --- sources -------------------------------------------------------------------


@query("load_table_full_refresh", "SELECT 'raw_orders' AS table_name, count(*) AS n_rows, "
       "CAST(sum(amount) AS DOUBLE) AS total FROM fx_raw_orders")
def load_table_full_refresh(i):
    csv, table = run_path(i.spark, "csv"), run_path(i.spark, "raw_orders")
    i.raw_orders.write.option("header", True).csv(csv)
    schema = schemas.RAW_TABLES["raw_orders"]
    files.full_refresh(i.spark, csv, table, schema)
    loaded = i.spark.read.schema(schema).parquet(table)
    return loaded.agg(F.lit("raw_orders").alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                      F.sum("amount").alias("total"))


# --- models --------------------------------------------------------------------


@query("stg_customers", f"SELECT cust_id, first_name, last_name, email, {CREATED} FROM fx_raw_customers")
def stg_customers(i):
    return warehouse.stg_customers(i.raw_customers)


@query("stg_orders", f"SELECT order_id, cust_id, {ORDER_DATE}, status, {AMOUNT} FROM fx_raw_orders")
def stg_orders(i):
    return warehouse.stg_orders(i.raw_orders)


PAYMENT_COLUMNS = f"payment_id, order_id, payment_method, {AMOUNT}, {TS.format(c='payment_date')}"


@query("stg_payments", f"SELECT {PAYMENT_COLUMNS} FROM fx_raw_payments")
def stg_payments(i):
    return warehouse.stg_payments(payments(i))


@query("payments_derive", f"SELECT {PAYMENT_COLUMNS} FROM fx_raw_payments")
def payments_derive(i):
    return payments(i)


@query("dim_customers", f"SELECT customer_key, first_name, last_name, email, {CREATED} FROM fx_dim_customers")
def dim_customers(i):
    return warehouse.dim_customers(warehouse.stg_customers(i.raw_customers))


@query("fct_orders", f"SELECT order_id, customer_key, {ORDER_DATE}, status, {AMOUNT} FROM fx_fct_orders")
def fct_orders(i):
    return orders(i)


@query("fct_revenue", f"SELECT order_id, {ORDER_DATE}, status, {AMOUNT}, customer_key, first_name, last_name, "
       f"email, {CREATED} FROM fx_fct_revenue")
def fct_revenue(i):
    return revenue(i)


# --- workload ------------------------------------------------------------------


@query("wq_topk_revenue", f"SELECT customer_key, {AMOUNT} FROM fx_fct_revenue r "
       "ORDER BY r.amount DESC, order_id LIMIT 10")
def wq_topk_revenue(i):
    return workload.topk_revenue(revenue(i))


@query("wq_having", "SELECT customer_key, count(*) AS n_orders FROM fx_fct_revenue GROUP BY 1 HAVING count(*) > 5")
def wq_having(i):
    return workload.frequent_customers(revenue(i))


@query("wq_completed", f"SELECT order_id, customer_key, {ORDER_DATE}, status, {AMOUNT} FROM fx_fct_orders "
       "WHERE status = 'completed'")
def wq_completed(i):
    return workload.completed_orders(orders(i))


@query("wq_sum_by_customer", "SELECT customer_key, CAST(sum(amount) AS DOUBLE) AS total_amount "
       "FROM fx_fct_revenue GROUP BY 1")
def wq_sum_by_customer(i):
    return workload.revenue_by_customer(revenue(i))


@query("wq_recent_orders", f"SELECT order_id, {AMOUNT} FROM fx_fct_orders WHERE order_date > "
       "(SELECT max(order_date) FROM fx_fct_orders) - INTERVAL 30 DAY")
def wq_recent_orders(i):
    return workload.recent_orders(orders(i))


@query("wq_cancelled_count", "SELECT count(*) AS n_orders FROM fx_fct_orders WHERE status = 'cancelled'")
def wq_cancelled_count(i):
    return workload.cancelled_count(orders(i))


@query("wq_dim_projection", "SELECT customer_key, first_name, last_name FROM fx_dim_customers")
def wq_dim_projection(i):
    return workload.customer_names(dim_customers(i))


@query("wq_avg_amount", "SELECT round(CAST(sum(amount) AS DOUBLE) / count(*), 4) AS avg_amount FROM fx_fct_revenue")
def wq_avg_amount(i):
    return workload.average_amount(revenue(i)).select(F.round(F.col("avg_amount").cast("double"), 4).alias("avg_amount"))


@query("wq_min_order_customer", "SELECT customer_key FROM fx_fct_revenue "
       "WHERE order_id = (SELECT min(order_id) FROM fx_fct_revenue)")
def wq_min_order_customer(i):
    return workload.first_order_customer(revenue(i))


@query("wq_amount_gt_400", f"SELECT order_id, customer_key, {AMOUNT} FROM fx_fct_orders WHERE amount > 400")
def wq_amount_gt_400(i):
    return workload.large_orders(orders(i))


@query("wq_above_average", f"SELECT customer_key, {AMOUNT} FROM fx_fct_revenue WHERE amount > "
       "(SELECT CAST(sum(amount) AS DOUBLE) / count(*) FROM fx_fct_revenue)")
def wq_above_average(i):
    return workload.above_average(revenue(i))


@query("wq_status_counts", "SELECT status, count(*) AS n_rows FROM fx_fct_orders GROUP BY 1")
def wq_status_counts(i):
    return workload.count_by(orders(i), "status")


@query("wq_email_not_null", "SELECT cust_id, email FROM fx_raw_customers WHERE email IS NOT NULL")
def wq_email_not_null(i):
    return workload.customers_with_email(i.raw_customers)


@query("wq_stg_customer_count", "SELECT count(*) AS n_customers FROM fx_raw_customers")
def wq_stg_customer_count(i):
    return workload.customer_count(stg_customers(i))


@query("wq_named_customers", "SELECT cust_id, first_name, last_name FROM fx_raw_customers WHERE first_name IS NOT NULL")
def wq_named_customers(i):
    return workload.named_customers(stg_customers(i))


@query("wq_raw_pending", "SELECT order_id, status FROM fx_raw_orders WHERE status = 'pending'")
def wq_raw_pending(i):
    return workload.pending_orders(i.raw_orders)


@query("wq_stg_pending", "SELECT order_id, status FROM fx_raw_orders WHERE status = 'pending'")
def wq_stg_pending(i):
    return workload.pending_orders(stg_orders(i))


@query("wq_positive_payments", f"SELECT payment_method, {AMOUNT} FROM fx_raw_payments WHERE amount > 0")
def wq_positive_payments(i):
    return workload.positive_payments(payments(i))


@query("wq_payment_methods", "SELECT payment_method, count(*) AS n_rows FROM fx_raw_payments GROUP BY 1")
def wq_payment_methods(i):
    return workload.count_by(stg_payments(i), "payment_method")


# --- data tests ----------------------------------------------------------------


@query("dq_not_null", """
SELECT 'stg_customers' AS table_name, 'cust_id' AS column_name, count(*) FILTER (cust_id IS NULL) AS failures FROM fx_raw_customers
UNION ALL SELECT 'stg_customers', 'email', count(*) FILTER (email IS NULL) FROM fx_raw_customers
UNION ALL SELECT 'stg_orders', 'order_id', count(*) FILTER (order_id IS NULL) FROM fx_raw_orders
UNION ALL SELECT 'stg_orders', 'cust_id', count(*) FILTER (cust_id IS NULL) FROM fx_raw_orders
UNION ALL SELECT 'stg_payments', 'payment_id', count(*) FILTER (payment_id IS NULL) FROM fx_raw_payments
UNION ALL SELECT 'stg_payments', 'order_id', count(*) FILTER (order_id IS NULL) FROM fx_raw_payments
UNION ALL SELECT 'dim_customers', 'customer_key', count(*) FILTER (customer_key IS NULL) FROM fx_dim_customers
UNION ALL SELECT 'fct_orders', 'order_id', count(*) FILTER (order_id IS NULL) FROM fx_fct_orders
UNION ALL SELECT 'fct_orders', 'customer_key', count(*) FILTER (customer_key IS NULL) FROM fx_fct_orders
UNION ALL SELECT 'fct_revenue', 'order_id', count(*) FILTER (order_id IS NULL) FROM fx_fct_revenue
UNION ALL SELECT 'fct_revenue', 'customer_key', count(*) FILTER (customer_key IS NULL) FROM fx_fct_revenue
""")
def dq_not_null(i):
    declared = {
        "stg_customers": (stg_customers(i), ["cust_id", "email"]),
        "stg_orders": (stg_orders(i), ["order_id", "cust_id"]),
        "stg_payments": (stg_payments(i), ["payment_id", "order_id"]),
        "dim_customers": (dim_customers(i), ["customer_key"]),
        "fct_orders": (orders(i), ["order_id", "customer_key"]),
        "fct_revenue": (revenue(i), ["order_id", "customer_key"]),
    }
    return _by_table(declared, quality.not_null)


def _by_table(declared, check):
    result = None
    for table, (df, columns) in declared.items():
        one = check(df, columns).select(F.lit(table).alias("table_name"), "column_name", "failures")
        result = one if result is None else result.unionByName(one)
    return result


@query("dq_unique", """
SELECT 'dim_customers' AS table_name, 'customer_key' AS column_name, count(*) AS failures
FROM (SELECT customer_key FROM fx_dim_customers GROUP BY 1 HAVING count(*) > 1) t
UNION ALL SELECT 'fct_orders', 'order_id', count(*) FROM (SELECT order_id FROM fx_fct_orders GROUP BY 1 HAVING count(*) > 1) t
UNION ALL SELECT 'fct_revenue', 'order_id', count(*) FROM (SELECT order_id FROM fx_fct_revenue GROUP BY 1 HAVING count(*) > 1) t
UNION ALL SELECT 'stg_payments', 'payment_id', count(*) FROM (SELECT payment_id FROM fx_raw_payments GROUP BY 1 HAVING count(*) > 1) t
UNION ALL SELECT 'lineitem', 'line_key', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) t
""")
def dq_unique(i):
    lines = i.lineitem.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("line_key"))
    return _by_table({
        "dim_customers": (dim_customers(i), ["customer_key"]),
        "fct_orders": (orders(i), ["order_id"]),
        "fct_revenue": (revenue(i), ["order_id"]),
        "stg_payments": (stg_payments(i), ["payment_id"]),
        "lineitem": (lines, ["line_key"]),
    }, quality.unique)


@query("dq_fk_orphans", """
SELECT 'orders' AS child, CAST(o.order_id AS STRING) AS child_key, o.cust_id AS missing FROM fx_raw_orders o
WHERE NOT EXISTS (SELECT 1 FROM fx_raw_customers c WHERE c.cust_id = o.cust_id)
UNION ALL
SELECT 'payments', CAST(p.payment_id AS STRING), p.order_id FROM fx_raw_payments p
WHERE NOT EXISTS (SELECT 1 FROM fx_raw_orders o WHERE o.order_id = p.order_id)
UNION ALL
SELECT 'fct_orders', CAST(order_id AS STRING), order_id FROM fx_fct_orders o
WHERE NOT EXISTS (SELECT 1 FROM fx_candidate_orders c WHERE c.order_id = o.order_id)
""")
def dq_fk_orphans(i):
    def missing(name, rows, key, column):
        return rows.select(F.lit(name).alias("child"), F.col(key).cast("string").alias("child_key"),
                           F.col(column).alias("missing"))

    return (
        missing("orders", quality.orphans(i.raw_orders, "cust_id", i.raw_customers, "cust_id"), "order_id", "cust_id")
        .unionByName(missing(
            "payments", quality.orphans(payments(i), "order_id", i.raw_orders, "order_id"), "payment_id", "order_id"))
        .unionByName(missing(
            "fct_orders", quality.orphans(orders(i), "order_id", i.candidate_orders, "order_id"), "order_id", "order_id"))
    )


# --- digests and parity --------------------------------------------------------


def _field(name: str, kind: str = "") -> str:
    text = f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')" if kind == "ts" else f"CAST({name} AS VARCHAR)"
    return f"coalesce(replace(replace({text}, '\\', '\\\\'), '|', '\\p'), '\\N')"


ORDER_FIELDS = {"order_id": "", "customer_key": "", "order_date": "ts", "status": "", "amount": ""}
CUSTOMER_FIELDS = {"customer_key": "", "first_name": "", "last_name": "", "email": "", "created_at": "ts"}
REVENUE_FIELDS = {"order_id": "", "order_date": "ts", "status": "", "amount": "", **CUSTOMER_FIELDS}


def hashes_sql(table: str, fields: dict[str, str]) -> str:
    row = " || '|' || ".join(_field(n, k) for n, k in fields.items())
    return f"SELECT sha256({row}) AS hash FROM {table}"


def digest_sql(hashes: str, keys: str = "") -> str:
    """The digest over a ``hash`` column: its first 60 digits added up in 16-bit slices."""
    key, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    sums = ", ".join(
        f"CAST(coalesce(sum(CAST('0x' || substr(hash, {digit}, 4) AS BIGINT)), 0) AS VARCHAR)" for digit in range(1, 60, 4))
    return f"""
    SELECT {key}sha256(concat_ws(',', {sums})) AS checksum, count(*) AS row_count FROM ({hashes}) {group}
    """


@query("table_checksum", digest_sql(hashes_sql("fx_fct_orders", ORDER_FIELDS)))
def table_checksum(i):
    return quality.table_checksum(orders(i))


def golden_sql(name: str, table: str, fields: dict[str, str]) -> str:
    return f"SELECT '{name}' AS table_name, row_count, '{'; '.join(fields)}' AS columns, checksum FROM ({digest_sql(hashes_sql(table, fields))})"


GOLDEN = " UNION ALL ".join([
    golden_sql("dim_customers", "fx_dim_customers", CUSTOMER_FIELDS),
    golden_sql("fct_orders", "fx_fct_orders", ORDER_FIELDS),
    golden_sql("fct_revenue", "fx_fct_revenue", REVENUE_FIELDS),
])


@query("golden_capture", GOLDEN)
def golden_capture(i):
    return quality.golden_capture(run_models(i.raw_customers, i.raw_orders))


@query("golden_write", GOLDEN)
def golden_write(i):
    path = run_path(i.spark, "golden")
    files.write_golden(golden_capture(i), path)
    return files.read_golden(i.spark, path)


@query("column_checksum", digest_sql(" UNION ALL ".join(
    f"SELECT '{n}' AS column_name, sha256({_field(n, k)}) AS hash FROM fx_fct_orders" for n, k in ORDER_FIELDS.items()
), "column_name"))
def column_checksum(i):
    return quality.column_checksum(orders(i))


@query("parity_compare", f"""
SELECT 'dim_customers' AS table_name, CAST(0 AS BIGINT) AS row_delta, '' AS lost_columns, '' AS gained_columns,
       true AS checksum_equal, 'PASS' AS verdict
UNION ALL
SELECT 'fct_orders', c.row_count - g.row_count, '', '', c.checksum = g.checksum,
       CASE WHEN c.checksum = g.checksum AND c.row_count = g.row_count THEN 'PASS' ELSE 'FAIL' END
FROM ({digest_sql(hashes_sql("fx_fct_orders", ORDER_FIELDS))}) g,
     ({digest_sql(hashes_sql("fx_candidate_orders", ORDER_FIELDS))}) c
""")
def parity_compare(i):
    golden = quality.golden_capture({"fct_orders": orders(i), "dim_customers": dim_customers(i)})
    candidate = quality.golden_capture({"fct_orders": i.candidate_orders, "dim_customers": dim_customers(i)})
    return quality.parity(golden, candidate)


@query("parity_row_diff", """
SELECT coalesce(g.order_id, c.order_id) AS order_id,
       CASE WHEN c.order_id IS NULL THEN 'only_in_golden' WHEN g.order_id IS NULL THEN 'only_in_candidate'
            ELSE 'changed' END AS status,
       CASE WHEN c.order_id IS NULL OR g.order_id IS NULL THEN '' ELSE concat_ws('; ',
            CASE WHEN g.customer_key IS DISTINCT FROM c.customer_key THEN 'customer_key' END,
            CASE WHEN g.order_date IS DISTINCT FROM c.order_date THEN 'order_date' END,
            CASE WHEN g.status IS DISTINCT FROM c.status THEN 'status' END,
            CASE WHEN g.amount IS DISTINCT FROM c.amount THEN 'amount' END) END AS changed_columns
FROM fx_fct_orders g FULL OUTER JOIN fx_candidate_orders c ON g.order_id = c.order_id
WHERE g.order_id IS NULL OR c.order_id IS NULL OR g.customer_key IS DISTINCT FROM c.customer_key
   OR g.order_date IS DISTINCT FROM c.order_date OR g.status IS DISTINCT FROM c.status
   OR g.amount IS DISTINCT FROM c.amount
""")
def parity_row_diff(i):
    return quality.row_diff(orders(i), i.candidate_orders, ["order_id"])


@query("parity_row_diff_keyless", f"""
SELECT order_id, customer_key, {ORDER_DATE}, status, {AMOUNT}, side
FROM ((SELECT *, 'only_in_golden' AS side FROM (SELECT * FROM fx_fct_orders EXCEPT ALL SELECT * FROM fx_candidate_orders))
      UNION ALL
      (SELECT *, 'only_in_candidate' FROM (SELECT * FROM fx_candidate_orders EXCEPT ALL SELECT * FROM fx_fct_orders)))
""")
def parity_row_diff_keyless(i):
    return quality.row_diff_keyless(orders(i), i.candidate_orders)


@query("dq_references", """
SELECT 'raw_orders' AS child, 'cust_id' AS column_name, 'raw_customers' AS parent, count(*) AS failures FROM fx_raw_orders
WHERE status <> 'refunded' AND cust_id NOT IN (SELECT cust_id FROM fx_raw_customers WHERE email IS NOT NULL)
UNION ALL
SELECT 'raw_payments', 'order_id', 'raw_orders', count(*) FROM fx_raw_payments
WHERE order_id NOT IN (SELECT order_id FROM fx_raw_orders WHERE status <> 'refunded')""")
def dq_references(i):
    """All declared references, after customers without an address and refunded orders were archived."""
    return quality.declared_orphans({
        "raw_customers": i.raw_customers.filter("email IS NOT NULL"),
        "raw_orders": i.raw_orders.filter("status <> 'refunded'"), "raw_payments": payments(i),
    })


# --- renamed source: absorb, bridge, shadow run --------------------------------


def renamed_customers(i):
    return i.raw_customers.withColumnRenamed("cust_id", "customer_id")


BACK = {"customer_id": "cust_id"}
CUSTOMER_SQL = f"SELECT cust_id, first_name, last_name, email, {CREATED} FROM fx_raw_customers"


@query("absorb_rename", CUSTOMER_SQL)
def absorb_rename(i):
    from faultline.operators.patch import absorb_rename as absorb

    return absorb(renamed_customers(i), BACK)


@query("bridge_view", CUSTOMER_SQL)
def bridge_view(i):
    from faultline.operators.patch import bridge_view as bridge

    return bridge(renamed_customers(i), BACK, "customers_bridge")


@query("shadow_run", f"""
SELECT table_name, CAST(0 AS BIGINT) AS row_delta, '' AS lost_columns, '' AS gained_columns,
       true AS checksum_equal, CASE WHEN row_count >= 0 THEN 'PASS' END AS verdict FROM ({GOLDEN})
""")
def shadow_run(i):
    return shadow_parity(i.raw_customers, renamed_customers(i), i.raw_orders, BACK)
