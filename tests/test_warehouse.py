import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from faultline.operators import ordering, patch, quality
from faultline.plans.warehouse import run_models, shadow_parity
from faultline.sources import files, schemas


def raw(spark):
    customers = spark.createDataFrame(
        [(1, "Ann", "Lee", "a@x", None), (2, "Bo", "Kim", None, None)],
        "cust_id int, first_name string, last_name string, email string, created_at timestamp",
    )
    orders = spark.createDataFrame(
        [(10, 1, None, "completed", 20.0), (11, 1, None, "cancelled", 30.0), (12, 2, None, None, 5.0),
         (13, 2, None, "pending", 7.5), (14, 9, None, "pending", 1.0)],
        "order_id int, cust_id int, order_date timestamp, status string, amount double",
    ).withColumn("amount", F.col("amount").cast("decimal(10,2)"))
    return customers, orders


def test_revenue_drops_cancelled_null_status_and_unknown_customers(spark):
    revenue = run_models(*raw(spark))["fct_revenue"]
    assert revenue.columns == [
        "order_id", "order_date", "status", "amount", "customer_key", "first_name", "last_name", "email", "created_at",
    ]
    assert sorted(r.order_id for r in revenue.collect()) == [10, 13]


def test_numbering_is_dense_whatever_the_gaps(spark):
    ids = spark.createDataFrame([(i * i * i * 70_000_007,) for i in range(500)], "k long")
    rows = ordering.number_within(ids, [], [F.col("k")], "n").orderBy("k").collect()
    assert [r.n for r in rows] == list(range(1, 501))


def test_number_within_splits_a_hot_key_and_stays_exact(spark):
    rows = [("hot", i % 97, i) for i in range(3000)] + [("cold", 1, 9001), ("cold", 0, 9002)]
    df = spark.createDataFrame(rows, "k string, score int, id long")
    got = ordering.number_within(df, ["k"], [F.desc("score"), F.asc("id")], "rank").collect()
    expected = {}
    for key in ("hot", "cold"):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        expected.update({r[2]: n for n, r in enumerate(ordered, 1)})
    assert {r.id: r["rank"] for r in got} == expected


def test_previous_value_crosses_ranges_and_keeps_nulls(spark):
    rows = [("a", d, None if d == 40 else d * 10) for d in (1, 2, 33, 40, 95)] + [("b", 50, 7)]
    df = spark.createDataFrame(rows, "k string, d int, v int")
    got = ordering.previous_within(df, ["k"], "d", "v", "before").collect()
    assert {(r.k, r.d): r.before for r in got} == {
        ("a", 1): None, ("a", 2): 10, ("a", 33): 20, ("a", 40): 330, ("a", 95): None, ("b", 50): None,
    }


def digest(df):
    return quality.table_checksum(df).collect()[0].checksum


def test_checksum_ignores_order_and_partitions_but_not_duplicates(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}", None if i % 5 else 1.5) for i in range(400)], "a int, b string, c double")
    assert digest(df) == digest(df.orderBy(F.desc("a")).repartition(3))
    assert digest(df) != digest(df.unionByName(df.limit(1)))
    assert digest(df) != digest(df.withColumn("b", F.when(F.col("a") == 3, "x").otherwise(F.col("b"))))


def test_checksum_tells_nulls_separators_and_empty_text_apart(spark):
    def one(*row):
        return spark.createDataFrame([row], "a string, b string")

    digests = {digest(one(*row)) for row in [("x|y", ""), ("x", "y|"), ("x", None), ("x", "\\N"), ("x", "")]}
    assert len(digests) == 5
    assert quality.table_checksum(one("x", "y").limit(0)).collect()[0].row_count == 0


def test_checksum_depth_does_not_depend_on_skewed_content(spark):
    same = spark.range(5000).select(F.lit("same").alias("v"))
    row = quality.table_checksum(same).collect()[0]
    assert row.row_count == 5000


def test_rename_breaks_the_models_and_the_bridge_repairs_them(spark):
    customers, orders = raw(spark)
    renamed = customers.withColumnRenamed("cust_id", "customer_id")
    with pytest.raises(AnalysisException):
        run_models(renamed, orders)
    verdicts = shadow_parity(customers, renamed, orders, {"customer_id": "cust_id"}).collect()
    assert {v.verdict for v in verdicts} == {"PASS"} and len(verdicts) == 3
    assert patch.absorb_rename(renamed, {"customer_id": "cust_id"}).columns == customers.columns


def test_full_refresh_replaces_the_table(spark, tmp_path):
    schema = schemas.RAW_TABLES["raw_orders"]
    path = tmp_path / "orders.csv"
    table = str(tmp_path / "orders")
    path.write_text("order_id,cust_id,order_date,status,amount\n1,2,2024-01-01 10:00:00,pending,3.50\n")
    assert files.full_refresh(spark, str(path), table, schema) == 1
    path.write_text("order_id,cust_id,order_date,status,amount\n1,2,2024-01-01 10:00:00,pending,3.50\n2,2,2024-01-02 10:00:00,completed,4\n")
    assert files.full_refresh(spark, str(path), table, schema) == 2
    assert spark.read.parquet(table).schema["amount"].dataType.simpleString() == "decimal(10,2)"


def test_previous_value_of_a_hot_key(spark):
    df = spark.createDataFrame([("hot", i, i * 3) for i in range(2000)] + [("cold", 5, 1)], "k string, d int, v int")
    got = {(r.k, r.d): r.before for r in ordering.previous_within(df, ["k"], "d", "v", "before").collect()}
    assert got == {("hot", i): (i - 1) * 3 if i else None for i in range(2000)} | {("cold", 5): None}


def test_staged_tables_can_be_removed(spark, tmp_path):
    from pathlib import Path

    from faultline import session

    before = session._RUN
    try:
        session._RUN = "run-of-a-test"
        assert session.stage(spark.range(3), "three").count() == 3
        folder = Path(session.shared_dir(spark).removeprefix("file:")) / "run-of-a-test"
        assert len(list(folder.iterdir())) == 1
        session.clean_up(spark)
        assert not folder.exists()
    finally:
        session._RUN = before


def test_every_declared_reference_is_checked(spark):
    customers, orders = raw(spark)
    payments = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "payment_id int, order_id int")
    found = quality.declared_orphans({"raw_customers": customers, "raw_orders": orders, "raw_payments": payments}).collect()
    assert {(r.child, r.column_name, r.parent, r.failures) for r in found} == {
        ("raw_orders", "cust_id", "raw_customers", 1), ("raw_payments", "order_id", "raw_orders", 1)}


def diffed(spark, golden, candidate, keys=("k",)):
    g, c = (spark.createDataFrame(rows, "k string, a int, b string") for rows in (golden, candidate))
    return sorted((r.k or "null", r.status, tuple(r.changed_columns)) for r in quality.row_diff(g, c, list(keys)).collect())


def test_rows_without_a_telling_key_are_reported_singly(spark):
    golden = [("x", 1, "p"), ("y", 1, None), (None, 1, "n"), (None, 1, "n"), (None, 2, "n"), ("d", 1, "e"), ("d", 1, "e"), ("z", None, None)]
    candidate = [("x", 2, None), ("y", 1, None), (None, 1, "n"), (None, 3, "n"), (None, 4, "n"), ("d", 1, "e"), ("w", 0, "q"), ("z", None, None)]
    assert diffed(spark, golden, candidate) == [
        ("d", "only_in_golden", ()), ("null", "only_in_candidate", ()), ("null", "only_in_candidate", ()),
        ("null", "only_in_golden", ()), ("null", "only_in_golden", ()), ("w", "only_in_candidate", ()), ("x", "changed", ("a", "b")),
    ]
    assert diffed(spark, golden, golden) == [] and len(diffed(spark, golden, [])) == len(golden)


def test_very_many_rows_with_one_null_key_give_no_product(spark):
    golden = spark.range(100_000).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("a"))
    candidate = spark.range(50_000, 150_000).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("a"))
    counts = {r.status: r["count"] for r in quality.row_diff(golden, candidate, ["k"]).groupBy("status").count().collect()}
    assert counts == {"only_in_golden": 50_000, "only_in_candidate": 50_000}
    one = spark.range(30_000).select(F.lit("same").alias("k"))
    assert quality.row_diff_keyless(one, one.limit(10)).count() == 29_990


def test_keyless_difference_shuffles_rows_once(spark):
    rows = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    plan = quality.row_diff_keyless(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_parity_of_many_changes_in_one_plan(spark):
    scope = spark.createDataFrame([("same", 1), ("less", 2), ("other", 3), ("none", 9), ("both", 1), ("both", 3)], "change_id string, k int")
    golden = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None), (3, "c"), (7, "z")], "k int, v string")
    candidate = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("d", 3)], "v string, k int")
    got = {r.change_id: (r.row_delta, r.checksum_equal, r.verdict) for r in quality.parity_by_change(scope, golden, candidate, "k").collect()}
    assert got == {"same": (0, True, "PASS"), "less": (-1, False, "FAIL"), "other": (0, False, "FAIL"), "none": (0, True, "PASS"),
                   "both": (0, False, "FAIL")}
