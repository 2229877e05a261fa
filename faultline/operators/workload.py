"""The query history of the warehouse, one function per statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scalar(df: DataFrame, aggregate) -> DataFrame:
    return df.agg(aggregate.alias("_scalar"))


def topk_revenue(revenue: DataFrame, k: int = 10) -> DataFrame:
    """The largest amounts; the order id breaks ties."""
    top = revenue.orderBy(F.desc("amount"), "order_id").limit(k)
    return top.select("customer_key", "amount")


def frequent_customers(revenue: DataFrame, more_than: int = 5) -> DataFrame:
    counts = revenue.groupBy("customer_key").agg(F.count(F.lit(1)).alias("n_orders"))
    return counts.filter(F.col("n_orders") > more_than)


def completed_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == "completed")


def revenue_by_customer(revenue: DataFrame) -> DataFrame:
    return revenue.groupBy("customer_key").agg(F.sum("amount").alias("total_amount"))


def recent_orders(orders: DataFrame, days: int = 30) -> DataFrame:
    """Orders of the last ``days`` days, counted back from the newest order."""
    newest = _scalar(orders, F.max("order_date"))
    since = newest.select(F.col("_scalar") - F.expr(f"INTERVAL {days} DAYS")).scalar()
    return orders.filter(F.col("order_date") > since).select("order_id", "amount")


def cancelled_count(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == "cancelled").agg(F.count(F.lit(1)).alias("n_orders"))


def customer_names(customers: DataFrame) -> DataFrame:
    return customers.select("customer_key", "first_name", "last_name")


def average_amount(revenue: DataFrame) -> DataFrame:
    return revenue.agg(F.avg("amount").alias("avg_amount"))


def first_order_customer(revenue: DataFrame) -> DataFrame:
    first = _scalar(revenue, F.min("order_id")).scalar()
    return revenue.filter(F.col("order_id") == first).select("customer_key")


def large_orders(orders: DataFrame, above: float = 400) -> DataFrame:
    return orders.filter(F.col("amount") > above).select("order_id", "customer_key", "amount")


def above_average(revenue: DataFrame) -> DataFrame:
    average = _scalar(revenue, F.avg("amount")).scalar()
    return revenue.filter(F.col("amount") > average).select("customer_key", "amount")


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def customers_with_email(customers: DataFrame) -> DataFrame:
    return customers.filter(F.col("email").isNotNull()).select("cust_id", "email")


def customer_count(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count(F.lit(1)).alias("n_customers"))


def named_customers(customers: DataFrame) -> DataFrame:
    return customers.filter(F.col("first_name").isNotNull()).select("cust_id", "first_name", "last_name")


def pending_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == "pending").select("order_id", "status")


def positive_payments(payments: DataFrame) -> DataFrame:
    return payments.filter(F.col("amount") > 0).select("payment_method", "amount")
