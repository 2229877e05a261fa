"""The warehouse models: staging projections and the three marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.ordering import number_within


def stg_customers(raw_customers: DataFrame) -> DataFrame:
    return raw_customers.select("cust_id", "first_name", "last_name", "email", "created_at")


def stg_orders(raw_orders: DataFrame) -> DataFrame:
    return raw_orders.select("order_id", "cust_id", "order_date", "status", "amount")


def stg_payments(raw_payments: DataFrame) -> DataFrame:
    return raw_payments.select("payment_id", "order_id", "payment_method", "amount", "payment_date")


def dim_customers(staged_customers: DataFrame) -> DataFrame:
    return staged_customers.select(
        F.col("cust_id").alias("customer_key"), "first_name", "last_name", "email", "created_at"
    )


def fct_orders(staged_orders: DataFrame) -> DataFrame:
    return staged_orders.select(
        "order_id", F.col("cust_id").alias("customer_key"), "order_date", "status", "amount"
    )


def fct_revenue(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders that were not cancelled with every customer column.

    The customer side is a star on purpose: the mart's shape follows that table.
    """
    joined = orders.filter(F.col("status") != "cancelled").alias("o").join(
        customers.alias("c"), F.col("o.customer_key") == F.col("c.customer_key")
    )
    return joined.select("o.order_id", "o.order_date", "o.status", "o.amount", "c.*")


def derive_payments(orders: DataFrame, method: Column) -> DataFrame:
    """One payment per order that was not cancelled, numbered in order-id order."""
    paid = orders.filter(F.col("status") != "cancelled").select(
        "order_id", method.alias("payment_method"), "amount", F.col("order_date").alias("payment_date")
    )
    return number_within(paid, [], [F.col("order_id")], "payment_id").select(
        F.col("payment_id").cast("long").alias("payment_id"),
        "order_id", "payment_method", "amount", "payment_date",
    )
