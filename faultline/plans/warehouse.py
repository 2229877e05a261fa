"""The model DAG as one function, and proof that a bridged rename keeps its results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from faultline.operators import patch, quality, warehouse
from faultline.session import stage

MARTS = ("dim_customers", "fct_orders", "fct_revenue")


def run_models(raw_customers: DataFrame, raw_orders: DataFrame) -> dict[str, DataFrame]:
    """The marts from the raw tables; staging stays a lazy projection."""
    customers = warehouse.dim_customers(warehouse.stg_customers(raw_customers))
    orders = warehouse.fct_orders(warehouse.stg_orders(raw_orders))
    return {
        "dim_customers": customers,
        "fct_orders": orders,
        "fct_revenue": warehouse.fct_revenue(orders, customers),
    }


def shadow_run(
    raw_customers: DataFrame, raw_orders: DataFrame, renames: Mapping[str, str], name: str = "raw_customers_bridge"
) -> dict[str, DataFrame]:
    """Build the marts from a renamed customers table through its bridge view.

    Results are written beside the real ones, each under a fresh path.
    """
    bridged = patch.bridge_view(raw_customers, renames, name)
    return {mart: stage(df, f"shadow_{mart}") for mart, df in run_models(bridged, raw_orders).items()}


def shadow_parity_by_change(
    scope: DataFrame, golden: DataFrame, rebuilt: DataFrame, renames: Mapping[str, str], key: str
) -> DataFrame:
    """Parity of many changes in one plan: each on the rows of its ``key``, read through the bridge."""
    return quality.parity_by_change(scope, golden, patch.absorb_rename(rebuilt, renames), key)


def shadow_parity(
    raw_customers: DataFrame, renamed_customers: DataFrame, raw_orders: DataFrame, renames: Mapping[str, str],
) -> DataFrame:
    """Golden marts against marts built after the rename, per table."""
    golden = quality.golden_capture(run_models(raw_customers, raw_orders))
    candidate = quality.golden_capture(shadow_run(renamed_customers, raw_orders, renames))
    return quality.parity(golden, candidate)
