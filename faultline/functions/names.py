"""Names, URNs and properties of catalog entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The URN format of the catalog the entities come from.
DATASET_PREFIX = "urn:li:dataset:"
PLATFORM_PREFIX = "urn:li:dataPlatform:"
LOGICAL, PHYSICAL, OTHER = "dbt", "postgres", "other"
FILE_PATH_PROPERTY = "dbt_file_path"
BUSINESS_OWNER = "BUSINESS_OWNER"


def bare_name(name: Column) -> Column:
    """Last segment of a qualified name; for display, never a key."""
    return F.substring_index(name, ".", -1)


def platform_of(urn: Column) -> Column:
    return (
        F.when(F.contains(urn, F.lit(f"dataPlatform:{LOGICAL}")), LOGICAL)
        .when(F.contains(urn, F.lit(f"dataPlatform:{PHYSICAL}")), PHYSICAL)
        .otherwise(OTHER)
    )


def dataset_urn(platform: Column, qualified_name: Column, env: Column) -> Column:
    return F.concat(
        F.lit(f"{DATASET_PREFIX}({PLATFORM_PREFIX}"), platform, F.lit(","), qualified_name, F.lit(","), env, F.lit(")")
    )


def qualified_name(urn: Column) -> Column:
    """``database.schema.table`` of a dataset URN, empty for any other URN."""
    return F.regexp_extract(urn, r"^urn:li:dataset:\(urn:li:dataPlatform:[^,]+,([^,]+),[^,)]+\)$", 1)


def custom_property(properties: Column, key: str) -> Column:
    """Value of the first property with that key, null if there is none."""
    return F.get(F.filter(properties, lambda p: p["key"] == key), F.lit(0))["value"]



def has_business_owner(owners: Column) -> Column:
    return F.coalesce(F.exists(owners, lambda o: o["type"] == BUSINESS_OWNER), F.lit(False))


def owner_urns(owners: Column) -> Column:
    """URNs of the owners, an empty array where the entity has none."""
    return F.coalesce(F.transform(owners, lambda o: o["owner"]["urn"]), F.array().cast("array<string>"))
