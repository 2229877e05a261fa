"""One asset out of the physical and the logical entity of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import names


def resolve_urn(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """The dataset URN each (request, table, schema, platform) stands for, null if none.

    ``candidates`` are search hits ``request_id, urn, search_rank``. Hits whose
    qualified name holds the schema win; the search rank decides among equals.
    """
    hits = requests.join(candidates, "request_id").filter(
        F.startswith("urn", F.lit(names.DATASET_PREFIX))
        & F.contains("urn", F.concat(F.lit(names.PLATFORM_PREFIX), "platform"))
    )
    in_schema = F.contains("urn", F.concat(F.lit("."), "schema_name", F.lit("."), "table_name", F.lit(",")))
    best = hits.groupBy("request_id").agg(
        F.min(F.struct((~in_schema).alias("off_schema"), "search_rank", "urn")).alias("best")
    )
    return requests.join(best, "request_id", "left").select(
        "request_id", F.col("best.urn").alias("urn"), F.col("best.urn").isNotNull().alias("resolved")
    )


def merge_siblings(
    entities: DataFrame, keys: tuple[str, ...] = ("change_id",), first_fields: int | None = None
) -> DataFrame:
    """Lineage hits (entity, degree) as one row per asset with both sides kept.

    Assets are keyed by qualified name; two schemas with a same-named table stay
    two assets. Entities that are not datasets are left out. Of several entities of a side
    the least is kept, by its fields in order; ``first_fields`` keeps so many of its fields,
    for readers of no others, and the rest never moves.
    """
    rows = entities.filter(F.col("entity.type") == "DATASET").withColumn(
        "platform", names.platform_of(F.col("entity.urn"))
    )

    if first_fields is not None:
        fields = rows.schema["entity"].dataType.names[:first_fields]
        rows = rows.withColumn("entity", F.struct(*[F.col("entity")[name].alias(name) for name in fields]))

    def side(platform: str):
        return F.min(F.when(F.col("platform") == platform, F.struct("degree", "entity")))["entity"]

    return rows.groupBy(*keys, "node").agg(
        F.min("degree").alias("hop"),
        side(names.PHYSICAL).alias("physical"),
        side(names.LOGICAL).alias("logical"),
    )


def coalesce_siblings(merged: DataFrame) -> DataFrame:
    """Owners and URN from the physical side, else the logical; the path only from the logical."""
    preferred = F.coalesce("physical", "logical")
    owners = preferred["ownership"]["owners"]
    return merged.withColumns(
        {
            "urn": preferred["urn"],
            "owners": names.owner_urns(owners),
            "has_business_owner": names.has_business_owner(owners),
            "file_path": names.custom_property(
                F.col("logical")["properties"]["customProperties"], names.FILE_PATH_PROPERTY
            ),
        }
    ).drop("physical", "logical")
