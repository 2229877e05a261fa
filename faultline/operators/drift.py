"""Schema snapshots and what changed between them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.ordering import previous_within

KEY = ("platform", "schema_name", "table_name")
# The kinds of detected change.
POSSIBLE_RENAME, DROP_COLUMN, ADD_COLUMN = "possible_rename", "drop_column", "add_column"


def snapshot_capture(fields: DataFrame) -> DataFrame:
    """Column list (name, type) per table and capture time; one table's columns fit a row."""
    return fields.groupBy(*KEY, "captured_at").agg(
        F.array_sort(F.collect_set(F.struct("name", "type"))).alias("columns")
    )


def schema_filter(tables: DataFrame, pattern: str) -> DataFrame:
    """Tables, views included, of the schemas that match a pattern."""
    return tables.filter(F.rlike("schema_name", F.lit(pattern)))


def live_columns(df: DataFrame) -> Column:
    """Column list of a live DataFrame in the shape of a snapshot."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in df.dtypes])


def live_snapshots(
    spark: SparkSession, tables: Mapping[str, DataFrame], platform: str, schema_name: str, captured_at: Column
) -> DataFrame:
    """A snapshot of each table's schema as it is now, in the shape of the stored ones."""
    rows = None
    for name, df in tables.items():
        one = spark.range(1).select(
            F.lit(platform).alias("platform"), F.lit(schema_name).alias("schema_name"), F.lit(name).alias("table_name"),
            captured_at.alias("captured_at"), F.array_sort(live_columns(df)).alias("columns"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _names(columns: Column) -> Column:
    return F.array_distinct(F.transform(columns, lambda c: c["name"]))


def _change(kind: str, old: Column, new: Column) -> Column:
    gone = F.concat(F.lit("`"), old, F.lit("` is no longer there"))
    come = F.concat(F.lit("`"), new, F.lit("` is new"))
    evidence = {
        DROP_COLUMN: gone,
        ADD_COLUMN: come,
        POSSIBLE_RENAME: F.concat(gone, F.lit(" and "), come, F.lit("; a rename or an unrelated drop and add")),
    }[kind]
    return F.struct(
        F.lit(kind).alias("change_type"),
        old.cast("string").alias("old_column"),
        new.cast("string").alias("new_column"),
        evidence.alias("evidence"),
    )


def column_changes(before: Column, after: Column) -> Column:
    """Changes between two column lists, by name; types are not compared.

    One name gone and one new is reported as a possible rename; anything else as
    independent drops, then additions, sorted by name.
    """
    gone = F.array_sort(F.array_except(_names(before), _names(after)))
    come = F.array_sort(F.array_except(_names(after), _names(before)))
    null = F.lit(None)
    rename = F.array(_change(POSSIBLE_RENAME, F.get(gone, F.lit(0)), F.get(come, F.lit(0))))
    singles = F.concat(
        F.transform(gone, lambda n: _change(DROP_COLUMN, n, null)),
        F.transform(come, lambda n: _change(ADD_COLUMN, null, n)),
    )
    return F.when((F.size(gone) == 1) & (F.size(come) == 1), rename).otherwise(singles)


def explode_changes(pairs: DataFrame, *carried: str) -> DataFrame:
    """One row per change of each (previous_columns, columns) pair; no baseline, no change."""
    # An outer explode: the inner one would repeat the comparison in a pushed-down filter.
    changes = F.posexplode_outer(column_changes(F.col("previous_columns"), F.col("columns")))
    found = pairs.select(*KEY, "captured_at", *carried, changes.alias("seq", "change"))
    return found.filter(F.col("change").isNotNull()).select(*KEY, "captured_at", *carried, "seq", "change.*")


def snapshot_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Changes of each current snapshot against its baseline."""
    old = baseline.select(*KEY, F.col("columns").alias("previous_columns"))
    return explode_changes(current.join(old, list(KEY), "left"))


def consecutive_pairs(history: DataFrame) -> DataFrame:
    """Each snapshot with the column list of the one before it."""
    return previous_within(history, KEY, "captured_at", "columns", "previous_columns")


def history_diff(history: DataFrame) -> DataFrame:
    """Changes between consecutive snapshots of each table."""
    return explode_changes(consecutive_pairs(history))


def actionable(changes: DataFrame) -> DataFrame:
    """Changes with an old and a new column; the others are only recorded."""
    return changes.filter(F.col("old_column").isNotNull() & F.col("new_column").isNotNull())


def _first_of_each(columns: str) -> Column:
    """The column list in order of name and type, only the first of equal names."""
    ordered = F.array_sort(F.filter(columns, lambda c: c["name"].isNotNull()))
    before = lambda i: F.get(ordered, i - 1)["name"]
    return F.filter(ordered, lambda c, i: (i == 0) | (c["name"] != before(i)))


def type_changes(history: DataFrame) -> DataFrame:
    """Columns whose type differs from the snapshot before; separate from the name changes.

    A name that a snapshot lists more than once counts with the first of its types.
    """
    pairs = consecutive_pairs(history).filter(F.col("previous_columns").isNotNull())
    before = F.map_from_entries(_first_of_each("previous_columns"))
    changed = F.filter(
        F.transform(
            _first_of_each("columns"),
            lambda c: F.struct(
                c["name"].alias("column_name"), F.try_element_at(before, c["name"]).alias("old_type"),
                c["type"].alias("new_type"),
            ),
        ),
        lambda c: c["old_type"] != c["new_type"],
    )
    return pairs.select(*KEY, "captured_at", F.explode(changed).alias("_c")).select(*KEY, "captured_at", "_c.*")
