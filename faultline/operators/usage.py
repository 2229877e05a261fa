"""Query history, owners and documentation attached to assets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import names

DEFAULT_TABLE = "fct_orders"

# The owner of each layer of the demo warehouse.
TECHNICAL_LAYERS = ("raw", "staging")


# Characters of the names that one automaton holds at most; longer lists take several.
BLOCK_CHARS = 1 << 23


def _name_blocks(known: Sequence[str] | DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(priority, name) in order of priority, in lists of bounded size."""
    if isinstance(known, DataFrame):
        rows = ((r.priority, r.table_name) for r in known.select("priority", "table_name").orderBy("priority").toLocalIterator())
    else:
        rows = enumerate(known)
    block, chars = [], 0
    for priority, name in rows:
        if name is None:
            continue
        if block and chars + len(name) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((priority, name))
        chars += len(name)
    if block:
        yield block


def _first_names(names: list[tuple[int, str]]):
    """For a task: all names as one automaton that reads a text once, whatever their number.

    The function refers to nothing in this package, so it is shipped whole.
    """
    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for place, (_, name) in enumerate(names):
            if name and name not in automaton:
                automaton.add_word(name, place)
        automaton.make_automaton()
        empty = next((place for place, (_, name) in enumerate(names) if not name), len(names))
        for batch in batches:
            at = batch.schema.names.index("target")
            targets = batch.column(at).to_pylist()
            for k, statement in enumerate(batch.column(batch.schema.names.index("statement")).to_pylist()):
                if targets[k] is None and statement is not None:
                    hits = (place for _, place in automaton.iter(statement)) if len(automaton) else ()
                    place = min(min(hits, default=empty), empty)
                    targets[k] = names[place][1] if place < len(names) else None
            yield batch.set_column(at, "target", pa.array(targets, pa.string()))

    return attribute


def attribute_statements(
    statements: DataFrame, known_tables: Sequence[str] | DataFrame, default: str = DEFAULT_TABLE
) -> DataFrame:
    """The first listed table whose name occurs in each statement, ``target``.

    ``known_tables`` is a list, or a table of ``priority, table_name`` (least priority
    first). All names are matched in one reading of a statement; a list too long for one
    automaton is taken in blocks, and later blocks read only what is not attributed yet.
    A null statement, or one that names no table, gets the default.
    """
    rows = statements.withColumn("target", F.lit(None).cast("string"))
    for names in _name_blocks(known_tables):
        rows = rows.mapInArrow(_first_names(names), rows.schema)
    return rows.withColumn("target", F.coalesce("target", F.lit(default)))


def fingerprint(statement: Column) -> Column:
    return F.substring(F.sha2(statement, 256), 1, 16)


def distinct_statements(statements: DataFrame) -> DataFrame:
    """One row per statement text: its fingerprint, first id and number of copies.

    Grouping is by digest with partial aggregation, so the texts themselves are
    not shuffled and a text with very many copies is one row per map task.
    """
    hashed = statements.select(fingerprint(F.col("statement")).alias("fingerprint"), "statement_id")
    return hashed.groupBy("fingerprint").agg(
        F.min("statement_id").alias("statement_id"), F.count(F.lit(1)).alias("copies")
    )


def usage_count(assets: DataFrame, usage_log: DataFrame) -> DataFrame:
    """Queries on record per asset, 0 where there are none."""
    counts = usage_log.groupBy("node").agg(F.count(F.lit(1)).alias("usage_count"))
    return assets.select("node").distinct().join(counts, "node", "left").fillna(0, ["usage_count"])


def usage_stats(usage_log: DataFrame) -> DataFrame:
    """Queries and distinct users per asset and day, with the count of each user.

    Counted per user first; the second step sums those small rows, so a hot asset
    is reduced before it is gathered.
    """
    per_user = usage_per_user(usage_log)
    return per_user.groupBy("node", "usage_date").agg(
        F.sum("n_queries").alias("total_queries"), F.count(F.lit(1)).alias("unique_users")
    )


def usage_per_user(usage_log: DataFrame) -> DataFrame:
    dated = usage_log.withColumn("usage_date", F.to_date("ts"))
    return dated.groupBy("node", "usage_date", "actor").agg(F.count(F.lit(1)).alias("n_queries"))


def usage_window(usage_log: DataFrame, days: int = 30) -> DataFrame:
    """Queries per asset in the ``days`` days that end with the newest one."""
    newest = usage_log.agg(F.max("ts").alias("_newest"))
    since = newest.select(F.col("_newest") - F.expr(f"INTERVAL {days} DAYS")).scalar()
    recent = usage_log.filter(F.col("ts") > since)
    return recent.groupBy("node").agg(F.count(F.lit(1)).alias("recent_queries"))


def usage_sliding(usage_log: DataFrame, days: int = 30) -> DataFrame:
    """Queries per asset in the ``days`` days that end with each day it was queried.

    Days are counted first, so a window runs over one row per asset and day however many
    queries there were, and a query is added up once and not once per window it is in.
    """
    panes = usage_log.groupBy("node", F.to_date("ts").alias("usage_date")).agg(F.count(F.lit(1)).alias("_n"))
    day = F.datediff("usage_date", F.lit("1970-01-01").cast("date"))
    recent = Window.partitionBy("node").orderBy(day).rangeBetween(1 - days, 0)
    return panes.select("node", "usage_date", F.sum("_n").over(recent).alias("recent_queries"))


def assign_owners(assets: DataFrame, technical_owner: str, business_owner: str) -> DataFrame:
    """One owner per table: technical for raw and staging layers, business for marts."""
    technical = F.col("layer").isin(*TECHNICAL_LAYERS)
    return assets.select(
        "node",
        F.when(technical, technical_owner).otherwise(business_owner).alias("owner"),
        F.when(technical, "TECHNICAL_OWNER").otherwise(names.BUSINESS_OWNER).alias("owner_type"),
    ).distinct()


def owner_flags(entities: DataFrame) -> DataFrame:
    owners = F.col("entity.ownership.owners")
    return entities.select(
        F.col("entity.urn").alias("urn"),
        names.owner_urns(owners).alias("owners"),
        names.has_business_owner(owners).alias("has_business_owner"),
    )


def glossary_links(columns: DataFrame, term_columns: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms attached to columns: ``term_columns`` names the columns a term covers."""
    linked = columns.join(term_columns, ["table_name", "column_name"])
    return linked.join(terms, "term_id").select("table_name", "column_name", "term_id", "term", "definition")


def describe(assets: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Assets with their table description, null where none was written."""
    return assets.join(descriptions, "node", "left")
