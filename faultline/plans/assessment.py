"""From changes to ranked impact: one plan for all changes."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import names, text
from faultline.operators import classify, decision, graph, severity, siblings
from faultline.session import stage

SOURCE_SCHEMA = "public"
# What summaries and decisions read of an assessment; texts and evidence are for readers of rows.
MEASURED = ("change_id", "node", "hop", "in_column_scope", "is_dashboard_exposed", "break_mode", "owners")


@dataclass(frozen=True)
class Estate:
    """What the catalog knows.

    changes        change_id, node, column_name, change_type, new_column
    edges          src, dst, kind
    column_edges   src, src_col, dst, dst_col
    entities       node, entity (the nested catalog record)
    corpus         path, source_text, compiled_text
    usage_log      one row per query: node, actor, ts
    """

    changes: DataFrame
    edges: DataFrame
    column_edges: DataFrame
    entities: DataFrame
    corpus: DataFrame
    usage_log: DataFrame


@dataclass(frozen=True)
class Reach:
    """What one search found: (change, place) with hop and column scope, the dashboards there
    are, and the dashboard sets of the places; ``max_hops`` is the bound both kept to. A place
    is the number of a node under ``salt``."""

    estate: Estate
    pairs: DataFrame
    boards: DataFrame
    sets: DataFrame
    salt: int
    max_hops: int | None

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with a node, and its place."""
        return rows.withColumn("place", graph.number(F.col("node"), self.salt))

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows with a place that some edge leads to, and its node instead."""
        ends = self.estate.edges.select("dst").unionByName(self.estate.column_edges.select("dst"))
        return rows.join(self.placed(ends.select(F.col("dst").alias("node")).distinct()), "place").drop("place")

    @property
    def nodes(self) -> DataFrame:
        """(change, node) with hop and column scope."""
        return self.named(self.pairs).select("change_id", "node", "hop", "in_column_scope")

    @property
    def dashboards(self) -> DataFrame:
        """(change, dashboard) for every dashboard a change reaches."""
        return graph.dashboards_reached(self.nodes, self.boards)

    @property
    def exposed_places(self) -> DataFrame:
        """(change, place) that feed a dashboard their change reaches."""
        pairs = self.pairs.withColumnRenamed("place", "node")
        changes = self.placed(self.estate.changes).select("change_id", F.col("place").alias("node"))
        found = graph.dashboard_exposure(pairs, changes, self.sets.withColumnRenamed("place", "node"), self.max_hops)
        return found.withColumnRenamed("node", "place")

    @property
    def exposed(self) -> DataFrame:
        """(change, node) that feed a dashboard their change reaches."""
        return self.named(self.exposed_places).select("change_id", "node")


def asset_types(entities: DataFrame) -> DataFrame:
    return entities.select("node", F.col("entity.type").alias("type")).distinct()


def reach(estate: Estate, max_hops: int | None = None) -> Reach:
    """The downstream search of all changes, beside the sets of dashboards that nodes feed.

    Both run on numbers for nodes and columns.
    """
    boards = asset_types(estate.entities).filter("type = 'DASHBOARD'")
    edge, column = F.array("src", "dst"), F.array("src", "src_col", "dst", "dst_col")
    changed, star = F.array("node", "column_name", F.lit(graph.WHOLE_TABLE)), F.lit(graph.WHOLE_TABLE)
    salt = graph.salt_of(
        [edge, column, changed, F.array("node")], [estate.edges, estate.column_edges, estate.changes, estate.entities]
    )

    def numbers(*names: str) -> list[Column]:
        return [graph.number(F.col(name), salt).alias(name) for name in names]

    edges = estate.edges.select(*numbers("src", "dst"))
    columns = estate.column_edges.select(*numbers("src", "src_col", "dst", "dst_col"))
    changes = estate.changes.select("change_id", *numbers("node", "column_name"))
    with ThreadPoolExecutor(1) as beside:
        upward = beside.submit(graph.dashboard_sets, boards.select(*numbers("node")), edges, max_hops)
        pairs = graph.impact_reach(changes, edges, columns, max_hops, graph.number(star, salt))
        sets = upward.result()
    return Reach(
        estate, pairs.withColumnRenamed("node", "place"), boards, sets.withColumnRenamed("node", "place"), salt, max_hops
    )


def asset_profiles(estate: Estate, facts: DataFrame) -> DataFrame:
    """Everything known about an asset whatever the change: one row per dataset node."""
    rows = estate.entities.withColumn("degree", F.lit(0))
    merged = siblings.coalesce_siblings(siblings.merge_siblings(rows, keys=())).drop("hop")
    models = facts.drop("reads").withColumnRenamed("path", "file_path")
    counts = estate.usage_log.groupBy("node").agg(F.count(F.lit(1)).alias("usage_count"))
    profile = merged.join(models, "file_path", "left").join(counts, "node", "left")
    return profile.withColumns({
        "is_readable": F.coalesce("is_readable", F.lit(False)),
        "select_star_exposure": F.coalesce("select_star_exposure", F.lit(False)),
        "star_evidence": F.coalesce("star_evidence", F.array().cast("array<string>")),
        "usage_count": F.coalesce("usage_count", F.lit(0)).cast("long"),
    })


def origin_evidence(estate: Estate, facts: DataFrame) -> DataFrame:
    """(change, node) whose model reads the changed table itself, with the lines that
    name its column.

    Starts from the changes, so model texts meet direct readers only and never
    the whole scan.
    """
    reads = facts.select("path", F.explode("reads").alias("read")).filter(F.col("read.schema_name") == SOURCE_SCHEMA)
    readers = estate.changes.select("change_id", "column_name", F.lower("node").alias("table_name")).join(
        reads.select("path", F.col("read.table_name").alias("table_name")), "table_name"
    )
    lines = text.matching_lines(
        F.col("source_text"), F.col("path"), text.word(F.col("column_name"), ignore_case=True)
    )
    properties = F.col("entity")["properties"]["customProperties"]
    files = estate.entities.select(
        "node", names.custom_property(properties, names.FILE_PATH_PROPERTY).alias("path")
    ).filter(F.col("path").isNotNull())
    return readers.join(files, "path").join(estate.corpus.select("path", "source_text"), "path").select(
        "change_id", "node", lines.alias("origin_lines"), F.lit(True).alias("reads_changed")
    )


def unassessed(estate: Estate, found: Reach) -> DataFrame:
    """(change, node, hop) that a change reaches but the catalog has no record of.

    They cannot be graded, so they are no rows of the assessment; nothing reached is in neither.
    """
    known = estate.entities.select("node").distinct()
    return found.nodes.join(known, "node", "left_anti").select("change_id", "node", "hop")


def _gathered(estate: Estate, max_hops: int | None, found: Reach | None) -> tuple[Reach, DataFrame, DataFrame]:
    """The search, its pairs with what is known of them, and the profiles of the assets.

    Without a bound on hops, feeding a dashboard is a fact about the asset alone and comes
    with its profile; pairs are joined for it only where hops are bounded.
    """
    with ThreadPoolExecutor(1) as beside:
        read = beside.submit(stage, classify.model_facts(estate.corpus), "facts")
        found = found or reach(estate, max_hops)
        facts = read.result()
    profiles = found.placed(asset_profiles(estate, facts))
    feeds = F.lit(True).alias("is_dashboard_exposed")
    evidence = found.placed(origin_evidence(estate, facts)).drop("node")
    pairs = found.pairs.join(evidence, ["change_id", "place"], "left")
    if found.max_hops is None:
        profiles = profiles.join(found.sets.select("place", feeds).distinct(), "place", "left")
    else:
        pairs = pairs.join(found.exposed_places.select("change_id", "place", feeds), ["change_id", "place"], "left")
    return found, pairs, profiles


def _graded(joined: DataFrame) -> DataFrame:
    """Status, break mode and severity of pairs joined with their profiles."""
    status = classify.compile_status(
        F.col("in_column_scope"), F.col("file_path"), F.col("is_readable"), F.coalesce("reads_changed", F.lit(False))
    )
    return joined.withColumn("compile_status", status).withColumn(
        "break_mode", classify.break_mode(F.col("compile_status"), F.col("select_star_exposure"))
    ).withColumn(
        "severity_score",
        severity.severity_score(
            F.col("break_mode"), F.col("usage_count"), F.col("is_dashboard_exposed"), F.col("has_business_owner")
        ),
    )


def _graded_in_place(estate: Estate, max_hops: int | None, found: Reach | None) -> DataFrame:
    """Pairs with profile, status, mode and severity, graded where they lie, by place: the changes come
    to them to leave the changed assets out, and no pair moves to its change."""
    found, pairs, profiles = _gathered(estate, max_hops, found)
    others = pairs.join(found.placed(estate.changes).select("change_id", "place"), ["change_id", "place"], "left_anti")
    joined = others.join(profiles, "place").drop("place").withColumn("is_dashboard_exposed", F.coalesce("is_dashboard_exposed", F.lit(False)))
    return _graded(joined)


def measure(estate: Estate, columns: Sequence[str] = MEASURED, max_hops: int | None = None, found: Reach | None = None) -> DataFrame:
    """The rows of :func:`assess` with ``columns`` alone, none of which names what was changed.

    So no pair moves to its change and back to its node.
    """
    return _graded_in_place(estate, max_hops, found).select(*columns)


def assess(
    estate: Estate, max_hops: int | None = None, budget: int | None = None, found: Reach | None = None,
    affected_only: bool = False,
) -> DataFrame:
    """One row per (change, asset) with status, evidence, exposure, owners and severity.

    ``budget`` caps the assets looked at per change as a call budget would; by
    default every reached asset is assessed. ``affected_only`` leaves the unaffected rows
    out: without a budget pairs are then graded first, and only affected ones move to their change.
    """
    changes = estate.changes.select("change_id", F.col("node").alias("root"), "column_name", "change_type", "new_column")
    if affected_only and budget is None:
        graded = classify.affected(_graded_in_place(estate, max_hops, found)).join(changes, "change_id")
    else:
        found, pairs, profiles = _gathered(estate, max_hops, found)
        others = pairs.join(changes.withColumn("_start", graph.number(F.col("root"), found.salt)), "change_id")
        joined = others.filter(F.col("place") != F.col("_start")).join(profiles, "place").drop("place", "_start")
        joined = joined.withColumn("is_dashboard_exposed", F.coalesce("is_dashboard_exposed", F.lit(False)))
        if budget is not None:
            joined = graph.bounded_scan(joined, found.dashboards, budget)
        graded = _graded(joined)
        graded = classify.affected(graded) if affected_only else graded
    why = classify.compile_evidence(
        F.col("compile_status"), F.col("file_path"), F.col("is_readable"),
        F.concat(F.lit(f"{SOURCE_SCHEMA}."), "root"), F.col("origin_lines"),
    )
    return graded.withColumn("evidence", F.concat(why, "star_evidence")).drop("origin_lines", "reads_changed", "star_evidence", "is_readable")


def summarize(estate: Estate, assessment: DataFrame) -> DataFrame:
    changes = estate.changes.select("change_id", F.col("node").alias("root"), "column_name", "change_type", "new_column")
    return severity.impact_summary(changes, assessment)


def decide(estate: Estate, assessment: DataFrame) -> DataFrame:
    return decision.decide(summarize(estate, assessment))
