"""Reachability over lineage edges for any number of starting points.

A search keeps rows of (search, node) and advances all searches one hop per job, until
nothing new is reached or a given number of hops is done; cycles end, since what was seen
is taken out of each frontier. Two tables are written so that later hops need not move them:

* the edges, once, bucketed by where they start. The edges of a hub are dealt over as many
  salts as its out-degree asks for; a frontier row on a hub is repeated for each salt, any
  other row once. So no bucket holds more than ``HUB_EDGES`` edges of one node.
* what was seen, bucketed by node as the edges are, and partitioned by hop. A frontier is
  the partition of the last hop, and meets its edges where it lies: a hop shuffles its
  newly reached rows once, to the nodes they reach. What is joined to the result by node
  later needs no shuffle of it either. Rows of one node share a bucket, one per search at
  most, and pass through sorts that spill.

Both lie in the shared folder: a lost executor costs the running hop at most, and Catalyst
knows their sizes, so small ones are broadcast instead.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from faultline.operators.ordering import number_within
from faultline.session import run_path, stage

DEFAULT_BUDGET = 30
# Stands for "the table as a whole" where a search also follows single columns.
WHOLE_TABLE = "*"
# Edges of one node that share a bucket at most.
HUB_EDGES = 1_000_000
# Edges into one node from which on rows are made distinct before they move there, and how
# many such nodes are looked for. This decides how a hop runs, never what it finds.
WIDE_EDGES, WIDE_NODES = 500, 1000
# A frontier that stands on few places takes its edges out of the table first: at most this
# many places, and at most one for so many edges. This too decides only how a hop runs.
FEW_STARTS, EDGES_PER_START = 300_000, 1000
# Dashboards whose membership one number holds.
_SET_BITS = 63


@dataclass(frozen=True)
class Adjacency:
    """Edges bucketed by start, and by salt where there are hubs; how many salts each hub has;
    how many edges there are; whether those into nodes of many edges are marked ``_wide``."""

    edges: DataFrame
    hubs: DataFrame | None
    table: str
    size: int
    wide: bool = False


def _wide_nodes(edges: DataFrame) -> list[str]:
    """Nodes that very many edges lead to, found by a bounded sketch of the most frequent."""
    top = edges.agg(F.expr(f"approx_top_k(dst_node, {WIDE_NODES}, {20 * WIDE_NODES})").alias("top"))
    return [t["item"] for t in top.first()["top"] if t["count"] > WIDE_EDGES]


def adjacency(
    edges: DataFrame, position: Sequence[str], hub_edges: int = HUB_EDGES, mark_wide: bool = False
) -> Adjacency:
    """``edges`` (a ``src_`` and a ``dst_`` column per position) written once for many hops."""
    spark = edges.sparkSession
    starts = [f"src_{p}" for p in position]
    degrees = edges.groupBy(*starts).agg(F.count(F.lit(1)).alias("_degree")).filter(F.col("_degree") > hub_edges)
    # A table of no more edges than that has no hub; stored edges are counted by their footers.
    n_edges = edges.count()
    found = n_edges > hub_edges
    if found:
        size = Observation()
        hubs = stage(
            degrees.select(*starts, F.ceil(F.col("_degree") / hub_edges).cast("int").alias("_salts"))
            .observe(size, F.count(F.lit(1)).alias("rows")),
            "hubs",
        )
        found = size.get["rows"] > 0
    keys = starts[:1]
    if found:
        salt = F.pmod(F.xxhash64(*[f"dst_{p}" for p in position]), F.coalesce("_salts", F.lit(1))).cast("int")
        edges = edges.join(hubs, starts, "left").withColumn("_salt", salt).drop("_salts")
        keys = [*starts, "_salt"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"edges_{uuid.uuid4().hex}"
    wide = _wide_nodes(edges) if mark_wide else []
    if wide:
        edges = edges.withColumn("_wide", F.coalesce(F.col("dst_node").isin(wide), F.lit(False)))
    writer = edges.repartition(buckets, *keys).write.bucketBy(buckets, *keys)
    writer = writer.partitionBy("_wide") if wide else writer
    writer.option("path", run_path(spark, "edges")).saveAsTable(table)
    return Adjacency(spark.table(table), hubs if found else None, table, n_edges, bool(wide))


def _edges_from(frontier: DataFrame, near: Adjacency, position: Sequence[str]) -> Adjacency:
    """The edges that start where a frontier of few places stands, as a table of their own.

    One look at each edge finds them, where joining them to the frontier would sort them all.
    """
    starts = frontier.select(*[F.col(p).alias(f"src_{p}") for p in position]).distinct()
    taken = near.edges.join(F.broadcast(starts), starts.columns, "left_semi")
    return replace(near, edges=stage(taken.drop("_wide"), "taken"))


def _walk(
    seeds: DataFrame,
    edges: DataFrame,
    search: Sequence[str],
    position: Sequence[str],
    max_hops: int | None,
    jobs: tuple[DataFrame, DataFrame] | None = None,
    hub_edges: int = HUB_EDGES,
) -> DataFrame:
    """Rows (search, position, hop) with the fewest hops; seeds are hop 0."""
    spark = seeds.sparkSession
    state = [*search, *position]
    path, table = run_path(spark, "seen"), f"seen_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Tables that share buckets of the node are joined on more columns without a shuffle.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # Partitions are found by listing, so what was found outlives its catalog entry.
    spark.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")

    def keep(rows: DataFrame, hop: int) -> tuple[int, int]:
        """How many rows were kept, and on about how many places."""
        size = Observation()
        places = F.approx_count_distinct(F.xxhash64(*position)).alias("places")
        counted = rows.observe(size, F.count(F.lit(1)).alias("rows"), places).withColumn("hop", F.lit(hop))
        counted.write.mode("append").partitionBy("hop").bucketBy(buckets, position[0]).option("path", path).saveAsTable(table)
        return size.get["rows"], size.get["places"]

    def once(rows: DataFrame) -> DataFrame:
        """Each row once, where its node lies."""
        return rows.select(*state).repartition(buckets, position[0]).distinct()

    near = adjacency(edges, position, hub_edges, mark_wide=True)
    (left, places), hop = keep(once(seeds), 0), 0
    while left and (max_hops is None or hop < max_hops):
        seen = spark.table(table)
        frontier = seen.filter(F.col("hop") == hop).select(*state)
        known = seen.select(*state)
        if places <= min(FEW_STARTS, near.size // EDGES_PER_START):
            taken = _edges_from(frontier, near, position)
            moved = _advance(frontier, taken, search, position)
            moved = moved.distinct() if near.wide else moved
            if jobs is None:
                # Nothing new can stand elsewhere than where these edges lead.
                ends = taken.edges.select(*[F.col(f"dst_{p}").alias(p) for p in position]).distinct()
                known = known.join(ends, list(position), "left_semi")
        elif near.wide:
            few, many = (replace(near, edges=near.edges.filter(c)) for c in ("NOT _wide", "_wide"))
            moved = _advance(frontier, few, search, position).unionByName(
                _advance(frontier, many, search, position).distinct()
            )
        else:
            moved = _advance(frontier, near, search, position)
        if jobs is not None:
            moved = moved.unionByName(_through_jobs(frontier, jobs, search))
        hop += 1
        left, places = keep(once(moved).join(known, [*position, *search], "left_anti"), hop)
    found = spark.table(table)
    for name in (table, near.table):
        spark.sql(f"DROP TABLE {name}")
    return found


def _search(
    seeds: DataFrame,
    edges: DataFrame,
    search: Sequence[str],
    position: Sequence[str],
    max_hops: int | None,
    jobs: tuple[DataFrame, DataFrame] | None = None,
    hub_edges: int = HUB_EDGES,
) -> DataFrame:
    """Rows (search, position, hop) with the fewest hops, seeds left out."""
    return _walk(seeds, edges, search, position, max_hops, jobs, hub_edges).filter("hop > 0")


def _advance(frontier: DataFrame, near: Adjacency, search: Sequence[str], position: Sequence[str]) -> DataFrame:
    at = frontier.select(*search, *[F.col(p).alias(f"src_{p}") for p in position])
    starts = [f"src_{p}" for p in position]
    keys = starts
    if near.hubs is not None:
        last = F.coalesce("_salts", F.lit(1)) - 1
        at = at.join(near.hubs, starts, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")
        keys = [*starts, "_salt"]
    joined = at.join(near.edges, keys)
    return joined.select(*search, *[F.col(f"dst_{p}").alias(p) for p in position])


def _through_jobs(frontier: DataFrame, jobs: tuple[DataFrame, DataFrame], search: Sequence[str]) -> DataFrame:
    """One hop through jobs without the inlet-by-outlet product of each job.

    The search first moves onto the jobs, where it is made distinct, then on to
    their outlets, so a job costs inlets plus outlets rather than their product.
    """
    inlets, outlets = jobs
    running = frontier.join(inlets, "node").select(*search, "job_id").distinct()
    return running.join(outlets, "job_id").select(*search, "node")


def _node_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("src_node"), F.col("dst").alias("dst_node"))


def downstream_reach(
    seeds: DataFrame,
    edges: DataFrame,
    max_hops: int | None = None,
    search: Sequence[str] = ("change_id",),
    jobs: tuple[DataFrame, DataFrame] | None = None,
    hub_edges: int = HUB_EDGES,
) -> DataFrame:
    """Every node each search reaches along the edges, with its fewest hops.

    ``jobs`` adds (inlets, outlets) tables of ``job_id, node``: a job links each
    of its inlets to each of its outlets.
    """
    return _search(seeds, _node_edges(edges), search, ("node",), max_hops, jobs, hub_edges)


def upstream_reach(
    seeds: DataFrame,
    edges: DataFrame,
    max_hops: int | None = None,
    search: Sequence[str] = ("dashboard",),
    jobs: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Every node that reaches each search's start."""
    swapped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return downstream_reach(seeds, swapped, max_hops, search, None if jobs is None else (jobs[1], jobs[0]))


def column_reach(
    seeds: DataFrame, column_edges: DataFrame, max_hops: int | None = None, search: Sequence[str] = ("change_id",)
) -> DataFrame:
    """Nodes that carry the changed column on, under whatever name it has there."""
    edges = column_edges.select(
        F.col("src").alias("src_node"),
        F.col("src_col").alias("src_column_name"),
        F.col("dst").alias("dst_node"),
        F.col("dst_col").alias("dst_column_name"),
    )
    return _search(seeds, edges, search, ("node", "column_name"), max_hops)


def number(name: Column, salt: int) -> Column:
    """A number for a name, null for null: numbers sort, hash and move for less than names do."""
    return F.when(name.isNotNull(), F.xxhash64(F.lit(salt), name))


def salt_of(names: Sequence[Column], tables: Sequence[DataFrame]) -> int:
    """The first salt for which no two names share a :func:`number`.

    ``names`` are the names in each of ``tables``, as one array. Names are told apart by another
    digest, so all that is grouped is numbers.
    """
    for salt in itertools.count():
        apart = F.hash("name").alias("apart")
        numbered = [
            table.select(F.explode(name).alias("name")).select(number(F.col("name"), salt).alias("number"), apart)
            for name, table in zip(names, tables)
        ]
        every = numbered[0]
        for more in numbered[1:]:
            every = every.unionByName(more)
        spread = every.groupBy("number").agg(F.min("apart").alias("least"), F.max("apart").alias("most"))
        if spread.filter("least < most").isEmpty():
            return salt


def impact_reach(
    changes: DataFrame, edges: DataFrame, column_edges: DataFrame, max_hops: int | None = None,
    whole_table: Column | None = None,
) -> DataFrame:
    """Both searches of an assessment at once: everything downstream, and which of it
    carries the changed column.

    One search over (node, column), where a star stands for the table as a whole,
    needs half the jobs of two searches. A column cycle may lead back to the changed
    table under another name; that row is left for the caller to drop where it knows
    the root anyway. Nodes and columns may be numbers, then ``whole_table`` is the star's.
    """
    star = F.lit(WHOLE_TABLE) if whole_table is None else whole_table
    lineage = lineage_edges(edges, column_edges, star)
    whole = changes.select("change_id", "node", star.alias("column_name"))
    seeds = whole.unionByName(changes.select("change_id", "node", "column_name"))
    hits = _search(seeds, lineage, ("change_id",), ("node", "column_name"), max_hops)
    return hits.groupBy("change_id", "node").agg(
        F.min("hop").alias("hop"), F.max(F.col("column_name") != star).alias("in_column_scope")
    )


def dashboard_sets(dashboards: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Which dashboards each node feeds: (node, block, members), a bit per dashboard.

    Sets flow from the dashboards up the edges. A hop moves only the bits a node gained at
    the hop before and joins them by ``bit_or``, so there is one row per node and block of
    ``_SET_BITS`` dashboards, and no row per dashboard and node. Without a bound on hops it
    does not matter which dashboard a node feeds (whatever reaches the node reaches that
    dashboard too), so all of them are one member.
    """
    boards = dashboards.select("node").distinct()
    if max_hops is None:
        gained = boards.select("node", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("members"))
    else:
        place = F.col("_place") - 1
        gained = number_within(boards, [], [F.col("node")], "_place").select(
            "node", F.floor(place / _SET_BITS).alias("block"),
            F.expr(f"shiftleft(1L, CAST((_place - 1) % {_SET_BITS} AS INT))").alias("members"),
        )
    swapped = edges.select(F.col("dst").alias("src_node"), F.col("src").alias("dst_node"))
    near = adjacency(swapped, ("node",))
    known, hop, left = None, 0, 1
    while left and (max_hops is None or hop < max_hops):
        moved = _advance(gained, near, ("block", "members"), ("node",))
        if max_hops is None:
            # One member: a node gains it once, so what is known already is just left out.
            fresh = moved.distinct()
            fresh = fresh if known is None else fresh.join(known.select("node"), "node", "left_anti")
        else:
            fresh = moved.groupBy("node", "block").agg(F.bit_or("members").alias("members"))
        if known is not None and max_hops is not None:
            held = known.groupBy("node", "block").agg(F.bit_or("members").alias("_held"))
            new = F.col("members").bitwiseAND(F.bitwise_not(F.coalesce("_held", F.lit(0).cast("long"))))
            fresh = fresh.join(held, ["node", "block"], "left").select("node", "block", new.alias("members"))
        size = Observation()
        gained = stage(
            fresh.filter("members <> 0").observe(size, F.count(F.lit(1)).alias("rows")), "gained"
        )
        left, hop = size.get["rows"], hop + 1
        known = gained if known is None else known.unionByName(gained)
    edges.sparkSession.sql(f"DROP TABLE {near.table}")
    if known is None:
        return gained.limit(0)
    return known if max_hops is None else known.groupBy("node", "block").agg(F.bit_or("members").alias("members"))


def dashboard_exposure(reach: DataFrame, changes: DataFrame, sets: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(change, node) pairs that feed a dashboard their change reaches: one test per pair.

    ``sets`` is what :func:`dashboard_sets` returns for the same bound on hops.
    """
    pairs = reach.select("change_id", "node")
    if max_hops is None:
        return pairs.join(sets.select("node").distinct(), "node", "left_semi")
    wanted = changes.join(sets, "node").select("change_id", "block", F.col("members").alias("_wanted"))
    fed = pairs.join(sets, "node").join(wanted, ["change_id", "block"])
    return fed.filter(F.col("members").bitwiseAND(F.col("_wanted")) != 0).select("change_id", "node").distinct()


def lineage_edges(edges: DataFrame, column_edges: DataFrame, star: Column) -> DataFrame:
    """Table and column edges as one table over (node, column)."""
    whole = edges.select(
        F.col("src").alias("src_node"), star.alias("src_column_name"),
        F.col("dst").alias("dst_node"), star.alias("dst_column_name"),
    )
    single = column_edges.select(
        F.col("src").alias("src_node"), F.col("src_col").alias("src_column_name"),
        F.col("dst").alias("dst_node"), F.col("dst_col").alias("dst_column_name"),
    )
    return whole.unionByName(single)


def job_edges(inlets: DataFrame, outlets: DataFrame) -> DataFrame:
    """The dataset edges a job stands for: each inlet to each outlet of the same job."""
    i = inlets.distinct().select("job_id", F.col("node").alias("src"))
    o = outlets.distinct().select("job_id", F.col("node").alias("dst"))
    return i.join(o, "job_id").select("src", "dst", F.lit("job").alias("kind")).distinct()


def dashboards_reached(reach: DataFrame, assets: DataFrame) -> DataFrame:
    """All dashboards a change reaches."""
    boards = assets.filter(F.col("type") == "DASHBOARD").select("node").distinct()
    return reach.join(boards, "node", "left_semi").select("change_id", F.col("node").alias("dashboard"))


def exclude_root(reach: DataFrame, changes: DataFrame) -> DataFrame:
    return reach.join(changes.select("change_id", "node"), ["change_id", "node"], "left_anti")


def deepest_hop(changes: DataFrame, reach: DataFrame) -> DataFrame:
    """Largest hop over everything a change reached, 0 if nothing."""
    deepest = reach.groupBy("change_id").agg(F.max("hop").alias("deepest_hop"))
    return changes.select("change_id").join(deepest, "change_id", "left").fillna(0, ["deepest_hop"])


def scan_budgets(
    changes: DataFrame, scanned: DataFrame, change_dashboards: DataFrame, budget: int = DEFAULT_BUDGET
) -> DataFrame:
    """What a call budget allows each change, those it leaves nothing to included.

    Two calls go to lineage, one to each dashboard, one to each asset.
    """
    boards = change_dashboards.groupBy("change_id").agg(F.count(F.lit(1)).alias("n_dashboards"))
    totals = scanned.groupBy("change_id").agg(F.count(F.lit(1)).alias("n_assets"))
    counted = changes.select("change_id").distinct().join(totals, "change_id", "left").join(boards, "change_id", "left")
    allowed = F.greatest(F.lit(0).cast("long"), F.lit(budget - 2) - F.col("n_dashboards"))
    return counted.fillna(0, ["n_assets", "n_dashboards"]).select(
        "change_id", "n_assets", "n_dashboards", allowed.alias("allowed"),
        F.least(allowed, F.col("n_assets")).alias("n_scanned"), (F.col("n_assets") > allowed).alias("truncated"),
    )


def bounded_scan(scanned: DataFrame, change_dashboards: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """The assets a call budget allows per change, nearest first, and whether any were left.

    The first filter has a literal bound, so each map task keeps at most that many rows
    per change and a hot change is cut before the shuffle. A change whose dashboards use
    the budget up has no rows here; :func:`scan_budgets` has a row for every change.
    """
    limits = scan_budgets(scanned, scanned, change_dashboards, budget).select("change_id", "allowed", "n_assets")
    nearest = Window.partitionBy("change_id").orderBy("hop", "node")
    first = scanned.withColumn("scan_rank", F.row_number().over(nearest)).filter(F.col("scan_rank") <= budget - 2)
    return (
        first.join(limits, "change_id")
        .filter(F.col("scan_rank") <= F.col("allowed"))
        .withColumn("truncated", F.col("n_assets") > F.col("allowed"))
        .drop("allowed", "n_assets")
    )


def is_dataset(column: str = "type") -> Column:
    return F.col(column) == "DATASET"
