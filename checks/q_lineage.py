"""Lineage payloads, names, reachability and sibling entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import estate as e
from checks.registry import query
from faultline.functions import names
from faultline.operators import graph, siblings, verify
from faultline.operators import drift
from faultline.plans import assessment
from faultline.session import run_path, stage
from faultline.sources import files


def payload_hits(i):
    """A lineage response per change as nested JSON files, read back and flattened."""
    broad = graph.downstream_reach(i.changes, stage(i.edges, "edges"))
    hits = broad.join(e.entities(i), "node").select(
        "change_id", F.struct("entity", F.col("hop").alias("degree")).alias("hit")
    )
    # A response is one page of hits; pages of one hit need no change to be gathered.
    page = F.struct(F.lit(1).cast("long").alias("total"), F.array("hit").alias("searchResults"))
    responses = hits.select("change_id", page.alias("downstreams"))
    path = run_path(i.spark, "lineage")
    files.write_lineage(responses, path)
    return files.lineage_hits(files.read_lineage(i.spark, path))


HITS = {
    **e.BROAD,
    "hits": "SELECT b.change_id, b.node, b.hop, a.type, u.urn, u.platform, a.file_path FROM broad_all b "
            "JOIN fx_assets a ON a.node = b.node JOIN (SELECT node, physical_urn AS urn, 'physical' AS platform FROM fx_assets "
            "UNION ALL SELECT node, logical_urn, 'logical' FROM fx_assets) u ON u.node = b.node AND u.urn IS NOT NULL",
}


@query("lineage_flatten", "SELECT change_id, urn, hop AS degree FROM hits WHERE type = 'DATASET'", HITS)
def lineage_flatten(i):
    rows = files.lineage_datasets(payload_hits(i))
    return rows.select("change_id", F.col("entity.urn").alias("urn"), "degree")


@query("dashboard_lookup", "SELECT change_id, dashboard FROM boards", e.DASHBOARDS)
def dashboard_lookup(i):
    return graph.dashboards_reached(graph.downstream_reach(i.changes, stage(i.edges, "edges")), i.assets)


@query("bare_table_name", """
SELECT DISTINCT 'warehouse.public.' || node AS name, node AS bare FROM fx_assets
UNION SELECT DISTINCT node, node FROM fx_assets""")
def bare_table_name(i):
    qualified = i.assets.select(F.concat(F.lit("warehouse.public."), "node").alias("name"))
    rows = qualified.unionByName(i.assets.select(F.col("node").alias("name"))).distinct()
    return rows.select("name", names.bare_name(F.col("name")).alias("bare"))


@query("urn_parse", """
SELECT urn, CASE WHEN contains(urn, 'dataPlatform:dbt') THEN 'dbt' WHEN contains(urn, 'dataPlatform:postgres') THEN 'postgres'
                 ELSE 'other' END AS platform,
       CASE WHEN urn LIKE 'urn:li:dataset:%' THEN split_part(urn, ',', 2) ELSE '' END AS qualified_name, true AS rebuilt
FROM (SELECT physical_urn AS urn FROM fx_assets UNION ALL SELECT logical_urn FROM fx_assets) u WHERE urn IS NOT NULL""")
def urn_parse(i):
    rows = e.entities(i).select(F.col("entity.urn").alias("urn"))
    platform, name = names.platform_of(F.col("urn")), names.qualified_name(F.col("urn"))
    rebuilt = (name == "") | (names.dataset_urn(platform, name, F.lit("PROD")) == F.col("urn"))
    return rows.select("urn", platform.alias("platform"), name.alias("qualified_name"), rebuilt.alias("rebuilt"))


@query("resolve_urn", """
SELECT node AS request_id, CASE WHEN wanted = 'postgres' THEN physical_urn ELSE logical_urn END AS urn,
       (CASE WHEN wanted = 'postgres' THEN physical_urn ELSE logical_urn END) IS NOT NULL AS resolved
FROM (SELECT *, CASE WHEN layer = 'marts' THEN 'dbt' ELSE 'postgres' END AS wanted FROM fx_assets WHERE type = 'DATASET') a""")
def resolve_urn(i):
    datasets = i.assets.filter(graph.is_dataset())
    requests = datasets.select(
        F.col("node").alias("request_id"), F.col("node").alias("table_name"), F.lit("public").alias("schema_name"),
        F.when(F.col("layer") == "marts", "dbt").otherwise("postgres").alias("platform"),
    )
    # A search also returns a same-named table of another schema, ranked first.
    hits = e.entities(i).select(F.col("node").alias("request_id"), F.col("entity.urn").alias("urn"))
    hits = hits.withColumn("search_rank", F.lit(2)).unionByName(
        hits.select("request_id", F.replace("urn", F.lit(".public."), F.lit(".archive.")).alias("urn"),
                    F.lit(1).alias("search_rank")).filter(F.contains("urn", F.lit(".archive.")))
    )
    return siblings.resolve_urn(requests, hits)


@query("downstream_reach", "SELECT change_id, node, hop FROM broad_all", e.BROAD)
def downstream_reach(i):
    return graph.downstream_reach(i.changes, stage(i.edges, "edges"))


@query("downstream_reach_3_hops", "SELECT change_id, node, hop FROM near_all", e.exposure_sql(3))
def downstream_reach_3_hops(i):
    return graph.downstream_reach(i.changes, stage(i.edges, "edges"), max_hops=3)


@query("downstream_reach_split_hubs", "SELECT change_id, node, hop FROM broad_all", e.BROAD)
def downstream_reach_split_hubs(i):
    """The same search with every node of more than a few edges dealt over salts."""
    return graph.downstream_reach(i.changes, stage(i.edges, "edges"), hub_edges=20)


@query("downstream_reach_unbounded", """
SELECT * FROM (WITH RECURSIVE walk AS (
    SELECT change_id, node, 0 AS hop FROM fx_changes
    UNION
    SELECT w.change_id, e.dst, w.hop + 1 FROM walk w JOIN fx_edges e ON e.src = w.node WHERE w.hop < 30
)
SELECT w.change_id, w.node, CAST(min(w.hop) AS BIGINT) AS hop FROM walk w
JOIN fx_changes c USING (change_id) WHERE w.hop > 0 AND w.node <> c.node GROUP BY ALL)""")
def downstream_reach_unbounded(i):
    return graph.downstream_reach(i.changes, stage(i.edges, "edges"), max_hops=None)


@query("downstream_reach_jobs", "SELECT change_id, node, hop FROM broad_all", e.BROAD)
def downstream_reach_jobs(i):
    """The same search with supplier edges given as jobs instead of edges."""
    models = i.edges.filter(~F.startswith("src", F.lit("supplier_")))
    return graph.downstream_reach(i.changes, stage(models, "edges"), jobs=(stage(i.job_inlets, "inlets"), stage(i.job_outlets, "outlets")))


@query("column_reach", f"SELECT change_id, node, column_name, CAST(min(hop) AS BIGINT) AS hop FROM ({e.COLUMN_HITS}) GROUP BY ALL",
       e.COLUMNS)
def column_reach(i):
    return graph.column_reach(i.changes, stage(i.column_edges, "column_edges"))


@query("upstream_reach", "SELECT dashboard, node, hop FROM ups_all", e.UPSTREAM)
def upstream_reach(i):
    boards = i.assets.filter(F.col("type") == "DASHBOARD")
    seeds = boards.select(F.col("node").alias("dashboard"), "node")
    return graph.upstream_reach(seeds, stage(i.edges, "edges"))


@query("dashboard_exposure", "SELECT change_id, node FROM exposed", e.EXPOSED)
def dashboard_exposure(i):
    return assessment.reach(e.estate(i)).exposed


@query("dashboard_exposure_3_hops", "SELECT change_id, node FROM near_exposed", e.exposure_sql(3))
def dashboard_exposure_3_hops(i):
    return assessment.reach(e.estate(i), max_hops=3).exposed


@query("unassessed_assets", "SELECT change_id, node, hop FROM broad_all WHERE node NOT IN (SELECT node FROM fx_assets)", e.BROAD)
def unassessed_assets(i):
    rich = e.estate(i)
    return assessment.unassessed(rich, assessment.reach(rich))


@query("exclude_root", "SELECT change_id, node, hop FROM broad_all UNION ALL SELECT change_id, dst, 9 FROM fx_changes "
       "JOIN fx_edges ON node = src WHERE kind = 'model' ORDER BY change_id, node, hop", e.BROAD)
def exclude_root(i):
    reach = graph.downstream_reach(i.changes, stage(i.edges, "edges"))
    back = i.changes.join(i.edges.filter("kind = 'model'"), F.col("node") == F.col("src")).select(
        "change_id", F.explode(F.array("src", "dst")).alias("node"), F.lit(9).alias("hop")
    )
    return graph.exclude_root(reach.unionByName(back), i.changes)


@query("custom_property", "SELECT logical_urn AS urn, file_path FROM fx_assets WHERE logical_urn IS NOT NULL "
       "UNION ALL SELECT physical_urn, NULL FROM fx_assets WHERE physical_urn IS NOT NULL")
def custom_property(i):
    properties = F.col("entity.properties.customProperties")
    return e.entities(i).select(
        F.col("entity.urn").alias("urn"), names.custom_property(properties, names.FILE_PATH_PROPERTY).alias("file_path")
    )


@query("deepest_hop", "SELECT c.change_id, coalesce(max(hop), 0) AS deepest_hop FROM fx_changes c "
       "LEFT JOIN broad_all b ON b.change_id = c.change_id GROUP BY 1", e.BROAD)
def deepest_hop(i):
    return graph.deepest_hop(i.changes, graph.downstream_reach(i.changes, stage(i.edges, "edges")))


@query("sibling_merge", "SELECT change_id, node, hop, max(CASE WHEN platform = 'physical' THEN urn END) AS physical_urn, "
       "max(CASE WHEN platform = 'logical' THEN urn END) AS logical_urn FROM hits WHERE type = 'DATASET' GROUP BY ALL", HITS)
def sibling_merge(i):
    hits = payload_hits(i).withColumn("node", names.bare_name(F.col("entity.name")))
    # URNs are the first field of an entity, and all that is read of it here.
    return siblings.merge_siblings(hits, first_fields=1).select(
        "change_id", "node", "hop", F.col("physical.urn").alias("physical_urn"), F.col("logical.urn").alias("logical_urn")
    )


@query("sibling_coalesce", "SELECT node, coalesce(physical_urn, logical_urn) AS urn, "
       "concat_ws('; ', technical_owner, business_owner) AS owners, business_owner IS NOT NULL AS has_business_owner, "
       "file_path FROM fx_assets WHERE type = 'DATASET'")
def sibling_coalesce(i):
    rows = e.entities(i).withColumn("degree", F.lit(1))
    return siblings.coalesce_siblings(siblings.merge_siblings(rows, keys=())).drop("hop")


@query("bounded_scan", """
SELECT change_id, node, hop, scan_rank, n_assets > allowed AS truncated FROM (
    SELECT s.change_id, s.node, s.hop, row_number() OVER (PARTITION BY s.change_id ORDER BY s.hop, s.node) AS scan_rank,
           count(*) OVER (PARTITION BY s.change_id) AS n_assets,
           greatest(0, 28 - coalesce(d.n, 0)) AS allowed
    FROM broad_all s JOIN fx_assets a ON a.node = s.node AND a.type = 'DATASET'
    LEFT JOIN (SELECT change_id, count(*) AS n FROM boards GROUP BY 1) d ON d.change_id = s.change_id) r
WHERE scan_rank <= allowed""", e.DASHBOARDS)
def bounded_scan(i):
    reach = graph.downstream_reach(i.changes, stage(i.edges, "edges"))
    datasets = i.assets.filter(graph.is_dataset()).select("node")
    scanned = reach.join(datasets, "node", "left_semi").select("change_id", "node", "hop")
    return graph.bounded_scan(scanned, graph.dashboards_reached(reach, i.assets))


@query("scan_budgets", """
SELECT c.change_id, coalesce(s.n, 0) AS n_assets, coalesce(d.n, 0) AS n_dashboards, greatest(0, 28 - coalesce(d.n, 0)) AS allowed,
       least(coalesce(s.n, 0), greatest(0, 28 - coalesce(d.n, 0))) AS n_scanned, coalesce(s.n, 0) > greatest(0, 28 - coalesce(d.n, 0)) AS truncated
FROM fx_changes c
LEFT JOIN (SELECT change_id, count(*) AS n FROM broad_all b JOIN fx_assets a ON a.node = b.node AND a.type = 'DATASET' GROUP BY 1) s ON s.change_id = c.change_id
LEFT JOIN (SELECT change_id, count(*) AS n FROM boards GROUP BY 1) d ON d.change_id = c.change_id""", e.DASHBOARDS)
def scan_budgets(i):
    reach = graph.downstream_reach(i.changes, stage(i.edges, "edges"))
    scanned = reach.join(i.assets.filter(graph.is_dataset()).select("node"), "node", "left_semi")
    return graph.scan_budgets(i.changes, scanned, graph.dashboards_reached(reach, i.assets))


@query("job_edges", "SELECT DISTINCT i.node AS src, o.node AS dst, 'job' AS kind FROM fx_job_inlets i "
       "JOIN fx_job_outlets o ON o.job_id = i.job_id")
def job_edges(i):
    return graph.job_edges(i.job_inlets, i.job_outlets)


@query("edges_from_sql", """
SELECT DISTINCT 'part_' || CAST(p_partkey + p_size AS STRING) AS src, 'part_' || CAST(p_partkey AS STRING) AS dst, 'model' AS kind FROM part
UNION SELECT DISTINCT 'raw.raw_parts_' || CAST(p_size AS STRING), 'part_' || CAST(p_partkey AS STRING), 'model' FROM part""")
def edges_from_sql(i):
    return verify.edges_from_sql(i.corpus)


@query("schema_filter", "SELECT DISTINCT table_name FROM fx_snapshot_fields WHERE schema_name = 'public'")
def schema_filter(i):
    return drift.schema_filter(i.snapshot_fields, "^public$").select("table_name").distinct()
