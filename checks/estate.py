"""The fixtures in the shape the plans take, and the same relations as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.fixtures import Inputs
from faultline.functions import names, text
from faultline.plans.assessment import Estate
from faultline.session import stage_all


def _owners() -> Column:
    def owner(column: str, kind: str) -> Column:
        return F.when(
            F.col(column).isNotNull(), F.struct(F.struct(F.col(column).alias("urn")).alias("owner"), F.lit(kind).alias("type"))
        )

    return F.array_compact(F.array(owner("technical_owner", "TECHNICAL_OWNER"), owner("business_owner", "BUSINESS_OWNER")))


def _entity(urn: str, with_path: bool) -> Column:
    prop = F.struct(F.lit(names.FILE_PATH_PROPERTY).alias("key"), F.col("file_path").alias("value"))
    properties = F.when(F.lit(with_path) & F.col("file_path").isNotNull(), F.array(prop))
    return F.struct(
        F.col(urn).alias("urn"), F.col("type"),
        F.concat(F.lit("" if with_path else "public."), F.col("node")).alias("name"),
        F.struct(properties.alias("customProperties")).alias("properties"),
        F.struct(_owners().alias("owners")).alias("ownership"),
    )


def entities(i: Inputs) -> DataFrame:
    """One catalog record per physical and per logical entity."""
    sides = F.array_compact(F.array(
        F.when(F.col("physical_urn").isNotNull(), _entity("physical_urn", False)),
        F.when(F.col("logical_urn").isNotNull(), _entity("logical_urn", True)),
    ))
    return i.assets.select("node", F.explode(sides).alias("entity"))


def asset_corpus(i: Inputs) -> DataFrame:
    compiled = text.compile_template(F.col("source_text"), "public")
    return i.asset_models.select(
        "path", "source_text", F.when(F.col("is_compiled"), compiled).alias("compiled_text")
    )


def part_corpus(i: Inputs) -> DataFrame:
    """Model texts of the parts; those of one brand were never compiled."""
    corpus = i.corpus
    compiled = text.compile_template(F.col("source_text"), "public")
    return corpus.select(
        "model", "path", "source_text",
        F.when(~F.contains("source_text", F.lit("of red ")), compiled).alias("compiled_text"),
    )


def estate(i: Inputs) -> Estate:
    """Derived edges and texts are written once, as a catalog would hold them.

    Texts are small on disk and dear to scan, so they are kept in a file per task.
    """
    tasks = int(i.spark.conf.get("spark.sql.shuffle.partitions"))
    stored = stage_all({
        "changes": i.changes, "edges": i.edges, "column_edges": i.column_edges, "entities": entities(i),
        "corpus": asset_corpus(i).repartition(tasks, "path"),
    })
    return Estate(usage_log=i.usage_log, **stored)


# --- the same in SQL -----------------------------------------------------------


# No chain of edges in the fixtures is longer, so a search this deep is one without a bound.
LONGEST = 8


def hops_sql(prefix: str, seeds: str, edges: str, on: str, state: str, moved: str, hops: int = LONGEST) -> dict[str, str]:
    """CTEs ``prefix_1 .. prefix_n`` of an n-hop search."""
    ctes, source = {}, seeds
    for hop in range(1, hops + 1):
        ctes[f"{prefix}_{hop}"] = f"SELECT DISTINCT {moved} FROM {source} f JOIN {edges} e ON {on}"
        source = f"{prefix}_{hop}"
    union = " UNION ALL ".join(f"SELECT *, {h} AS hop FROM {prefix}_{h}" for h in range(1, hops + 1))
    ctes[f"{prefix}_all"] = f"SELECT {state}, CAST(min(hop) AS BIGINT) AS hop FROM ({union}) u GROUP BY {state}"
    return ctes


BROAD = hops_sql("broad", "fx_changes", "fx_edges", "f.node = e.src", "change_id, node", "f.change_id, e.dst AS node")
COLUMNS = hops_sql(
    "cols", "fx_changes", "fx_column_edges", "f.node = e.src AND f.column_name = e.src_col",
    "change_id, node", "f.change_id, e.dst AS node, e.dst_col AS column_name",
)
COLUMN_HITS = " UNION ALL ".join(f"SELECT *, {hop} AS hop FROM cols_{hop}" for hop in range(1, LONGEST + 1))


def exposure_sql(hops: int) -> dict[str, str]:
    """The pairs of a bounded search, by way of every dashboard's own upstream search."""
    return {
        **hops_sql("near", "fx_changes", "fx_edges", "f.node = e.src", "change_id, node", "f.change_id, e.dst AS node", hops),
        "near_boards": "SELECT change_id, b.node AS dashboard FROM near_all b JOIN fx_assets a ON a.node = b.node WHERE a.type = 'DASHBOARD'",
        "near_seeds": "SELECT DISTINCT dashboard, dashboard AS node FROM near_boards",
        **hops_sql("nups", "near_seeds", "fx_edges", "f.node = e.dst", "dashboard, node", "f.dashboard, e.src AS node", hops),
        "near_exposed": "SELECT DISTINCT b.change_id, b.node FROM near_all b JOIN nups_all u ON u.node = b.node "
                        "JOIN near_boards d ON d.change_id = b.change_id AND d.dashboard = u.dashboard",
    }


DASHBOARDS = {
    **BROAD,
    "boards": "SELECT change_id, b.node AS dashboard FROM broad_all b JOIN fx_assets a ON a.node = b.node "
              "WHERE a.type = 'DASHBOARD'",
}
UPSTREAM = {
    **DASHBOARDS,
    "board_seeds": "SELECT DISTINCT dashboard, dashboard AS node FROM boards",
    **hops_sql("ups", "board_seeds", "fx_edges", "f.node = e.dst", "dashboard, node", "f.dashboard, e.src AS node"),
}
EXPOSED = {
    **UPSTREAM,
    "exposed": "SELECT DISTINCT b.change_id, b.node FROM broad_all b JOIN ups_all u ON u.node = b.node "
               "JOIN boards d ON d.change_id = b.change_id AND d.dashboard = u.dashboard",
}

# Lines of a model text, numbered, for evidence.
LINES = "unnest(string_split({t}, chr(10))) AS line, generate_subscripts(string_split({t}, chr(10)), 1) AS number"
COMPILED = (
    "regexp_replace(regexp_replace({t}, '\\{{\\{{\\s*source\\(''([^'']+)'', ''([^'']+)''\\)\\s*\\}}\\}}', "
    "'\"\\1\".\"\\2\"', 'g'), '\\{{\\{{\\s*ref\\(''([^'']+)''\\)\\s*\\}}\\}}', '\"public\".\"\\1\"', 'g')"
)

ASSESSMENT = {
    **EXPOSED,
    **COLUMNS,
    "usage_counts": "SELECT node, count(*) AS usage_count FROM fx_usage_log GROUP BY node",
    "models": f"SELECT path, source_text, CASE WHEN is_compiled THEN {COMPILED.format(t='source_text')} END AS compiled_text "
              "FROM fx_asset_models",
    "model_reads": "SELECT path, regexp_extract(compiled_text, 'from \"public\".\"([^\"]+)\"', 1) AS table_name "
                   "FROM models WHERE compiled_text IS NOT NULL",
    "star_lines": f"""
        SELECT path, string_agg(path || ':' || CAST(number AS STRING) || ': ' || trim(line), '; ' ORDER BY number) AS star_evidence
        FROM (SELECT path, {LINES.format(t='source_text')} FROM models WHERE compiled_text IS NOT NULL) l
        WHERE line NOT LIKE '--%' AND (regexp_matches(line, '[a-z]+\\.\\*') OR line LIKE 'select *%') GROUP BY path""",
    "scan": """
        SELECT b.change_id, b.node, c.node AS root, c.column_name, c.change_type, c.new_column,
               least(b.hop, coalesce(k.hop, b.hop)) AS hop, k.node IS NOT NULL AS in_column_scope,
               x.node IS NOT NULL AS is_dashboard_exposed,
               coalesce(a.physical_urn, a.logical_urn) AS urn, a.file_path,
               a.technical_owner, a.business_owner,
               concat_ws('; ', a.technical_owner, a.business_owner) AS owners,
               a.business_owner IS NOT NULL AS has_business_owner,
               coalesce(u.usage_count, 0) AS usage_count,
               m.compiled_text IS NOT NULL AS is_readable,
               coalesce(r.table_name = c.node, false) AS reads_changed,
               s.path IS NOT NULL AS select_star_exposure,
               CASE WHEN m.path IS NOT NULL AND m.compiled_text IS NULL
                    THEN m.path || ': no readable compiled text, stars could not be checked'
                    ELSE s.star_evidence END AS star_evidence, m.source_text
        FROM broad_all b JOIN fx_changes c ON c.change_id = b.change_id
        JOIN fx_assets a ON a.node = b.node AND a.type = 'DATASET'
        LEFT JOIN cols_all k ON k.change_id = b.change_id AND k.node = b.node
        LEFT JOIN exposed x ON x.change_id = b.change_id AND x.node = b.node
        LEFT JOIN usage_counts u ON u.node = b.node
        LEFT JOIN models m ON m.path = a.file_path
        LEFT JOIN model_reads r ON r.path = a.file_path
        LEFT JOIN star_lines s ON s.path = a.file_path""",
    "status_rows": """
        SELECT *, CASE WHEN NOT in_column_scope THEN 'NOT_IMPACTED'
                       WHEN file_path IS NOT NULL AND is_readable AND reads_changed THEN 'ORIGIN_HARD_BREAK'
                       ELSE 'CASCADE_HARD_BREAK' END AS compile_status FROM scan""",
    "origin_lines": f"""
        SELECT change_id, node, string_agg(file_path || ':' || CAST(number AS STRING) || ': ' || trim(line), '; ' ORDER BY number) AS lines
        FROM (SELECT change_id, node, file_path, column_name, {LINES.format(t='source_text')}
              FROM status_rows WHERE compile_status = 'ORIGIN_HARD_BREAK') l
        WHERE line NOT LIKE '--%' AND regexp_matches(line, '(?i)\\b' || column_name || '\\b') GROUP BY change_id, node""",
    "mode_rows": """
        SELECT s.*, CASE WHEN compile_status <> 'NOT_IMPACTED' THEN 'HARD_BREAK'
                       WHEN select_star_exposure THEN 'SILENT_CORRUPTION' ELSE 'UNAFFECTED' END AS break_mode,
               concat_ws('; ', CASE WHEN compile_status = 'NOT_IMPACTED' THEN NULL
                     WHEN file_path IS NULL THEN 'no model file known, in scope by column lineage alone'
                     WHEN NOT is_readable THEN file_path || ': compiled text not readable, origin not confirmed'
                     WHEN compile_status = 'ORIGIN_HARD_BREAK' THEN o.lines
                     ELSE file_path || ': reads public.' || root || ' only through an upstream model' END,
                   star_evidence) AS evidence
        FROM status_rows s LEFT JOIN origin_lines o ON o.change_id = s.change_id AND o.node = s.node""",
    "assessed": """
        SELECT *, round(CASE break_mode WHEN 'HARD_BREAK' THEN 10.0 WHEN 'SILENT_CORRUPTION' THEN 6.0 ELSE 0.0 END
                        * (1.0 + CAST(usage_count AS DOUBLE) / 10.0)
                        * CASE WHEN is_dashboard_exposed THEN 2.0 ELSE 1.0 END
                        * CASE WHEN has_business_owner THEN 2.0 ELSE 1.0 END, 2)::DOUBLE AS severity_score
        FROM mode_rows""",
}

SUMMARY = {
    **ASSESSMENT,
    "owner_counts": """
        SELECT change_id, count(DISTINCT owner) AS distinct_owners FROM (
            SELECT change_id, technical_owner AS owner FROM assessed WHERE break_mode <> 'UNAFFECTED'
            UNION ALL SELECT change_id, business_owner FROM assessed WHERE break_mode <> 'UNAFFECTED') o
        GROUP BY change_id""",
    "counted": """
        SELECT change_id, count(*) AS scanned, count(*) FILTER (break_mode <> 'UNAFFECTED') AS affected,
               count(*) FILTER (break_mode = 'HARD_BREAK') AS hard_breaks,
               count(*) FILTER (break_mode = 'SILENT_CORRUPTION') AS silent_risks,
               count(*) FILTER (break_mode = 'UNAFFECTED') AS safe,
               count(*) FILTER (in_column_scope) AS n_column_scope, max(hop) AS deepest_hop,
               max(hop) FILTER (break_mode <> 'UNAFFECTED') AS affected_deepest_hop,
               count(*) FILTER (break_mode <> 'UNAFFECTED' AND is_dashboard_exposed) AS exposed_affected
        FROM assessed GROUP BY change_id""",
    "summary": """
        SELECT c.change_id, c.node AS root, c.column_name, c.change_type, c.new_column,
               coalesce(scanned, 0) AS scanned, coalesce(affected, 0) AS affected,
               coalesce(hard_breaks, 0) AS hard_breaks, coalesce(silent_risks, 0) AS silent_risks,
               coalesce(safe, 0) AS safe, coalesce(n_column_scope, 0) AS n_column_scope,
               coalesce(deepest_hop, 0) AS deepest_hop, coalesce(affected_deepest_hop, 0) AS affected_deepest_hop,
               coalesce(exposed_affected, 0) AS exposed_affected, coalesce(distinct_owners, 0) AS distinct_owners
        FROM fx_changes c LEFT JOIN counted n ON n.change_id = c.change_id
        LEFT JOIN owner_counts o ON o.change_id = c.change_id""",
}

DECISIONS = {
    **SUMMARY,
    "typed": """
        SELECT *, CASE WHEN affected = 0 THEN 'NO_MIGRATION_NEEDED'
                       WHEN change_type IN ('add_column', 'widen_type') THEN 'ADDITIVE' ELSE 'BREAKING' END AS decision_type,
               hard_breaks > 5 AS many, affected_deepest_hop >= 4 AS deep
        FROM summary""",
    "decided": """
        SELECT *, CASE WHEN decision_type = 'BREAKING' THEN
                       CASE WHEN many OR deep THEN 'C' WHEN exposed_affected > 0 THEN 'B' ELSE 'A' END
                  END AS recommended_strategy FROM typed""",
}
