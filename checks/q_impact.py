"""Classification, usage, severity, decisions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import estate as e
from checks.registry import query
from faultline.operators import classify, decision, narrative, patch, report, severity, usage
from faultline.plans import assessment as plan
from faultline.plans import migration, warehouse
from faultline.session import run_path, stage
from faultline.sources import files

ROW = ("change_id, node, urn, hop, in_column_scope, is_dashboard_exposed, owners, has_business_owner, "
       "file_path, compile_status, select_star_exposure, break_mode, evidence, usage_count, severity_score")


def assessed(i):
    return plan.assess(e.estate(i))


def measured(i, *columns):
    """Rows of the assessment with columns that do not name what was changed."""
    return plan.measure(e.estate(i), columns)


def decided(i):
    rich = e.estate(i)
    return plan.decide(rich, stage(plan.measure(rich), "assessment"))


# --- classification ------------------------------------------------------------


# Ordered at the end: the other engine never returns from a LIMIT put around these joins alone.
ASSESSED = f"SELECT {ROW} FROM assessed ORDER BY change_id, node"


@query("assess_changes", ASSESSED, e.ASSESSMENT)
def assess_changes(i):
    return assessed(i).select(*ROW.split(", "))


@query("compile_status", "SELECT change_id, node, compile_status FROM status_rows", e.ASSESSMENT)
def compile_status(i):
    return measured(i, "change_id", "node", "compile_status")


@query("break_mode", "SELECT break_mode, compile_status, select_star_exposure, count(*) AS n_rows FROM assessed GROUP BY ALL",
       e.ASSESSMENT)
def break_mode(i):
    rows = measured(i, "break_mode", "compile_status", "select_star_exposure")
    return rows.groupBy("break_mode", "compile_status", "select_star_exposure").agg(F.count(F.lit(1)).alias("n_rows"))


@query("affected_assets", "SELECT change_id, node, break_mode FROM assessed WHERE break_mode <> 'UNAFFECTED' "
       "ORDER BY change_id, node", e.ASSESSMENT)
def affected_assets(i):
    return classify.affected(measured(i, "change_id", "node", "break_mode"))


@query("assessment_export", ASSESSED, e.ASSESSMENT)
def assessment_export(i):
    rich = e.estate(i)
    rows = stage(plan.assess(rich), "assessment").select(*ROW.split(", "))
    path = run_path(i.spark, "export")
    files.export_assessment(plan.summarize(rich, rows), rows, path)
    return i.spark.read.schema(rows.schema).json(f"{path}/assets")


# --- usage, owners, metadata ---------------------------------------------------

# Names as they turn up in texts themselves: the third word of every statement, in order of name.
WORDS = """SELECT row_number() OVER (ORDER BY name) AS priority, name AS table_name
FROM (SELECT DISTINCT split_part(statement, ' ', 3) AS name FROM fx_statements) n WHERE length(name) > 2"""
KNOWN = ["thor", "eaux", "ring", "ation", "email", "licen", "der", "que", "the"]
# The last nine names first tried are preceded here by names no text holds.
MANY = [f"absent_table_{n}" for n in range(80)] + KNOWN
ATTRIBUTION = "CASE " + " ".join(f"WHEN contains(statement, '{k}') THEN '{k}'" for k in KNOWN) + " ELSE 'fct_orders' END"


@query("usage_attribution", f"SELECT statement_id, {ATTRIBUTION} AS target FROM fx_statements")
def usage_attribution(i):
    return usage.attribute_statements(i.statements, KNOWN).select("statement_id", "target")


@query("usage_attribution_long_list", f"SELECT statement_id, {ATTRIBUTION} AS target FROM fx_statements")
def usage_attribution_long_list(i):
    return usage.attribute_statements(i.statements, MANY).select("statement_id", "target")


@query("usage_attribution_many_names", """
SELECT s.statement_id, coalesce(arg_min(w.table_name, w.priority), 'fct_orders') AS target
FROM fx_statements s LEFT JOIN words w ON contains(s.statement, w.table_name) GROUP BY s.statement_id""", {"words": WORDS})
def usage_attribution_many_names(i):
    """Every third word of all statements as a name, least name first."""
    word = F.split_part("statement", F.lit(" "), F.lit(3))
    names = i.statements.select(word.alias("table_name")).filter(F.length("table_name") > 2).distinct()
    return usage.attribute_statements(i.statements, names.withColumn("priority", F.col("table_name"))).select("statement_id", "target")


@query("query_fingerprint", "SELECT substr(sha256(statement), 1, 16) AS fingerprint, min(statement_id) AS statement_id, "
       "count(*) AS copies FROM fx_statements GROUP BY 1")
def query_fingerprint(i):
    return usage.distinct_statements(i.statements)


@query("usage_count", "SELECT a.node, count(u.query_id) AS usage_count FROM fx_assets a "
       "LEFT JOIN fx_usage_log u ON u.node = a.node GROUP BY 1")
def usage_count(i):
    return usage.usage_count(i.assets, i.usage_log)


@query("usage_stats", "SELECT node, CAST(CAST(ts AS DATE) AS VARCHAR) AS usage_date, count(*) AS total_queries, "
       "count(DISTINCT actor) AS unique_users FROM fx_usage_log GROUP BY 1, 2")
def usage_stats(i):
    return usage.usage_stats(i.usage_log)


@query("usage_per_user", "SELECT node, CAST(CAST(ts AS DATE) AS VARCHAR) AS usage_date, actor, count(*) AS n_queries "
       "FROM fx_usage_log GROUP BY 1, 2, 3")
def usage_per_user(i):
    return usage.usage_per_user(i.usage_log)


@query("usage_window_30d", "SELECT node, count(*) AS recent_queries FROM fx_usage_log "
       "WHERE ts > (SELECT max(ts) FROM fx_usage_log) - INTERVAL 30 DAY GROUP BY 1")
def usage_window_30d(i):
    return usage.usage_window(i.usage_log)


@query("usage_sliding_30d", "SELECT node, CAST(usage_date AS VARCHAR) AS usage_date, CAST(sum(n) OVER (PARTITION BY node ORDER BY usage_date "
       "RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_queries "
       "FROM (SELECT node, CAST(ts AS DATE) AS usage_date, count(*) AS n FROM fx_usage_log GROUP BY 1, 2) d")
def usage_sliding_30d(i):
    return usage.usage_sliding(i.usage_log)


@query("owner_assign", "SELECT DISTINCT node, CASE WHEN layer IN ('raw', 'staging') THEN 'urn:li:corpuser:engineering' "
       "ELSE 'urn:li:corpuser:analytics' END AS owner, CASE WHEN layer IN ('raw', 'staging') THEN 'TECHNICAL_OWNER' "
       "ELSE 'BUSINESS_OWNER' END AS owner_type FROM fx_assets")
def owner_assign(i):
    return usage.assign_owners(i.assets, "urn:li:corpuser:engineering", "urn:li:corpuser:analytics")


@query("owner_flags", "SELECT urn, concat_ws('; ', technical_owner, business_owner) AS owners, business_owner IS NOT NULL "
       "AS has_business_owner FROM (SELECT *, physical_urn AS urn FROM fx_assets UNION ALL SELECT *, logical_urn FROM fx_assets) a "
       "WHERE urn IS NOT NULL")
def owner_flags(i):
    return usage.owner_flags(e.entities(i))




@query("glossary_association", """
SELECT DISTINCT f.table_name, f.name AS column_name, c.term_id, t.term, t.definition
FROM fx_snapshot_fields f
JOIN (SELECT DISTINCT table_name, name, type AS term_id FROM fx_snapshot_fields WHERE type = 'numeric(10,2)') c
  ON c.table_name = f.table_name AND c.name = f.name
JOIN (SELECT DISTINCT type AS term_id, upper(type) AS term, 'values of type ' || type AS definition FROM fx_snapshot_fields) t
  ON t.term_id = c.term_id""")
def glossary_association(i):
    fields = i.snapshot_fields
    columns = fields.select("table_name", F.col("name").alias("column_name")).distinct()
    links = fields.filter("type = 'numeric(10,2)'").select(
        "table_name", F.col("name").alias("column_name"), F.col("type").alias("term_id")).distinct()
    terms = fields.select(
        F.col("type").alias("term_id"), F.upper("type").alias("term"),
        F.concat(F.lit("values of type "), "type").alias("definition")).distinct()
    return usage.glossary_links(columns, links, terms)


@query("asset_descriptions", """
SELECT a.node, a.layer, 'customer in segment ' || c_mktsegment AS description
FROM fx_assets a LEFT JOIN customer ON 'customer_' || CAST(c_custkey AS STRING) = a.node""")
def asset_descriptions(i):
    written = i.customer.select(
        F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("node"),
        F.concat(F.lit("customer in segment "), "c_mktsegment").alias("description"))
    return usage.describe(i.assets.select("node", "layer"), written)


# --- severity ------------------------------------------------------------------


@query("severity_score", "SELECT break_mode, usage_count, is_dashboard_exposed, has_business_owner, severity_score, "
       "count(*) AS n_rows FROM assessed GROUP BY ALL", e.ASSESSMENT)
def severity_score(i):
    columns = ("break_mode", "usage_count", "is_dashboard_exposed", "has_business_owner", "severity_score")
    return measured(i, *columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))


RANK = "row_number() OVER (PARTITION BY change_id ORDER BY severity_score DESC, node) AS severity_rank"


@query("severity_rank", f"SELECT change_id, node, severity_score, {RANK} FROM assessed", e.ASSESSMENT)
def severity_rank(i):
    # Written once: cutting rows into ranges reads them twice.
    rows = stage(measured(i, "change_id", "node", "severity_score"), "scores")
    return severity.severity_rank(rows)


@query("severity_topk", f"SELECT * FROM (SELECT change_id, node, severity_score, {RANK} FROM assessed) r "
       "WHERE severity_rank <= 10", e.ASSESSMENT)
def severity_topk(i):
    return severity.severity_topk(measured(i, "change_id", "node", "severity_score"))


@query("impact_summary", "SELECT * FROM summary", e.SUMMARY)
def impact_summary(i):
    rich = e.estate(i)
    return plan.summarize(rich, stage(plan.measure(rich), "assessment"))


# --- decisions -----------------------------------------------------------------


@query("affected_deepest_hop", "SELECT change_id, affected_deepest_hop FROM summary", e.SUMMARY)
def affected_deepest_hop(i):
    return impact_summary(i).select("change_id", "affected_deepest_hop")


@query("decision_type", "SELECT change_id, change_type, affected, decision_type FROM decided", e.DECISIONS)
def decision_type(i):
    return decided(i).select("change_id", "change_type", "affected", "decision_type")


@query("recommend_strategy", "SELECT change_id, decision_type, recommended_strategy FROM decided", e.DECISIONS)
def recommend_strategy(i):
    return decided(i).select("change_id", "decision_type", "recommended_strategy")


STRATEGY_ROWS = " UNION ALL ".join(
    f"SELECT '{k}' AS strategy_id, '{n}' AS name, '{d.replace(chr(39), chr(39) * 2)}' AS description, '{t}' AS tradeoff"
    for k, n, d, t in decision.STRATEGIES
)


@query("strategy_options", f"SELECT change_id, s.*, s.strategy_id = recommended_strategy AS recommended FROM decided, ({STRATEGY_ROWS}) s "
       "WHERE decision_type = 'BREAKING'", e.DECISIONS)
def strategy_options(i):
    return decision.strategy_options(decided(i))


REASON = """s || ': ' || CASE
 WHEN s = 'A' THEN concat_ws('; ', CASE WHEN many THEN 'hard breaks ' || hard_breaks || ' > 5' END,
      CASE WHEN deep THEN 'affected hop ' || affected_deepest_hop || ' >= 4' END,
      CASE WHEN exposed_affected > 0 THEN 'dashboard feeders ' || exposed_affected || ' > 0' END)
 WHEN s = 'B' AND r = 'C' THEN concat_ws('; ', CASE WHEN many THEN 'hard breaks ' || hard_breaks || ' > 5' END,
      CASE WHEN deep THEN 'affected hop ' || affected_deepest_hop || ' >= 4' END)
 WHEN s = 'B' THEN 'dashboard feeders 0'
 ELSE 'hard breaks ' || hard_breaks || ' <= 5; affected hop ' || affected_deepest_hop || ' < 4' END"""
REJECTED = f"""SELECT change_id, s AS strategy_id, {REASON} AS reason FROM (
    SELECT *, recommended_strategy AS r, unnest(['A', 'B', 'C']) AS s FROM decided WHERE decision_type = 'BREAKING') x WHERE s <> r"""


@query("rejected_strategies", REJECTED, e.DECISIONS)
def rejected_strategies(i):
    return decision.rejected_strategies(decided(i))


RATIONALE = """CASE decision_type
 WHEN 'NO_MIGRATION_NEEDED' THEN 'Nothing downstream uses `' || column_name || '`: ' || scanned || ' scanned, 0 affected.'
 WHEN 'ADDITIVE' THEN '`' || change_type || '` breaks no consumer: ' || affected || ' asset(s) to notify, none to patch.'
 ELSE CASE WHEN many AND deep THEN 'Defer: ' || hard_breaks || ' hard break(s), more than 5; affected hop ' || affected_deepest_hop || ', at or past 4.'
           WHEN many THEN 'Defer: ' || hard_breaks || ' hard break(s), more than 5.'
           WHEN deep THEN 'Defer: affected hop ' || affected_deepest_hop || ', at or past 4; depth alone decides, with '
                || hard_breaks || ' hard break(s) and ' || silent_risks || ' silent risk(s).'
           WHEN exposed_affected > 0 THEN 'Bridge: ' || exposed_affected || ' affected asset(s) feed a dashboard.'
           ELSE 'Patch: ' || hard_breaks || ' hard break(s), deepest affected hop ' || affected_deepest_hop || ', no dashboard fed.' END END"""


@query("decision_rationale", f"SELECT change_id, decision_type, {RATIONALE} AS rationale FROM decided", e.DECISIONS)
def decision_rationale(i):
    return decided(i).select("change_id", "decision_type", "rationale")


# A third of the owners answer, some with an override and some with nothing useful.
ANSWERS = """SELECT change_id, CASE change_type WHEN 'rename' THEN ' a' WHEN 'drop_column' THEN 'c ' ELSE 'maybe' END AS answer
FROM fx_changes WHERE column_name <> 'n'"""


@query("confirmation", f"""
SELECT d.change_id, CASE WHEN recommended_strategy IS NULL THEN 'NOT_APPLICABLE' WHEN a.change_id IS NOT NULL THEN 'HUMAN_CONFIRMED'
            ELSE 'PENDING' END AS confirmation_mode,
       recommended_strategy IS NOT NULL AND a.change_id IS NOT NULL AS human_confirmed,
       CASE WHEN recommended_strategy IS NOT NULL AND a.change_id IS NOT NULL THEN
            CASE WHEN upper(trim(a.answer)) IN ('A', 'B', 'C') THEN upper(trim(a.answer)) ELSE recommended_strategy END
       END AS confirmed_strategy
FROM decided d LEFT JOIN ({ANSWERS}) a ON a.change_id = d.change_id""", e.DECISIONS)
def confirmation(i):
    changes = i.changes.filter("column_name <> 'n'")
    answers = changes.select("change_id", F.when(F.col("change_type") == "rename", " a")
                             .when(F.col("change_type") == "drop_column", "c ").otherwise("maybe").alias("answer"))
    return decision.confirm(decided(i), answers).select(
        "change_id", "confirmation_mode", "human_confirmed", "confirmed_strategy")


# --- narratives and reports ----------------------------------------------------

NARRATIVE = """
 CASE compile_status WHEN 'ORIGIN_HARD_BREAK' THEN '`' || node || '` breaks: it reads the changed column `' || column_name || '` of `' || root || '` itself'
      WHEN 'CASCADE_HARD_BREAK' THEN '`' || node || '` breaks: something it is built on fails first'
      ELSE '`' || node || '` holds nothing that comes from `' || root || '.' || column_name || '`' END
 || ' (hop ' || hop || '). '
 || CASE break_mode WHEN 'HARD_BREAK' THEN 'The failure is loud: the model no longer compiles or runs.'
         || CASE WHEN select_star_exposure THEN ' It also expands a star, so a careless fix could shift its columns silently.' ELSE '' END
      WHEN 'SILENT_CORRUPTION' THEN 'The risk is silent: it expands a star, so nothing fails while its columns change.'
      ELSE 'Nothing changes for it.' END
 || CASE WHEN is_dashboard_exposed OR usage_count > 0 THEN ' Exposure: ' || concat_ws('; ',
         CASE WHEN is_dashboard_exposed THEN 'feeds a dashboard' END,
         CASE WHEN usage_count > 0 THEN usage_count || CASE WHEN usage_count = 1 THEN ' recorded query' ELSE ' recorded queries' END END)
         || '.' ELSE '' END
 || CASE WHEN evidence <> '' THEN ' Evidence: ' || evidence || '.' ELSE '' END"""
NARRATIVES = f"SELECT change_id, node, break_mode, {NARRATIVE} AS narrative FROM assessed WHERE break_mode <> 'UNAFFECTED' ORDER BY change_id, node"
SAFE = """SELECT change_id, chunk, string_agg(node, ', ' ORDER BY node) AS names FROM (
    SELECT change_id, node, (row_number() OVER (PARTITION BY change_id ORDER BY node) - 1) // 1000 AS chunk
    FROM assessed WHERE break_mode = 'UNAFFECTED') s GROUP BY ALL"""


@query("narratives", NARRATIVES, e.ASSESSMENT)
def narratives(i):
    return narrative.narratives(plan.assess(e.estate(i), affected_only=True))


@query("safe_summary", SAFE, e.ASSESSMENT)
def safe_summary(i):
    return narrative.safe_summary(measured(i, "change_id", "node", "break_mode"))


@query("narrative_export", NARRATIVES, e.ASSESSMENT)
def narrative_export(i):
    rows = stage(assessed(i), "assessment")
    told = narrative.narratives(rows)
    path = run_path(i.spark, "export")
    files.export_narratives(told, narrative.safe_summary(rows), path)
    return i.spark.read.schema(told.schema).json(f"{path}/narratives")


def project(i):
    models = i.assets.select(F.col("node").alias("model"))
    sources = i.assets.filter("layer = 'raw'").select(
        F.lit("public").alias("source_name"), F.col("node").alias("table_name"))
    return migration.Project(models, sources)


def migrated(i, whole=True):
    return migration.migrate(e.estate(i), project(i), whole=whole)


ORIGINS = """SELECT change_id, node, file_path, hop,
    row_number() OVER (PARTITION BY change_id ORDER BY hop, node) = 1 AS is_primary
FROM assessed WHERE compile_status = 'ORIGIN_HARD_BREAK' AND file_path IS NOT NULL"""


@query("origin_models", ORIGINS, e.ASSESSMENT)
def origin_models(i):
    return patch.origin_models(measured(i, "change_id", "node", "file_path", "hop", "compile_status", "break_mode"))


# In the asset models every anchor line is ``    o.a,`` or ``    s.<column>``.
REPAIRS = {
    **e.DECISIONS,
    "origins": ORIGINS,
    "anchored": f"""
        SELECT change_id, path, column_name, new_column, min(number) AS line_number FROM (
            SELECT o.change_id, o.file_path AS path, d.column_name, d.new_column, {e.LINES.format(t='m.source_text')}
            FROM origins o JOIN decided d ON d.change_id = o.change_id JOIN models m ON m.path = o.file_path
            WHERE o.is_primary AND d.decision_type = 'BREAKING' AND d.recommended_strategy <> 'C') l
        WHERE line NOT LIKE '--%' AND regexp_matches(line, '\\b' || column_name || '\\b') GROUP BY ALL""",
    "tried": """
        SELECT o.change_id, o.file_path AS path, a.line_number IS NOT NULL AS passed
        FROM origins o JOIN decided d ON d.change_id = o.change_id LEFT JOIN anchored a ON a.change_id = o.change_id
        WHERE o.is_primary AND d.decision_type = 'BREAKING' AND d.recommended_strategy <> 'C'""",
    "unhandled": """
        SELECT o.change_id, count(*) AS unhandled_origins FROM origins o JOIN tried t ON t.change_id = o.change_id
        WHERE NOT o.is_primary GROUP BY 1""",
    "statuses": """
        SELECT d.change_id, d.decision_type, CASE WHEN coalesce(u.unhandled_origins, 0) > 0 THEN 'NEEDS_HUMAN'
               WHEN t.change_id IS NULL AND d.decision_type = 'BREAKING' THEN 'DEFERRED'
               WHEN t.change_id IS NULL THEN 'ASSESSMENT_ONLY' WHEN t.passed THEN 'PASSED' ELSE 'NEEDS_HUMAN' END AS status
        FROM decided d LEFT JOIN tried t ON t.change_id = d.change_id LEFT JOIN unhandled u ON u.change_id = d.change_id""",
}


@query("report_status", "SELECT * FROM statuses", REPAIRS)
def report_status(i):
    return migration.statuses(migrated(i, whole=False))


REPORT = {
    **REPAIRS,
    "ranked": f"SELECT *, {RANK} FROM assessed",
    "head": """SELECT change_id, unnest(['Changed: ' || root || '.' || column_name, 'Scanned: ' || scanned, 'Affected: ' || affected,
        'Hard breaks: ' || hard_breaks, 'Silent risks: ' || silent_risks, 'Safe: ' || safe, 'Owners: ' || distinct_owners,
        'Deepest hop: ' || deepest_hop]) AS text, unnest(range(8)) AS line FROM summary""",
    "asset_lines": """SELECT change_id, severity_rank, unnest(lines) AS text, unnest(range(len(lines))) AS line FROM (
        SELECT change_id, severity_rank, list_concat([concat_ws(' | ', printf('%.1f', severity_score), node, break_mode, CAST(hop AS VARCHAR),
            CAST(usage_count AS VARCHAR), CAST(is_dashboard_exposed AS VARCHAR))],
            CASE WHEN evidence = '' THEN [] ELSE list_transform(string_split(evidence, '; '),
                 lambda x: 'evidence: ' || x) END) AS lines FROM ranked) r""",
    "choice": f"""SELECT change_id, unnest(lines) AS text, unnest(range(len(lines))) AS line FROM (
        SELECT change_id, list_filter(['Decision: ' || decision_type, {RATIONALE},
            {", ".join(f"CASE WHEN decision_type = 'BREAKING' THEN '{k}. {n}' || CASE WHEN recommended_strategy = '{k}' THEN ' (recommended)' ELSE '' END || ' - {(d + ' ' + t).replace(chr(39), chr(39) * 2)}' END" for k, n, d, t in decision.STRATEGIES)},
            'Confirmation: ' || CASE WHEN recommended_strategy IS NULL THEN 'NOT_APPLICABLE' ELSE 'PENDING' END,
            'Strategy: none'], lambda x: x IS NOT NULL) AS lines FROM decided) d""",
    "code": f"""SELECT t.change_id, unnest(CASE WHEN a.line_number IS NULL THEN ['File: ' || t.path] ELSE ['File: ' || t.path, '-' || l.line,
            '+' || regexp_extract(l.line, '^(\\s*[a-z]+\\.)', 1) || a.new_column || ' as ' || a.column_name
                || CASE WHEN l.line LIKE '%,' THEN ',' ELSE '' END] END) AS text,
            unnest(CASE WHEN a.line_number IS NULL THEN [0] ELSE [0, 1, 2] END) AS line
        FROM tried t LEFT JOIN anchored a ON a.change_id = t.change_id
        LEFT JOIN (SELECT path, {e.LINES.format(t='source_text')} FROM models) l ON l.path = a.path AND l.number = a.line_number""",
}


@query("report_rows", f"""
SELECT change_id, 0 AS section, 0 AS item, 0 AS line, 'Status: ' || status AS text FROM statuses
UNION ALL SELECT change_id, 1, 0, line, text FROM head
UNION ALL SELECT change_id, 1, severity_rank, line, text FROM asset_lines
UNION ALL SELECT change_id, 2, severity_rank, 0, {NARRATIVE} FROM ranked WHERE break_mode <> 'UNAFFECTED'
UNION ALL SELECT change_id, 2, severity_rank, 0, 'safe: ' || node FROM ranked WHERE break_mode = 'UNAFFECTED'
UNION ALL SELECT change_id, 3, 0, line, text FROM choice
UNION ALL SELECT change_id, 3, 1 + ascii(strategy_id) - 65, 0, reason FROM ({REJECTED}) j
UNION ALL SELECT change_id, 4, 0, line, text FROM code
UNION ALL SELECT change_id, 5, 0, 0, 'V1_STATIC: PASS - ' || change_id || '#' || path || ' reads as SQL' FROM tried
UNION ALL SELECT change_id, 5, 0, 1, 'V2_COMPILE: PASS - ' || change_id || '#' || path || ' resolves all references' FROM tried
""", REPORT)
def report_rows(i):
    return migration.report_table(migrated(i))


@query("related_assets", """
SELECT d.change_id, CASE WHEN decision_type = 'BREAKING' THEN 'Decision' ELSE 'Analysis' END AS document_type, a.urn,
       a.is_root, 'schema-change; ' || d.root || '; ' || decision_type AS topics
FROM decided d JOIN (SELECT c.change_id, s.physical_urn AS urn, true AS is_root FROM fx_changes c JOIN fx_assets s ON s.node = c.node
    UNION ALL SELECT change_id, urn, false FROM assessed WHERE break_mode <> 'UNAFFECTED') a ON a.change_id = d.change_id""",
       e.DECISIONS)
def related_assets(i):
    rich = e.estate(i)
    rows = stage(plan.measure(rich, (*plan.MEASURED, "urn")), "assessment")
    roots = i.changes.join(i.assets.select("node", F.col("physical_urn").alias("urn")), "node")
    return report.related_assets(plan.decide(rich, rows), rows, roots).select(
        "change_id", "document_type", "urn", "is_root", "topics")


# The orders of a change's customer, as they are and as rebuilt under a renamed key.
SCOPE = """SELECT change_id, c_custkey AS customer_key FROM fx_changes JOIN customer ON node = 'customer_' || c_custkey
UNION ALL SELECT change_id, o_custkey FROM fx_changes JOIN orders ON node = 'order_' || o_orderkey"""
PARITY = {
    "change_scope": SCOPE,
    "differing": """SELECT DISTINCT customer_key FROM (
        (SELECT * FROM fx_fct_orders EXCEPT ALL SELECT * FROM fx_candidate_orders)
        UNION ALL (SELECT * FROM fx_candidate_orders EXCEPT ALL SELECT * FROM fx_fct_orders)) d""",
    "order_counts": """SELECT customer_key, CAST(sum(n) AS BIGINT) AS delta FROM (
        SELECT customer_key, -1 AS n FROM fx_fct_orders UNION ALL SELECT customer_key, 1 FROM fx_candidate_orders) c GROUP BY 1""",
    "verdicts": """SELECT s.change_id, coalesce(n.delta, 0) AS row_delta, d.customer_key IS NULL AS checksum_equal,
        CASE WHEN d.customer_key IS NULL THEN 'PASS' ELSE 'FAIL' END AS verdict
        FROM change_scope s LEFT JOIN differing d ON d.customer_key = s.customer_key
        LEFT JOIN order_counts n ON n.customer_key = s.customer_key""",
}


def change_parity(i):
    customers = i.customer.select(F.concat(F.lit("customer_"), "c_custkey").alias("node"), F.col("c_custkey").alias("customer_key"))
    orders = i.orders.select(F.concat(F.lit("order_"), "o_orderkey").alias("node"), F.col("o_custkey").alias("customer_key"))
    scope = i.changes.select("change_id", "node").join(customers.unionByName(orders), "node").select("change_id", "customer_key")
    rebuilt = i.candidate_orders.withColumnRenamed("customer_key", "buyer_key")
    return warehouse.shadow_parity_by_change(scope, i.fct_orders, rebuilt, {"buyer_key": "customer_key"}, "customer_key")


@query("parity_by_change", "SELECT * FROM verdicts", PARITY)
def parity_by_change(i):
    return change_parity(i)


@query("outcome_record", f"""
SELECT t.change_id, CASE WHEN NOT passed OR v.verdict = 'FAIL' THEN 'FAILED' WHEN r.n > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS outcome,
       CAST(coalesce(r.n, 0) AS BIGINT) AS residue_lines
FROM tried t JOIN verdicts v ON v.change_id = t.change_id LEFT JOIN (
    SELECT change_id, count(*) - CASE WHEN any_value(passed) THEN 1 ELSE 0 END AS n FROM (
        SELECT t.change_id, t.passed, d.column_name, {e.LINES.format(t='m.source_text')}
        FROM tried t JOIN decided d ON d.change_id = t.change_id JOIN models m ON m.path = t.path) l
    WHERE line NOT LIKE '--%' AND regexp_matches(line, '(?i)\\b' || column_name || '\\b') GROUP BY change_id) r ON r.change_id = t.change_id
""", {**REPAIRS, **PARITY})
def outcome_record(i):
    return migration.outcomes(migrated(i, whole=False), change_parity(i))
