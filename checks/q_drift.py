"""Schema drift in batch and as a stream, and trace analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import estate as e
from checks.registry import query
from faultline.operators import drift, traces, verify
from faultline.plans import watch
from faultline.session import run_path, stage
from faultline.sources import files
from faultline.streaming import drift as stream

KEY = "platform, schema_name, table_name"
AT = "strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at"

SNAPSHOTS = {
    "snapshots": f"SELECT {KEY}, captured_at, list(DISTINCT name ORDER BY name) AS names FROM fx_snapshot_fields GROUP BY ALL",
    "pairs": f"""SELECT *, lag(names) OVER (PARTITION BY {KEY} ORDER BY captured_at) AS before FROM snapshots""",
    "moves": f"""SELECT {KEY}, captured_at, list_sort(list_filter(before, lambda x: NOT list_contains(names, x))) AS gone,
                        list_sort(list_filter(names, lambda x: NOT list_contains(before, x))) AS come
                 FROM pairs WHERE before IS NOT NULL""",
    "changes": f"""
        SELECT {KEY}, captured_at, 0 AS seq, 'possible_rename' AS change_type, gone[1] AS old_column, come[1] AS new_column,
               '`' || gone[1] || '` is no longer there and `' || come[1] || '` is new; a rename or an unrelated drop and add' AS evidence
        FROM moves WHERE len(gone) = 1 AND len(come) = 1
        UNION ALL
        SELECT {KEY}, captured_at, unnest(range(len(gone))), 'drop_column', unnest(gone), NULL, '`' || unnest(gone) || '` is no longer there'
        FROM moves WHERE NOT (len(gone) = 1 AND len(come) = 1)
        UNION ALL
        SELECT {KEY}, captured_at, len(gone) + unnest(range(len(come))), 'add_column', NULL, unnest(come), '`' || unnest(come) || '` is new'
        FROM moves WHERE NOT (len(gone) = 1 AND len(come) = 1)""",
}
CHANGES = f"SELECT {KEY}, {AT}, seq, change_type, old_column, new_column, evidence FROM changes"


def history(i):
    return drift.snapshot_capture(i.snapshot_fields)


def snapshot_files(i) -> str:
    """The snapshot history as JSON files in no order of time."""
    path = run_path(i.spark, "snapshots")
    history(i).repartition(12, F.hash("captured_at", *drift.KEY)).write.json(path)
    return path


@query("snapshot_capture", f"""
SELECT {KEY}, {AT}, string_agg(name || ':' || type, ',' ORDER BY name) AS columns FROM fx_snapshot_fields
GROUP BY {KEY}, fx_snapshot_fields.captured_at""")
def snapshot_capture(i):
    pairs = F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type"]))
    return history(i).withColumn("columns", F.array_join(pairs, ","))


@query("snapshot_path_key", "SELECT DISTINCT platform || '-' || schema_name || '-' || table_name AS snapshot_key, table_name FROM fx_snapshot_fields")
def snapshot_path_key(i):
    key = files.snapshot_key(F.col("platform"), F.col("schema_name"), F.col("table_name"))
    return i.snapshot_fields.select(key.alias("snapshot_key"), "table_name").distinct()


@query("snapshot_load", f"SELECT {KEY}, {AT}, len(names) AS n_columns FROM snapshots WHERE schema_name <> 'staging'", SNAPSHOTS)
def snapshot_load(i):
    """Staging tables' files are damaged: cut-off JSON, or a record without its columns."""
    rows = history(i)
    text = F.to_json(F.struct(*rows.columns))
    staging = F.col("schema_name") == "staging"
    damaged = F.when(staging & (F.size("columns") == 1), F.to_json(F.struct("platform", "table_name"))).when(
        staging, F.regexp_replace(text, r"\]\s*\}$", "")).otherwise(text)
    path = run_path(i.spark, "snapshots")
    rows.select(damaged.alias("value")).write.text(path)
    loaded = files.load_snapshots(i.spark, path)
    return loaded.select(*drift.KEY, "captured_at", F.size("columns").alias("n_columns"))


LAST_TWO = {
    **SNAPSHOTS,
    "numbered": f"SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY captured_at DESC) AS age FROM snapshots",
}


@query("snapshot_diff", f"""
SELECT {KEY}, count(*) AS n_tables, sum(CASE WHEN len(gone) = 1 AND len(come) = 1 THEN 1 ELSE len(gone) + len(come) END)::BIGINT AS n_changes
FROM (SELECT n.*, list_filter(o.names, lambda x: NOT list_contains(n.names, x)) AS gone,
             list_filter(n.names, lambda x: NOT list_contains(o.names, x)) AS come
      FROM numbered n JOIN numbered o USING ({KEY}) WHERE n.age = 1 AND o.captured_at = (
          SELECT min(f.captured_at) FROM snapshots f WHERE f.platform = n.platform AND f.schema_name = n.schema_name AND f.table_name = n.table_name)) d
WHERE len(gone) + len(come) > 0 GROUP BY {KEY}""", LAST_TWO)
def snapshot_diff(i):
    """The newest snapshot of each table against its oldest."""
    rows = history(i)
    pick = rows.groupBy(*drift.KEY).agg(
        F.min_by("columns", "captured_at").alias("first"), F.max_by("columns", "captured_at").alias("columns"),
        F.max("captured_at").alias("captured_at"))
    changes = drift.snapshot_diff(pick.select(*drift.KEY, F.col("first").alias("columns")), pick.drop("first"))
    return changes.groupBy(*drift.KEY).agg(F.countDistinct("captured_at").alias("n_tables"), F.count(F.lit(1)).alias("n_changes"))


@query("snapshot_history_diff", CHANGES, SNAPSHOTS)
def snapshot_history_diff(i):
    return drift.history_diff(history(i))


# Live tables and the columns they had when a snapshot of them was last stored.
STORED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_phone"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
# What differs, with the rows it bears on.
LIVE = """
SELECT 'customer' AS table_name, 'possible_rename' AS change_type, 'c_phone' AS old_column, 'c_mktsegment' AS new_column,
       count(c_mktsegment) AS n_values FROM customer
UNION ALL SELECT 'orders', 'add_column', NULL, 'o_orderpriority', count(o_orderpriority) FROM orders"""


@query("live_schema_drift", LIVE)
def live_schema_drift(i):
    """Stored snapshots against the schemas the tables have now, and how many values a new column holds."""
    tables = {name: getattr(i, name) for name in STORED}
    now = drift.live_snapshots(i.spark, tables, "files", "public", F.lit("2024-02-01").cast("timestamp"))
    columns = F.create_map(*[x for name, kept in STORED.items() for x in (
        F.lit(name), F.array(*[F.struct(F.lit(c).alias("name"), F.lit("").alias("type")) for c in kept]))])
    stored = now.select(*drift.KEY, columns[F.col("table_name")].alias("columns"))
    counts = None
    for name, df in tables.items():
        one = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "new_column", "n_values")
        one = one.withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    changes = drift.snapshot_diff(stored, now).select("table_name", "change_type", "old_column", "new_column")
    return changes.join(counts, ["table_name", "new_column"], "left")


def streamed(i):
    path = run_path(i.spark, "drift")
    stream.drift_stream(stream.snapshot_stream(i.spark, snapshot_files(i)), path, run_path(i.spark, "drift_state"))
    return stream.read_changes(i.spark, path)


@query("drift_stream", CHANGES, SNAPSHOTS)
def drift_stream(i):
    return streamed(i)


@query("actionable_changes", CHANGES + " WHERE old_column IS NOT NULL AND new_column IS NOT NULL", SNAPSHOTS)
def actionable_changes(i):
    return drift.actionable(drift.history_diff(history(i)))


LOGGED = f"SELECT {KEY}, {AT}, seq, change_type, old_column, new_column, old_column IS NOT NULL AND new_column IS NOT NULL AS pipeline_triggered FROM changes"


@query("outcome_stream", LOGGED, SNAPSHOTS)
def outcome_stream(i):
    path = run_path(i.spark, "outcomes")
    stream.outcome_stream(stream.snapshot_stream(i.spark, snapshot_files(i)), path, run_path(i.spark, "outcome_state"))
    return stream.read_outcomes(i.spark, path).drop("batch", "evidence")


LATE = {
    **SNAPSHOTS,
    "days": f"SELECT {KEY}, captured_at, dense_rank() OVER (PARTITION BY {KEY} ORDER BY captured_at) AS day FROM snapshots",
}


@query("late_snapshots", f"""SELECT {KEY}, {AT}, CASE day % 3 WHEN 1 THEN 1 ELSE 2 END AS batch FROM days d WHERE day % 3 <> 0
    AND EXISTS (SELECT 1 FROM days l WHERE l.platform = d.platform AND l.schema_name = d.schema_name AND l.table_name = d.table_name
                AND l.captured_at >= d.captured_at AND (l.day % 3 = 0 OR (d.day % 3 = 2 AND l.day % 3 = 1)))""", LATE)
def late_snapshots(i):
    """Every third snapshot of a table comes first, then the one after each, then the rest."""
    path, state = run_path(i.spark, "late"), run_path(i.spark, "late_state")
    source = run_path(i.spark, "snapshots")
    order = Window.partitionBy(*drift.KEY).orderBy("captured_at")
    rows = stage(history(i).withColumn("turn", F.row_number().over(order) % 3), "turns")
    for turn in (0, 1, 2):
        rows.filter(F.col("turn") == turn).drop("turn").write.mode("append").json(source)
        stream.drift_stream(stream.snapshot_stream(i.spark, source), path, state)
    return stream.late_snapshots(i.spark, path)


@query("late_snapshots_settle", CHANGES, SNAPSHOTS)
def late_snapshots_settle(i):
    """The changes after newer snapshots came first and older ones corrected them."""
    path, state = run_path(i.spark, "late"), run_path(i.spark, "late_state")
    source = run_path(i.spark, "snapshots")
    rows = stage(history(i).withColumn("half", F.dayofyear("captured_at") % 2), "halves")
    for half in (1, 0):
        rows.filter(F.col("half") == half).drop("half").write.mode("append").json(source)
        stream.drift_stream(stream.snapshot_stream(i.spark, source), path, state)
    return stream.read_changes(i.spark, path)


@query("outcome_log", LOGGED, SNAPSHOTS)
def outcome_log(i):
    entries = watch.log_entries(drift.history_diff(history(i)))
    path = run_path(i.spark, "outcomes")
    for schema_name in ("staging", "public"):
        part = entries.filter(F.col("schema_name") == schema_name)
        files.append_outcomes(part.withColumn("batch", F.lit(0 if schema_name == "staging" else 1)), path)
    return files.read_outcomes(i.spark, path).drop("batch", "evidence")


@query("type_change", f"""
SELECT f.platform, f.schema_name, f.table_name, strftime(f.captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, f.name AS column_name,
       o.type AS old_type, f.type AS new_type
FROM fx_snapshot_fields f
JOIN (SELECT {KEY}, captured_at, lag(captured_at) OVER (PARTITION BY {KEY} ORDER BY captured_at) AS previous_at FROM snapshots) p
  ON p.platform = f.platform AND p.schema_name = f.schema_name AND p.table_name = f.table_name AND p.captured_at = f.captured_at
JOIN fx_snapshot_fields o ON o.platform = f.platform AND o.schema_name = f.schema_name AND o.table_name = f.table_name
  AND o.captured_at = p.previous_at AND o.name = f.name
WHERE o.type <> f.type""", SNAPSHOTS)
def type_change(i):
    return drift.type_changes(history(i))


def mapped_tables(i):
    """Lineage nodes of the public tables; nothing is known of those still in staging."""
    fields = i.snapshot_fields.filter("schema_name = 'public'")
    return fields.select(*drift.KEY, F.concat(F.lit("customer_"), F.substring_index("table_name", "_", -1)).alias("node")).distinct()


@query("unmapped_drift", CHANGES + " WHERE old_column IS NOT NULL AND new_column IS NOT NULL AND schema_name = 'staging'", SNAPSHOTS)
def unmapped_drift(i):
    return watch.unmapped_drift(drift.history_diff(history(i)), mapped_tables(i))


@query("drift_assess", """
SELECT 'postgres-' || schema_name || '-' || table_name || '-' || strftime(captured_at, '%Y%m%d%H%M%S') || '-' || old_column AS change_id,
       'customer_' || split_part(table_name, '_', 2) AS root, 'possible_rename' AS change_type, new_column, h.scanned,
       coalesce(h.affected, 0) AS affected,
       CASE WHEN coalesce(h.affected, 0) = 0 THEN 'NO_MIGRATION_NEEDED' ELSE 'BREAKING' END AS decision_type,
       CASE WHEN coalesce(h.affected, 0) = 0 THEN 'NOT_APPLICABLE' ELSE 'PENDING' END AS confirmation_mode
FROM changes JOIN (SELECT c.node, count(*) FILTER (a.type = 'DATASET') AS scanned,
                          count(*) FILTER (a.type = 'DATASET' AND ((n_regionkey IN (1, 2) AND a.node LIKE 'nation%') OR a.node LIKE 'report%' OR a.node LIKE 'digest%')) AS affected
                   FROM (SELECT DISTINCT node, change_id FROM fx_changes) c JOIN broad_all b ON b.change_id = c.change_id
                   JOIN fx_assets a ON a.node = b.node
                   LEFT JOIN nation ON a.node = 'nation_' || CAST(n_nationkey AS STRING) GROUP BY 1) h
  ON h.node = 'customer_' || split_part(table_name, '_', 2)
WHERE old_column IS NOT NULL AND new_column IS NOT NULL AND schema_name = 'public'""", {**SNAPSHOTS, **e.BROAD})
def drift_assess(i):
    """Drift of a user's table is drift of that customer's node; its columns carry on nowhere."""
    decisions = watch.drift_assess(e.estate(i), drift.history_diff(history(i)), mapped_tables(i))
    return decisions.select("change_id", "root", "change_type", "new_column", "scanned", "affected", "decision_type", "confirmation_mode")


# --- traces --------------------------------------------------------------------


def calls(i):
    """Trace lines written as JSON and read back."""
    rows = i.calls.select(
        "run_id", "call_number", "tool", F.from_json("props", "MAP<STRING, STRING>").alias("args"), "rationale", "result_summary")
    path = run_path(i.spark, "traces")
    files.write_json(rows, path)
    return files.read_calls(i.spark, path)


@query("trace_read", "SELECT run_id, call_number, tool, regexp_extract(props, '([0-9]+)', 1) AS k, rationale, result_summary FROM fx_calls")
def trace_read(i):
    return calls(i).select("run_id", "call_number", "tool", F.col("args")["k"].alias("k"), "rationale", "result_summary")


@query("trace_by_tool", """
SELECT run_id, tool, count(*) AS calls, sum(count(*)) OVER (PARTITION BY run_id)::BIGINT AS run_calls,
       sum(count(*)) OVER (PARTITION BY run_id) > 30 AS over_budget FROM fx_calls GROUP BY run_id, tool""")
def trace_by_tool(i):
    return traces.calls_by_tool(i.calls)


@query("trace_counts", "SELECT call_number, CAST(regexp_extract(result_summary, '^([0-9]+)', 1) AS BIGINT) AS result_count FROM fx_calls")
def trace_counts(i):
    return traces.result_counts(i.calls).select("call_number", "result_count")


def attempts(i):
    rows = i.attempt_checks
    v1 = F.struct(F.lit("V1_STATIC").alias("level"), F.col("static_ok").alias("passed"), F.lit("text length").alias("message"),
                  F.when(~F.col("static_ok"), F.concat(F.lit("too long: "), F.length("candidate_content").cast("string"))).alias("raw_error"))
    v2 = F.struct(F.lit("V2_COMPILE").alias("level"), F.col("compile_ok").alias("passed"), F.lit("role").alias("message"),
                  F.when(~F.col("compile_ok"), "not an answer").alias("raw_error"))
    outcomes = F.when(F.col("static_ok"), F.array(v1, v2)).otherwise(F.array(v1))
    return verify.summarize_outcomes(rows.withColumn("outcomes", outcomes.cast(f"array<{verify.OUTCOME_TYPE}>")))


@query("attempts_read", """
SELECT CAST(run_id AS VARCHAR) AS run_id, attempt_number, static_ok AND compile_ok AS passed, CASE WHEN static_ok THEN 2 ELSE 1 END AS n_outcomes,
       CASE WHEN NOT static_ok THEN 'too long: ' || length(candidate_content) WHEN NOT compile_ok THEN 'not an answer' END AS first_failure_raw_error
FROM fx_attempt_checks""")
def attempts_read(i):
    rows = attempts(i).select(
        F.col("run_id").cast("string"), "attempt_number", F.concat(F.lit("models/"), F.col("run_id").cast("string")).alias("dbt_file_path"),
        "candidate_content", "passed", "outcomes", F.col("first_failure.raw_error").alias("first_failure_raw_error"))
    path = run_path(i.spark, "attempts")
    files.write_json(rows, path)
    back = files.read_attempts(i.spark, path)
    return back.select("run_id", "attempt_number", "passed", F.size("outcomes").alias("n_outcomes"), "first_failure_raw_error")


@query("attempt_summary", """
SELECT run_id, count(*) FILTER (attempt_number <= 3) AS attempts, count(*) FILTER (attempt_number > 3) AS attempts_past_cap,
       CASE WHEN bool_or(static_ok AND compile_ok AND attempt_number <= 3) THEN 'PASSED' ELSE 'NEEDS_HUMAN' END AS final_status,
       arg_max(CASE WHEN NOT static_ok THEN 'too long: ' || length(candidate_content) ELSE 'not an answer' END, attempt_number)
           FILTER (NOT (static_ok AND compile_ok) AND attempt_number <= 3) AS last_failure
FROM fx_attempt_checks GROUP BY run_id""")
def attempt_summary(i):
    return verify.attempt_summary(attempts(i))


@query("verification_failures", """
SELECT 'V1_STATIC' AS level, count(*) AS outcomes, count(*) FILTER (NOT static_ok) AS failures, count(*) FILTER (NOT static_ok) AS first_failures,
       count(*) FILTER (NOT static_ok) / count(*) AS failure_rate FROM fx_attempt_checks
UNION ALL
SELECT 'V2_COMPILE', count(*), count(*) FILTER (NOT compile_ok), count(*) FILTER (NOT compile_ok), count(*) FILTER (NOT compile_ok) / count(*)
FROM fx_attempt_checks WHERE static_ok""")
def verification_failures(i):
    return traces.verification_failures(attempts(i))
