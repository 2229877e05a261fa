"""Expected values of the small demo estate."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.functions import clauses, text
from faultline.operators import classify, decision, patch, report, severity, usage, verify
from faultline.plans import migration
from faultline.plans.assessment import MEASURED, Estate, assess, measure, summarize

STG = "-- Explicit cust_id reference: cust_id is read here.\nselect\n    cust_id,\n    first_name\nfrom {{ source('public', 'raw_customers') }}\n"
DIM = "select\n    cust_id as customer_key,\n    first_name\nfrom {{ ref('stg_customers') }}\n"
FCT = (
    "select\n    o.order_id,\n    c.*\nfrom {{ ref('fct_orders') }} as o\n"
    "inner join {{ ref('dim_customers') }} as c\n    on o.customer_key = c.customer_key\n"
)
ORDERS = "select\n    order_id\nfrom {{ source('public', 'raw_orders') }}\n"
PATHS = {
    "stg_customers": "models/staging/stg_customers.sql", "dim_customers": "models/marts/dim_customers.sql",
    "fct_revenue": "models/marts/fct_revenue.sql", "fct_orders": "models/marts/fct_orders.sql",
}
TEXTS = {"stg_customers": STG, "dim_customers": DIM, "fct_revenue": FCT, "fct_orders": ORDERS}
BUSINESS = {"dim_customers", "fct_revenue", "fct_orders"}
ENTITY = (
    "node string, entity struct<urn:string,type:string,name:string,"
    "properties:struct<customProperties:array<struct<key:string,value:string>>>,"
    "ownership:struct<owners:array<struct<owner:struct<urn:string>,type:string>>>>"
)


def urn(platform, name):
    return f"urn:li:dataset:(urn:li:dataPlatform:{platform},warehouse.public.{name},PROD)"


@pytest.fixture(scope="module")
def estate(spark):
    entities = []
    for name, path in PATHS.items():
        kind = ("urn:li:corpuser:asmith", "BUSINESS_OWNER") if name in BUSINESS else ("urn:li:corpuser:jchen", "TECHNICAL_OWNER")
        entities.append((name, (urn("postgres", name), "DATASET", f"public.{name}", (None,), ([((kind[0],), kind[1])],))))
        entities.append((name, (urn("dbt", name), "DATASET", name, ([("dbt_file_path", path)],), (None,))))
    entities.append(("board", ("urn:li:dashboard:(bi,board)", "DASHBOARD", "board", (None,), (None,))))
    corpus = spark.createDataFrame([(PATHS[n], t) for n, t in TEXTS.items()], "path string, source_text string")
    edges = [
        ("raw_customers", "stg_customers"), ("stg_customers", "dim_customers"), ("raw_customers", "fct_revenue_job"),
        ("stg_customers", "fct_revenue"), ("dim_customers", "fct_revenue"), ("fct_orders", "fct_revenue"),
        ("fct_revenue", "board"), ("stg_customers", "fct_orders"),
    ]
    columns = [
        ("raw_customers", "cust_id", "stg_customers", "cust_id"), ("stg_customers", "cust_id", "dim_customers", "customer_key"),
        ("stg_customers", "cust_id", "fct_revenue", "customer_key"),
    ]
    log = [(n, "u") for n, k in {"fct_revenue": 12, "dim_customers": 1, "stg_customers": 1, "fct_orders": 5}.items() for _ in range(k)]
    return Estate(
        changes=spark.createDataFrame(
            [("rename", "raw_customers", "cust_id", "rename", "customer_id"), ("add", "raw_customers", "other", "add_column", "x")],
            "change_id string, node string, column_name string, change_type string, new_column string"),
        edges=spark.createDataFrame(edges, "src string, dst string").withColumn("kind", F.lit("model")),
        column_edges=spark.createDataFrame(columns, "src string, src_col string, dst string, dst_col string"),
        entities=spark.createDataFrame(entities, ENTITY),
        corpus=corpus.withColumn("compiled_text", text.compile_template(F.col("source_text"), "public")),
        usage_log=spark.createDataFrame(log, "node string, actor string"),
    )


def test_demo_estate_severities_evidence_and_decision(spark, estate):
    rows = {(r.change_id, r.node): r for r in assess(estate).collect()}
    rename = {n: r for (c, n), r in rows.items() if c == "rename"}
    assert {n: r.severity_score for n, r in rename.items()} == {
        "fct_revenue": 88.0, "dim_customers": 44.0, "stg_customers": 22.0, "fct_orders": 0.0}
    assert {n: r.hop for n, r in rename.items()} == {"fct_revenue": 2, "dim_customers": 2, "stg_customers": 1, "fct_orders": 2}
    assert rename["stg_customers"].compile_status == classify.ORIGIN
    assert rename["stg_customers"].evidence == ["models/staging/stg_customers.sql:3: cust_id,"]
    assert rename["dim_customers"].compile_status == rename["fct_revenue"].compile_status == classify.CASCADE
    assert rename["fct_revenue"].evidence[-1] == "models/marts/fct_revenue.sql:3: c.*"
    assert rename["fct_orders"].break_mode == classify.UNAFFECTED
    assert rows["add", "fct_revenue"].break_mode == classify.SILENT_CORRUPTION
    assert rows["add", "fct_revenue"].severity_score == 52.8
    decided = {r.change_id: r for r in decision.decide(summarize(estate, assess(estate))).collect()}
    r = decided["rename"]
    assert (r.scanned, r.affected, r.hard_breaks, r.silent_risks, r.safe, r.distinct_owners, r.deepest_hop) == (4, 3, 3, 0, 1, 2, 2)
    assert (r.decision_type, r.recommended_strategy) == ("BREAKING", "B")
    assert decided["add"].decision_type == "ADDITIVE" and decided["add"].recommended_strategy is None


def test_measures_equal_the_assessment_and_move_no_pair_to_its_change(spark, estate):
    back = spark.createDataFrame([("fct_revenue", "raw_customers", "model")], "src string, dst string, kind string")
    looped = replace(estate, edges=estate.edges.unionByName(back), changes=estate.changes.unionByName(spark.createDataFrame(
        [("mart", "dim_customers", "customer_key", "rename", "y"), ("none", "board", "x", "rename", "y")], estate.changes.schema)))
    for bound in (None, 2):
        columns = [*MEASURED, "urn"]
        rows = measure(looped, columns, max_hops=bound)
        assert rows.columns == columns
        assert sorted(map(str, rows.collect())) == sorted(map(str, assess(looped, bound).select(*columns).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = measure(looped)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(change_id" not in plan and "SortMergeJoin [change_id" in plan


def test_affected_rows_alone_move_to_their_change(spark, estate):
    back = spark.createDataFrame([("fct_revenue", "raw_customers", "model")], "src string, dst string, kind string")
    looped = replace(estate, edges=estate.edges.unionByName(back))
    for options in ({}, {"max_hops": 2}, {"budget": 30}):
        rows, every = assess(looped, affected_only=True, **options), assess(looped, **options)
        assert sorted(rows.columns) == sorted(every.columns)
        assert sorted(map(str, rows.select(*every.columns).collect())) == sorted(map(str, classify.affected(every).collect()))
        assert 0 < rows.count() < every.count()


def test_outcomes_need_no_whole_assessment(spark, estate):
    names = spark.createDataFrame([(n,) for n in PATHS], "model string")
    sources = spark.createDataFrame([("public", "raw_customers"), ("public", "raw_orders")], "source_name string, table_name string")
    project = migration.Project(names, sources)
    verdicts = spark.createDataFrame([("rename", 0, True, "PASS")], "change_id string, row_delta long, checksum_equal boolean, verdict string")
    whole, tracked = migration.migrate(estate, project), migration.migrate(estate, project, whole=False)
    assert tracked.assessment.columns == list(migration.TRACKED)
    assert migration.outcomes(tracked, verdicts).collect() == migration.outcomes(whole, verdicts).collect() != []
    assert sorted(migration.statuses(tracked).collect()) == sorted(migration.statuses(whole).collect())


def summary(spark, **counts):
    base = dict(change_id="c", root="t", column_name="x", change_type="rename", scanned=9, affected=1, hard_breaks=0,
                silent_risks=0, affected_deepest_hop=0, exposed_affected=0)
    return spark.createDataFrame([{**base, **counts}])


@pytest.mark.parametrize("counts, expected", [
    (dict(hard_breaks=5), "A"), (dict(hard_breaks=6), "C"), (dict(affected_deepest_hop=3), "A"),
    (dict(affected_deepest_hop=4), "C"), (dict(exposed_affected=1), "B"),
    (dict(exposed_affected=1, hard_breaks=6), "C"), (dict(change_type="possible_rename"), "A"),
    (dict(affected=0, change_type="add_column"), None), (dict(change_type="widen_type", hard_breaks=9), None),
])
def test_strategy_thresholds(spark, counts, expected):
    row = decision.decide(summary(spark, **counts)).collect()[0]
    assert row.recommended_strategy == expected


def test_confirmation_modes(spark):
    decisions = decision.decide(summary(spark, hard_breaks=1))
    answer = lambda a: spark.createDataFrame([("c", a)], "change_id string, answer string")
    got = [decision.confirm(decisions, answer(a)).collect()[0].confirmed_strategy for a in (" c ", "", "zebra")]
    assert got == ["C", "A", "A"]
    auto = decision.confirm(decisions, auto_approve=True).collect()[0]
    assert (auto.confirmation_mode, auto.human_confirmed, auto.confirmed_strategy) == ("AUTO_APPROVED", False, "A")
    none = decision.confirm(decision.decide(summary(spark, affected=0)), answer("B")).collect()[0]
    assert (none.confirmation_mode, none.confirmed_strategy) == ("NOT_APPLICABLE", None)


def test_rank_orders_by_score(spark):
    rows = spark.createDataFrame([("c", "a", 1.0), ("c", "b", 9.0), ("c", "z", 9.0)], "change_id string, node string, severity_score double")
    assert [r.node for r in severity.severity_rank(rows).orderBy("severity_rank").collect()] == ["b", "z", "a"]


@pytest.mark.parametrize("kind, final, attempts, unhandled, expected", [
    ("BREAKING", None, None, 0, "DEFERRED"), ("ADDITIVE", None, None, 0, "ASSESSMENT_ONLY"), ("ODD", None, None, 0, "UNKNOWN"),
    ("BREAKING", "PASSED", 1, 0, "PASSED"), ("BREAKING", "PASSED", 0, 0, "NEEDS_HUMAN"),
    ("BREAKING", "NEEDS_HUMAN", 3, 0, "NEEDS_HUMAN"), ("BREAKING", "PASSED", 1, 2, "NEEDS_HUMAN"),
])
def test_report_status(spark, kind, final, attempts, unhandled, expected):
    decisions = spark.createDataFrame([("c", kind)], "change_id string, decision_type string")
    repairs = spark.createDataFrame([("c", final, attempts)] if final else [], "change_id string, final_status string, attempts int")
    left = spark.createDataFrame([("c", unhandled)], "change_id string, unhandled_origins int")
    assert report.report_status(decisions, repairs, left).collect()[0].status == expected


RANKED = (
    "change_id string, node string, severity_score double, break_mode string, hop int, usage_count long, is_dashboard_exposed boolean, "
    "evidence array<string>, compile_status string, root string, column_name string, select_star_exposure boolean"
)


def test_report_numbers_the_assets_once(spark):
    def empty(schema):
        return spark.createDataFrame([], schema)

    seen = [("a", 5.0, "HARD_BREAK", ["x", "y"]), ("b", 2.0, "UNAFFECTED", []), ("c", 1.0, "UNAFFECTED", None), ("d", 0.5, None, [])]
    assets = spark.createDataFrame(
        [("k", node, score, mode, 1, 0, False, lines, "CASCADE_HARD_BREAK", "t", "q", False) for node, score, mode, lines in seen], RANKED)
    numbered = F.row_number().over(Window.partitionBy("change_id").orderBy(F.desc("severity_score")))
    counts = "scanned affected hard_breaks silent_risks safe distinct_owners deepest_hop".split()
    facts = "change_id root column_name decision_type rationale recommended_strategy confirmation_mode confirmed_strategy".split()
    rows = report.report_rows(
        empty("change_id string, status string"), empty(", ".join([f"{c} string" for c in facts] + [f"{c} long" for c in counts])),
        assets.withColumn("severity_rank", numbered), empty("change_id string, strategy_id string, reason string"),
        empty("change_id string, path string, source_text string, patched_text string"),
        empty(f"change_id string, outcomes array<{verify.OUTCOME_TYPE}>"),
    )
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1
    loud = "`a` breaks: something it is built on fails first (hop 1). The failure is loud: the model no longer compiles or runs. Evidence: x; y."
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [
        (1, 1, 0, "5.0 | a | HARD_BREAK | 1 | 0 | false"), (1, 1, 1, "evidence: x"), (1, 1, 2, "evidence: y"),
        (1, 2, 0, "2.0 | b | UNAFFECTED | 1 | 0 | false"), (1, 4, 0, "0.5 | d | 1 | 0 | false"),
        (2, 1, 0, loud), (2, 2, 0, "safe: b"), (2, 3, 0, "safe: c"),
    ]


# Earlier names win, also where a later one stands first or holds them.
TABLES = ["bookings", "rooms", "guest_rooms", "guests", "stays"]
WORKLOAD = [
    "select g.name from guests g join bookings b using (guest_id)", "select max(price) from guest_rooms",
    "select floor, count(*) from rooms group by floor", "select 2 + 2", "update stays set night = 3", "select 2 + 2",
]


def test_statements_are_attributed_and_counted_once(spark):
    rows = spark.createDataFrame(list(enumerate(WORKLOAD)), "statement_id int, statement string")
    targets = [r.target for r in usage.attribute_statements(rows, TABLES).orderBy("statement_id").collect()]
    assert targets == ["bookings", "rooms", "rooms", usage.DEFAULT_TABLE, "stays", usage.DEFAULT_TABLE]
    long = usage.attribute_statements(rows, [f"absent{i}" for i in range(100_000)] + TABLES).orderBy("statement_id").collect()
    assert [r.target for r in long] == targets
    listed = spark.createDataFrame([(k, n) for k, n in enumerate([None, *TABLES])], "priority int, table_name string")
    assert [r.target for r in usage.attribute_statements(rows, listed).orderBy("statement_id").collect()] == targets


def test_attribution_in_blocks_and_of_odd_texts(spark, monkeypatch):
    rng = random.Random(4)
    names = ["".join(rng.choice("ab é") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randrange(0, 9))) for _ in range(80)] + [None, "", "c" * 100_000 + "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "statement_id int, statement string").withColumn("extra", F.array(F.lit(1)))
    expected = [next((n for n in names if t is not None and n in t), "none") for t in texts]
    for chars in (1 << 23, 7):
        monkeypatch.setattr(usage, "BLOCK_CHARS", chars)
        found = usage.attribute_statements(rows, names, "none").orderBy("statement_id").collect()
        assert [r.target for r in found] == expected and found[0].extra == [1]
    some = usage.attribute_statements(rows, ["zz", "", "ab"], "none").collect()
    assert {r.target for r in some if r.statement is not None} == {""} and {r.target for r in some if r.statement is None} == {"none"}
    assert {r.target for r in usage.attribute_statements(rows, [], "none").collect()} == {"none"}


def test_sliding_windows_count_each_query_once_a_day(spark):
    days = ["2024-01-01", "2024-01-01", "2024-01-30", "2024-01-31", "2024-03-01"]
    log = spark.createDataFrame([("a", d) for d in days] + [("b", days[0])], "node string, ts string")
    rows = usage.usage_sliding(log.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    got = {(r.node, str(r.usage_date)): r.recent_queries for r in rows}
    assert got == {("a", days[0]): 2, ("a", days[2]): 3, ("a", days[3]): 2, ("a", days[4]): 1, ("b", days[0]): 1}


def test_reads_and_stars_skip_comments_and_own_names(spark):
    sql = ('with base as (select a.* from "W"."Public"."Raw_Orders" a), other as (select 1)\n'
           "select count(*), b.x -- from public.hidden\nfrom base b join stg on 1 = 1 /* join public.gone */ join other on true\n")
    rows = spark.createDataFrame([("m", sql)], "path string, compiled_text string")
    reads = {(r.schema_name, r.table_name) for r in classify.table_refs(rows).collect()}
    assert reads == {("public", "raw_orders"), ("", "stg")}
    assert [r.alias for r in classify.star_aliases(rows).collect()] == ["a"]


def test_missing_texts_degrade_instead_of_failing(spark):
    rows = spark.createDataFrame([("m", "select *", None)], "path string, source_text string, compiled_text string")
    row = classify.star_exposure(rows).collect()[0]
    assert (row.is_readable, row.select_star_exposure) == (False, False) and "could not be checked" in row.star_evidence[0]


def test_evidence_takes_special_characters_literally(spark):
    rows = spark.createDataFrame([("m", "select\n  a+b,\n  \"x.y\",\n  xzy\n")], "path string, source_text string")
    found = classify.line_evidence(rows, F.lit("x.y")).collect()
    assert [r.evidence for r in found] == ['m:3: "x.y",']


def test_attempts_past_the_cap_do_not_count(spark):
    rows = [("r", n, n == 4, ("V1", False, "m", f"error {n}") if n < 4 else None) for n in range(1, 5)]
    df = spark.createDataFrame(rows, f"run_id string, attempt_number int, passed boolean, first_failure {verify.OUTCOME_TYPE}")
    row = verify.attempt_summary(df).collect()[0]
    assert (row.attempts, row.attempts_past_cap, row.final_status, row.last_failure) == (3, 1, "NEEDS_HUMAN", "error 3")
    late = verify.attempt_summary(df.filter("attempt_number > 3")).first()
    assert (late.attempts, late.attempts_past_cap, late.final_status, late.last_failure) == (0, 1, "NEEDS_HUMAN", None)


def test_copies_of_a_statement_are_one(spark):
    rows = spark.createDataFrame(list(enumerate(WORKLOAD)), "statement_id int, statement string")
    assert sorted(r.copies for r in usage.distinct_statements(rows).collect()) == [1, 1, 1, 1, 2]


def test_plain_texts_are_scanned_as_the_fold_scans_them(spark):
    """The short way for plain selects finds what the fold finds, and other texts still take the fold."""
    rng = random.Random(11)
    items = ["*", "a.*", "S . *", "o.b.*", "a", "o.a", "x as y", "2b.c", "count(*) as n", "sum(o.a) * 2", "f(a).*", "* *", "a * b", "f((a))",
             "distinct a", "on", "(a", "b)", ".*", "é", "'x, *'", "case", "(select * from u)"]
    names = ["t", "Pub.T", '"Pub"."ÄΣ"', "a . b", '"a b".c', "`q`.x", '"order"', "order", "lateral t", "a,b", "a.", '"x`"', '""', "f(x)", "x.select"]
    ends = ["", "\n", " as s", " s ", ' as "s"', " s as", " where a = 1", " order", " join b", ";", " as with", "\x02", "$"]
    texts = {
        f"{rng.choice(['select', 'SELECT', ' select', 'select distinct', 'with q as (select 1) select'])}{rng.choice([' ', chr(10), ''])}"
        f"{rng.choice([', ', ',', ' , ']).join(rng.choice(items) for _ in range(rng.randrange(1, 4)))}{rng.choice([' ', chr(10), ''])}from "
        f"{rng.choice(names)}{rng.choice(ends)}"
        for _ in range(3000)
    }
    rows = spark.createDataFrame([(t,) for t in [None, "", "select", "select " + "a, f(b), " * 50_000 + "c.* from t", "select " + "(" * 1000, *texts]], "sql string")
    sql = F.col("sql")
    found = rows.select("sql", clauses.scan(sql).alias("scan"), clauses.fold(sql).alias("fold")).collect()
    assert [r.sql for r in found if r.scan != r.fold] == []
    plain = rows.filter(F.rlike(sql, F.lit(clauses._PLAIN))).count()
    assert 300 < plain < 2500


def test_comments_go_alike_with_and_without_marks(spark):
    texts = ["a", "a -- b\nc", "a /* -- */ b", "'--' x", "'a' 'b'", "/* ' */ a '/*' -- '", "-- /*\n*/", None, "a-b/c"]
    both = r"(?s)('[^']*'|/\*.*?\*/)|--[^\n]*", r"(?s)('[^']*')|/\*.*?\*/"
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plainly = F.regexp_replace(F.regexp_replace("t", both[0], "$1"), both[1], "$1 ")
    assert all(a == b for a, b in rows.select(text.without_comments(F.col("t")), plainly).collect())


def test_severity_and_origins_are_measured_where_pairs_lie(spark, estate):
    columns = ("change_id", "node", "file_path", "hop", "compile_status", "break_mode", "severity_score")
    rows, every = measure(estate, columns), assess(estate)
    assert sorted(map(str, rows.collect())) == sorted(map(str, every.select(*columns).collect()))
    assert sorted(patch.origin_models(rows).collect()) == sorted(patch.origin_models(every).collect()) != []
