import pytest
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.operators import classify, patch, verify
from faultline.sources import files

STG = "-- Explicit cust_id reference\nselect\n    cust_id,\n    email\nfrom {{ source('raw', 'raw_customers') }}\n"


def patched(spark, text, old="cust_id", new="customer_id"):
    rows = spark.createDataFrame([("m", text)], "path string, source_text string")
    return patch.rename_patch(rows, F.lit(old), F.lit(new)).collect()[0]


@pytest.mark.parametrize("line, expected", [
    ("    cust_id,", "    customer_id as cust_id,"), ("\tcust_id", "\tcustomer_id as cust_id"),
    ("    c.cust_id,", "    c.customer_id as cust_id,"),
    ("    cust_id as customer_key,", "    customer_id as customer_key,"),
])
def test_only_the_selecting_line_changes(spark, line, expected):
    text = f"-- cust_id\nselect\n{line}\nfrom t"
    row = patched(spark, text)
    assert (row.patch_status, row.patched_text) == ("PATCHED", f"-- cust_id\nselect\n{expected}\nfrom t")


@pytest.mark.parametrize("text, status", [
    ("select a\nfrom t join u\n  on t.cust_id = u.cust_id\n", "NEEDS_HUMAN"), ("-- cust_id\nselect a from t\n", "NO_ANCHOR"),
    ("select\n  CUST_ID\nfrom t\n", "NO_ANCHOR"), ("select\n  cust_id_2,\n  cust_id\nfrom t\n", "PATCHED"),
])
def test_other_anchors_are_left_alone(spark, text, status):
    row = patched(spark, text)
    assert row.patch_status == status
    assert (row.patched_text == text) == (status != "PATCHED")


def test_diff_and_residue_of_a_patch(spark):
    row = patched(spark, STG + "-- done\nwhere cust_id > 0\n")
    rows = spark.createDataFrame([row])
    assert [(r.line_number, r.after) for r in patch.patch_diff(rows).collect()] == [(3, "    customer_id as cust_id,")]
    assert [r.evidence for r in verify.residue_scan(rows, F.lit("cust_id")).collect()] == ["m:7: where cust_id > 0"]


@pytest.mark.parametrize("text, word", [
    (STG, None), ("select order_id, cust_id from\n", "expected a table"), ("select a from t where (a = 1\n", "parentheses"),
    ("select 'it''s (' from t", None), ("select 'a from t", "quotes"), ("update t", "SELECT"),
    ("{{ config(x) }} select 1", "template"), ("select a /* ( */ from t -- (", None),
])
def test_static_check(spark, text, word):
    rows = spark.createDataFrame([("m", text)], "path string, source_text string")
    row = verify.check_static(rows).collect()[0]
    assert row.passed == (word is None)
    assert word is None or word in row.raw_error


def test_report_stops_at_the_first_failure(spark):
    rows = spark.createDataFrame(
        [("good", "select 1 from {{ ref('a') }}"), ("lost", "select 1 from {{ ref('zz') }}"), ("bad", "select ( from {{ ref('zz') }}")],
        "path string, source_text string")
    models = spark.createDataFrame([("a",)], "model string")
    sources = spark.createDataFrame([], "source_name string, table_name string")
    got = {r.path: r for r in verify.verification_report(rows, models, sources).collect()}
    assert got["good"].passed and [o.level for o in got["good"].outcomes] == ["V1_STATIC", "V2_COMPILE"]
    assert got["lost"].first_failure.level == "V2_COMPILE" and "zz" in got["lost"].first_failure.raw_error
    assert len(got["bad"].outcomes) == 1 and got["bad"].first_failure.level == "V1_STATIC"


def test_no_outcomes_is_not_a_pass(spark):
    rows = spark.createDataFrame([([],)], f"outcomes array<{verify.OUTCOME_TYPE}>")
    assert verify.summarize_outcomes(rows).collect()[0].passed is False


def test_model_files_pair_up_by_relative_path(spark, tmp_path):
    for name, text in {"src/models/a.sql": "x\ny", "src/models/b.sql": "b", "out/models/a.sql": "A"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    source = files.model_texts(spark, str(tmp_path / "src"), "source_text")
    compiled = files.model_texts(spark, str(tmp_path / "out"), "compiled_text")
    rows = {r.path: (r.source_text, r.compiled_text) for r in files.model_corpus(source, compiled).collect()}
    assert rows == {"models/a.sql": ("x\ny", "A"), "models/b.sql": ("b", None)}


def test_outcome_precedence(spark):
    verified = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "change_id string, passed boolean")
    verdicts = spark.createDataFrame([("a", "PASS"), ("b", "PASS"), ("c", "PASS"), ("d", "FAIL")], "change_id string, verdict string")
    residue = spark.createDataFrame([("b",), ("b",), ("c",)], "change_id string")
    got = {r.change_id: (r.outcome, r.residue_lines) for r in verify.outcome_record(verified, verdicts, residue).collect()}
    assert got == {"a": ("SUCCEEDED", 0), "b": ("PARTIAL", 2), "c": ("FAILED", 1), "d": ("FAILED", 0)}


def cleaned(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.t for r in df.select("i", text.without_comments(F.col("t")).alias("t")).orderBy("i").collect()]


def test_comments_of_any_length_are_removed(spark):
    long = "select a /*\n" + " * one more line, it's long\n" * 50_000 + " */ from t"
    got = cleaned(spark, long, "select a -- '\nfrom t", "/**/x/***/y", "a /* never closed")
    assert [" ".join(g.split()) for g in got] == ["select a from t", "select a from t", "x y", "a /* never closed"]


def test_what_looks_like_a_comment_in_a_literal_stays(spark):
    got = cleaned(spark, "select '--', '/*' as x from t -- 'gone", "select 'it''s' /* '--' */ from t where a = '*/'")
    assert [" ".join(g.split()) for g in got] == ["select '--' , '/*' as x from t", "select 'it' 's' from t where a = '*/'"]


@pytest.mark.parametrize("call, resolved", [
    ("{{ ref('a_b') }}", '"a_b"'), ('{{- ref( "a" ) -}}', '"a"'), ("{{ref('pkg', 'm')}}", '"m"'), ("{{ ref('m', v=2) }}", '"m"'),
    ("{{ source('s', \"t\") }}", '"s"."t"'), ("{{ ref('a\") }}", "{{ ref('a\") }}"), ("{{ refs('a') }}", "{{ refs('a') }}"),
])
def test_template_calls(spark, call, resolved):
    df = spark.createDataFrame([(call,)], "t string")
    assert df.select(text.resolve_template(F.col("t"))).first()[0] == resolved


@pytest.mark.parametrize("sql, read, stars", [
    ("select o.id, * from s.t1 a, s.t2 b", ["s.t1", "s.t2"], [None]),
    ("select extract(year from o.d), trim(both 'x' from o.e) from o", ["o"], []),
    ("with q(a) as (select 1 from base), r as materialized (select q.* from q) select * from r, Other", ["base", "other"], ["q", None]),
    ("with recursive r as (select 1 union all select n + 1 from r join w on true) select r.* from r", ["w"], ["r"]),
    ("select distinct on (a, b) * from x.y left join lateral (select t.* from deep t) d on true, last", ["deep", "last", "x.y"], [None, "t"]),
    ("select a * b, count(*), (select max(z.*) from z) from ((p join r on p.a = r.b) join (select 1) w on 1 = 1)", ["p", "r", "z"], []),
    ('select "Al".*, 2 * 3 from "S"."T" as "A", "S"."U" "Al" union all select * from u2 order by a, b', ["s.t", "s.u", "u2"], ["Al", None]),
    ("select * except (a, b) from e1, e2 where x in (select k from sub)", ["e1", "e2", "sub"], [None]),
    ("select cast(x as timestamp with time zone) from c, gen(1, 2) g, unnest(v) where a is distinct from b", ["c"], []),
    ("select 'from lit, x' from db.sch.tab /* from gone, * */ -- , t9\n, t2 where exists (select * from in_exists)",
     ["in_exists", "sch.tab", "t2"], [None]),
    ("", [], []), ("select ((((", [], []), (")))) select 1 from x", ["x"], []), (None, [], []), ("select * from t; select 1 from u", ["t", "u"], [None]),
])
def test_reads_and_stars_by_clause(spark, sql, read, stars):
    rows = spark.createDataFrame([("m", sql)], "path string, compiled_text string")
    found = [f"{r.schema_name}.{r.table_name}".lstrip(".") for r in classify.table_refs(rows).collect()]
    assert sorted(found) == read
    assert sorted((r.alias for r in classify.star_aliases(rows).collect()), key=str) == sorted(stars, key=str)


def test_star_evidence_is_the_line_of_the_star(spark):
    source = "/* p.*\n * note\n*/\nselect\n    a * b,\n    x.id, *,\n    p.* -- all of p\nfrom t p, u x"
    rows = spark.createDataFrame([("m", source, source)], "path string, source_text string, compiled_text string")
    got = classify.star_exposure(rows).first()
    assert got.select_star_exposure and sorted(got.star_evidence) == ["m:6: x.id, *,", "m:7: p.* -- all of p"]


def test_blanked_comments_keep_lines_and_literals(spark):
    rows = spark.createDataFrame([("a /* x\ny */ b -- c\n'-- /* d'\ne - f / g",), (None,)], "t string")
    got = [r[0] for r in rows.select(text.blank_comments(F.col("t"))).collect()]
    assert got == ["a \n b \n'-- /* d'\ne - f / g", None]
