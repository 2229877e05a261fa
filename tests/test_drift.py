import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from faultline.operators import drift
from faultline.sources import files, schemas
from faultline.streaming import drift as stream

A, B = [("a", "int"), ("b", "int")], [("a", "int"), ("c", "text")]


def snapshots(spark, rows):
    return spark.createDataFrame(
        [("postgres", schema, table, columns, datetime(2024, 1, day)) for schema, table, columns, day in rows], schemas.SNAPSHOT)


@pytest.mark.parametrize("old, new, expected", [
    ("ab", "ab", []), ("ab", "ac", [("possible_rename", "b", "c")]), ("a", "ab", [("add_column", None, "b")]),
    ("ab", "a", [("drop_column", "b", None)]),
    ("abc", "ade", [("drop_column", "b", None), ("drop_column", "c", None), ("add_column", None, "d"), ("add_column", None, "e")]),
    ("ab", "acd", [("drop_column", "b", None), ("add_column", None, "c"), ("add_column", None, "d")]),
    ("ab", "", [("drop_column", "a", None), ("drop_column", "b", None)]),
    ("", "ab", [("add_column", None, "a"), ("add_column", None, "b")]),
])
def test_names_are_compared_as_sets(spark, old, new, expected):
    def side(names, day):
        return snapshots(spark, [("public", "t", [(n, "int") for n in names], day)])

    rows = drift.snapshot_diff(side(old, 1), side(new, 2)).orderBy("seq").collect()
    assert [(r.change_type, r.old_column, r.new_column) for r in rows] == expected


def test_types_are_reported_apart_and_tables_of_two_schemas_do_not_mix(spark):
    retyped = [("a", "bigint"), ("b", "int")]
    history = snapshots(spark, [("public", "t", A, 1), ("other", "t", B, 2), ("public", "t", retyped, 3)])
    assert drift.history_diff(history).count() == 0
    assert [(r.column_name, r.old_type, r.new_type) for r in drift.type_changes(history).collect()] == [("a", "int", "bigint")]


def test_only_usable_snapshots_load(spark, tmp_path):
    good = {"platform": "p", "schema_name": "s", "table_name": "t", "columns": [{"name": "a", "type": "int"}],
            "captured_at": "2024-01-01T00:00:00.000Z"}
    lines = [json.dumps(good), json.dumps(good)[:40], json.dumps({k: v for k, v in good.items() if k != "columns"}), "[]", ""]
    (tmp_path / "s.json").write_text("\n".join(lines))
    assert files.load_snapshots(spark, str(tmp_path / "s.json")).count() == 1
    assert files.load_snapshots(spark, str(tmp_path / "none")).count() == 0
    assert files.read_outcomes(spark, str(tmp_path / "nothing")).count() == 0


def write(df, path):
    df.coalesce(1).write.mode("append").json(str(path))


def test_stream_pairs_inside_a_batch_survives_a_restart_and_keeps_late_rows(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    first = [("public", "t", A, 3), ("public", "t", B, 5), ("public", "u", A, 1), ("public", "t", A, 4)]
    write(snapshots(spark, first), source)

    def run():
        stream.drift_stream(stream.snapshot_stream(spark, str(source)), out, state)
        rows = stream.read_changes(spark, out).orderBy("captured_at", "seq").collect()
        return [(r.table_name, r.captured_at.day, r.old_column, r.new_column) for r in rows]

    assert run() == [("t", 5, "b", "c")]
    write(snapshots(spark, [("public", "t", A, 2), ("public", "t", A, 6)]), source)
    assert run() == [("t", 5, "b", "c"), ("t", 6, "c", "b")]
    # A late one between two held ones changes what the later of them is compared with.
    write(snapshots(spark, [("public", "t", [("a", "int"), ("d", "int")], 4)]), source)
    write(snapshots(spark, [("public", "t", B, 2)]), source)
    # Day 2 holds a, b and c; 3 drops c; 4 adds d; 5 drops b and d and adds c; 6 has b for c.
    assert [d for _, d, _, _ in run()] == [3, 4, 5, 5, 5, 6]
    assert {(r.captured_at.day, r.batch) for r in stream.late_snapshots(spark, out).collect()} == {(2, 1), (2, 2), (4, 2)}


@pytest.mark.parametrize("n_files, per_batch", [(1, None), (12, 5), (200, 70)])
def test_files_in_any_order_give_the_changes_of_the_history(spark, tmp_path, n_files, per_batch):
    variants = [A, B, A[:1], [*A, ("d", "int")]]
    rows = [("public", f"t{k % 23}", variants[(k * 7 // 3) % 4], 1 + k // 23) for k in range(23 * 28)]
    history = snapshots(spark, rows)
    source = str(tmp_path / "in")
    history.repartition(n_files, F.rand(3)).write.json(source)
    out = str(tmp_path / "out")
    stream.drift_stream(stream.snapshot_stream(spark, source, files_per_batch=per_batch), out, str(tmp_path / "state"))
    found = stream.read_changes(spark, out).collect()
    assert len(found) > 400 and sorted(map(repr, found)) == sorted(map(repr, drift.history_diff(history).collect()))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    add = stream._add_batch(str(tmp_path / "log"))
    one, two = snapshots(spark, [("public", "t", A, 1)]), snapshots(spark, [("public", "t", B, 2)])
    add(one, 0), add(one, 0), add(two, 1), add(two, 1)
    rows = stream.read_changes(spark, str(tmp_path / "log"), "batch").collect()
    assert [(r.batch, r.old_column, r.new_column) for r in rows] == [(1, "b", "c")]


def test_outcomes_follow_the_settled_changes(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for rows in ([("public", "t", A, 1), ("public", "t", B, 3)], [("public", "t", A[:1], 2)]):
        write(snapshots(spark, rows), source)
        stream.outcome_stream(stream.snapshot_stream(spark, source), out, state)
    found = stream.read_outcomes(spark, out).collect()
    assert [(r.batch, r.captured_at.day, r.change_type, r.pipeline_triggered) for r in found] == [
        (0, 3, "add_column", False), (1, 2, "drop_column", False)]
    log = files.read_outcomes(spark, f"{out}/outcomes", schemas.WATCH_CORRECTION).collect()
    assert sorted((r.version, r.op, r.change_type, r.pipeline_triggered) for r in log) == [
        (0, 1, "possible_rename", True), (1, -1, "possible_rename", True), (1, 1, "add_column", False), (1, 1, "drop_column", False)]
    assert stream.read_outcomes(spark, str(tmp_path / "nothing")).count() == 0


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """A batch of one table adds its snapshots and corrections, and leaves all other files alone."""
    out = str(tmp_path / "log")
    add = stream._add_batch(out, outcomes=True)
    add(snapshots(spark, [("public", f"t{k}", A, day) for k in range(300) for day in (1, 4)]), 0)
    held = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*.parquet")}
    add(snapshots(spark, [("public", "t7", B, 3), ("public", "t7", A, 9)]), 1)
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in held.items())
    assert spark.read.parquet(f"{out}/history/batch=1").count() == 2
    assert len([p for p in (tmp_path / "log" / "history" / "batch=1").iterdir() if p.name.startswith("bucket=")]) == 1
    rows = spark.read.parquet(f"{out}/changes/batch=1").collect()
    assert sorted((r.captured_at.day, r.op, r.old_column, r.new_column) for r in rows) == [(3, 1, "b", "c"), (4, 1, "c", "b")]
    add(snapshots(spark, [("public", "t7", A, 2), ("public", "t7", A[:1], 3)]), 2)
    assert [r.op for r in spark.read.parquet(f"{out}/changes/batch=2").collect()] == []
    assert {(r.captured_at.day, r.batch) for r in stream.late_snapshots(spark, out).collect()} == {(3, 1), (2, 2), (3, 2)}


def test_live_schemas_are_snapshots(spark):
    table = spark.createDataFrame([(1, "x")], "b int, a string")
    now = drift.live_snapshots(spark, {"t": table}, "p", "s", F.lit("2024-01-02").cast("timestamp"))
    assert [tuple(c) for c in now.first().columns] == [("a", "string"), ("b", "int")]
    before = spark.createDataFrame([("p", "s", "t", [("b", "int"), ("c", "int")], datetime(2024, 1, 1))], schemas.SNAPSHOT)
    assert [(r.old_column, r.new_column) for r in drift.snapshot_diff(before, now).collect()] == [("c", "a")]


def test_a_name_listed_twice_has_the_first_of_its_types(spark):
    twice = [("a", "int"), ("a", "bigint"), ("b", "int")]
    history = snapshots(spark, [("public", "t", twice, 1), ("public", "t", [("a", "text"), ("a", "date")], 2)])
    assert [(r.column_name, r.old_type, r.new_type) for r in drift.type_changes(history).collect()] == [("a", "bigint", "date")]


def test_only_a_missing_path_is_an_empty_log(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_outcomes(spark, str(tmp_path), "batch BIGINT, seq BIGINT, seq BIGINT")
