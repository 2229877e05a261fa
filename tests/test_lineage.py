import random

from pyspark.sql import functions as F

from faultline.operators import graph, siblings
from faultline.plans import assessment
from faultline.sources import files, schemas


def brute(seeds, edges, hops):
    found = {}
    for change, start in seeds:
        level, seen = {start}, {start}
        for hop in range(1, hops + 1):
            level = {d for s, d in edges if s in level} - seen
            seen |= level
            found.update({(change, node): hop for node in level})
    return found


def as_dict(df):
    return {(r.change_id, r.node): r.hop for r in df.collect()}


def frames(spark, seeds, edges):
    return (
        spark.createDataFrame(seeds, "change_id string, node string"),
        spark.createDataFrame(edges, "src string, dst string"),
    )


def test_reach_equals_brute_force_on_cyclic_graphs(spark):
    rng = random.Random(7)
    nodes = [f"n{i}" for i in range(30)]
    edges = list({(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)}) + [("n0", f"n{i}") for i in range(1, 20)]
    seeds = [("c0", "n0"), ("c1", "n3"), ("c2", "n29"), ("c3", "absent")]
    s, e = frames(spark, seeds, edges)
    for hops in (1, 3, 5):
        assert as_dict(graph.downstream_reach(s, e, hops)) == brute(seeds, edges, hops)
    assert as_dict(graph.downstream_reach(s, e, None)) == brute(seeds, edges, len(nodes))


def test_unbounded_search_reaches_the_end_of_a_chain_with_a_cycle(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n12", "n4"), ("n0", "n7")]
    s, e = frames(spark, [("c", "n0")], edges)
    found = as_dict(graph.downstream_reach(s, e, None))
    assert found == brute([("c", "n0")], edges, 20) and found["c", "n12"] == 6 and found["c", "n6"] == 6


def test_jobs_reach_what_their_edges_reach(spark):
    inlets = [("j1", "a"), ("j1", "b"), ("j2", "c")]
    outlets = [("j1", "c"), ("j1", "d"), ("j2", "a"), ("j2", "e")]
    i = spark.createDataFrame(inlets, "job_id string, node string")
    o = spark.createDataFrame(outlets, "job_id string, node string")
    seeds = spark.createDataFrame([("x", "a"), ("y", "c")], "change_id string, node string")
    none = spark.createDataFrame([], "src string, dst string")
    pairs = graph.job_edges(i, o)
    assert pairs.count() == 6
    assert as_dict(graph.downstream_reach(seeds, none, jobs=(i, o))) == as_dict(graph.downstream_reach(seeds, pairs))


def test_column_search_follows_renames_only(spark):
    edges = spark.createDataFrame(
        [("t", "a", "u", "b"), ("u", "b", "v", "c"), ("u", "a", "w", "a"), ("t", "z", "w", "z")],
        "src string, src_col string, dst string, dst_col string",
    )
    seeds = spark.createDataFrame([("x", "t", "a")], "change_id string, node string, column_name string")
    rows = {(r.node, r.column_name, r.hop) for r in graph.column_reach(seeds, edges).collect()}
    assert rows == {("u", "b", 1), ("v", "c", 2)}


def exposed_by_force(seeds, edges, boards, hops):
    """Pairs whose node feeds, within the hops, a dashboard that the change reaches within them."""
    reached = brute(seeds, edges, hops)
    fed = brute([(b, b) for b in boards], [(d, s) for s, d in edges], hops)
    out = set()
    for change, node in reached:
        # A walk that leaves a dashboard and comes back to it counts for the nodes between.
        if any((change, b) in reached and ((b, node) in fed) for b in boards):
            out.add((change, node))
    return out


def test_exposure_equals_the_pairs_of_every_dashboard(spark):
    rng = random.Random(11)
    nodes = [f"n{i:02d}" for i in range(60)]
    edges = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(90)})
    boards = rng.sample(nodes[20:], 12)
    seeds = [(f"c{i}", nodes[i]) for i in range(12)]
    s, e = frames(spark, seeds, edges)
    d = spark.createDataFrame([(b,) for b in boards], "node string")
    for hops in (1, 2, 3, None):
        reach = graph.downstream_reach(s, e, hops)
        sets = graph.dashboard_sets(d, e, hops)
        got = {(r.change_id, r.node) for r in graph.dashboard_exposure(reach, s, sets, hops).collect()}
        assert got == exposed_by_force(seeds, edges, boards, hops or len(nodes))


def test_sets_of_more_dashboards_than_one_number_holds(spark):
    boards = [f"d{i:03d}" for i in range(150)]
    edges = [("a", b) for b in boards[::2]] + [("b", b) for b in boards[1::2]] + [("c", "a"), ("x", "c"), ("y", "b")]
    s, e = frames(spark, [("cx", "x"), ("cy", "y")], edges)
    sets = graph.dashboard_sets(spark.createDataFrame([(b,) for b in boards], "node string"), e, 3)
    rows = sets.collect()
    assert len(rows) == len({(r.node, r.block) for r in rows}) and {r.block for r in rows} == {0, 1, 2}
    bits = {}
    for r in rows:
        bits[r.node] = bits.get(r.node, 0) + bin(r.members & (2**64 - 1)).count("1")
    assert bits == {"a": 75, "b": 75, "c": 75, "x": 75, "y": 75}
    reach = graph.downstream_reach(s, e, 3)
    got = {(r.change_id, r.node) for r in graph.dashboard_exposure(reach, s, sets, 3).collect()}
    assert got == {("cx", "c"), ("cx", "a"), ("cy", "b")}


def test_exposure_on_cycles_and_without_dashboards(spark):
    s, e = frames(spark, [("x", "t")], [("t", "a"), ("a", "d1"), ("d1", "a"), ("t", "b"), ("b", "b")])
    reach = graph.downstream_reach(s, e)
    one = spark.createDataFrame([("d1",), ("d1",)], "node string")
    sets = graph.dashboard_sets(one, e)
    assert {r.node for r in graph.dashboard_exposure(reach, s, sets).collect()} == {"a", "d1"}
    assert graph.dashboard_exposure(reach, s, graph.dashboard_sets(one.limit(0), e)).count() == 0
    assert graph.dashboard_sets(one, e, 0).count() == 0


def test_hubs_are_dealt_over_salts(spark):
    edges = [("hub", f"n{i}") for i in range(1000)] + [(f"n{i}", f"m{i}") for i in range(20)] + [("m1", "hub")]
    s, e = frames(spark, [("c", "hub"), ("d", "n1"), ("e", "absent")], edges)
    assert as_dict(graph.downstream_reach(s, e, hub_edges=50)) == as_dict(graph.downstream_reach(s, e)) == brute(
        [("c", "hub"), ("d", "n1")], edges, 10)
    near = graph.adjacency(e.select(F.col("src").alias("src_node"), F.col("dst").alias("dst_node")), ("node",), 50)
    assert [tuple(r) for r in near.hubs.collect()] == [("hub", 20)]
    share = near.edges.filter("src_node = 'hub'").groupBy("_salt").count().collect()
    assert len(share) == 20 and max(r["count"] for r in share) < 100
    spark.sql(f"DROP TABLE {near.table}")


def test_edges_are_not_shuffled_by_a_hop(spark):
    s, e = frames(spark, [("c", "a")], [("a", "b"), ("b", "c")])
    near = graph.adjacency(e.select(F.col("src").alias("src_node"), F.col("dst").alias("dst_node")), ("node",))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph._advance(s, near, ("change_id",), ("node",))._jdf.queryExecution().sparkPlan().toString()
        executed = graph._advance(s, near, ("change_id",), ("node",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Bucketed: true" in executed and executed.count("Exchange hashpartitioning") == 1, plan
    spark.sql(f"DROP TABLE {near.table}")


def test_searches_leave_no_catalog_tables(spark):
    s, e = frames(spark, [("c", "a")], [("a", "b"), ("b", "c")])
    before = {t.name for t in spark.catalog.listTables()}
    reach = graph.downstream_reach(s, e)
    graph.dashboard_sets(spark.createDataFrame([("c",)], "node string"), e)
    assert {t.name for t in spark.catalog.listTables()} == before and reach.count() == 2


def test_budget_keeps_the_nearest_and_says_so(spark):
    rows = [("x", f"n{i:02d}", 1 + i // 10) for i in range(40)] + [("y", "m", 1)]
    scanned = spark.createDataFrame(rows, "change_id string, node string, hop int")
    boards = spark.createDataFrame([("x", "d1"), ("x", "d2")], "change_id string, dashboard string")
    got = graph.bounded_scan(scanned, boards, budget=10).collect()
    assert sorted(r.node for r in got if r.change_id == "x") == [f"n{i:02d}" for i in range(6)]
    assert {r.change_id: r.truncated for r in got} == {"x": True, "y": False}


ENTITY = (
    "change_id string, node string, degree int, entity struct<urn:string,type:string,name:string,"
    "properties:struct<customProperties:array<struct<key:string,value:string>>>,"
    "ownership:struct<owners:array<struct<owner:struct<urn:string>,type:string>>>>"
)


def entity(urn, kind="DATASET", path=None, owners=()):
    props = [("other", "x"), ("dbt_file_path", path)] if path else None
    return (urn, kind, "public.fct_revenue", (props,), ([((o,), t) for o, t in owners],))


def test_siblings_become_one_asset_with_the_nearest_hop(spark):
    rows = [
        ("c", "fct_revenue", 2, entity("urn:li:dataset:(urn:li:dataPlatform:postgres,w.public.fct_revenue,PROD)",
                                       owners=[("urn:li:corpuser:asmith", "BUSINESS_OWNER")])),
        ("c", "fct_revenue", 3, entity("urn:li:dataset:(urn:li:dataPlatform:dbt,w.public.fct_revenue,PROD)",
                                       path="models/marts/fct_revenue.sql")),
        ("c", "board", 1, entity("urn:li:dashboard:(bi,board)", "DASHBOARD")),
    ]
    merged = siblings.merge_siblings(spark.createDataFrame(rows, ENTITY))
    asset = siblings.coalesce_siblings(merged).collect()
    assert len(asset) == 1
    assert (asset[0].hop, asset[0].file_path, asset[0].has_business_owner) == (2, "models/marts/fct_revenue.sql", True)
    assert asset[0].owners == ["urn:li:corpuser:asmith"] and "postgres" in asset[0].urn


def test_urn_resolution_prefers_the_schema_then_falls_back(spark):
    urn = "urn:li:dataset:(urn:li:dataPlatform:postgres,w.{}.t,PROD)"
    requests = spark.createDataFrame(
        [("r1", "t", "public", "postgres"), ("r2", "t", "absent", "postgres"), ("r3", "t", "public", "mysql")],
        "request_id string, table_name string, schema_name string, platform string",
    )
    hits = [(r, urn.format(s), k) for r in ("r1", "r2", "r3") for k, s in enumerate(["archive", "public"])]
    got = siblings.resolve_urn(requests, spark.createDataFrame(hits, "request_id string, urn string, search_rank int"))
    assert {r.request_id: r.urn for r in got.collect()} == {
        "r1": urn.format("public"), "r2": urn.format("archive"), "r3": None,
    }


def test_nodes_of_many_edges_change_how_a_hop_runs_not_what_it_finds(spark, monkeypatch):
    rng = random.Random(11)
    nodes = [f"n{i}" for i in range(25)]
    edges = list({(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)}) + [(f"n{i}", "n24") for i in range(20)]
    seeds = [("c0", "n0"), ("c1", "n3"), ("c2", "n24")]
    s, e = frames(spark, seeds, edges)
    monkeypatch.setattr(graph, "WIDE_EDGES", 4)
    near = graph.adjacency(graph._node_edges(e), ("node",), mark_wide=True)
    assert near.wide and near.edges.filter("_wide").select("dst_node").distinct().count() < len(nodes)
    assert as_dict(graph.downstream_reach(s, e, None)) == brute(seeds, edges, len(nodes))


def test_frontiers_on_few_places_take_their_edges_out_first(spark, monkeypatch):
    rng = random.Random(13)
    nodes = [f"n{i}" for i in range(25)]
    edges = list({(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)}) + [(f"n{i}", "n24") for i in range(20)]
    seeds = [("c0", "n0"), ("c1", "n3"), ("c2", "n24"), ("c3", "absent")]
    s, e = frames(spark, seeds, edges)
    taken, take = [], graph._edges_from
    monkeypatch.setattr(graph, "_edges_from", lambda *a: taken.append(take(*a)) or taken[-1])
    expected = brute(seeds, edges, len(nodes))
    assert as_dict(graph.downstream_reach(s, e)) == expected and not taken
    monkeypatch.setattr(graph, "EDGES_PER_START", 1)
    for wide, hub in ((500, 1_000_000), (4, 1_000_000), (4, 3)):
        monkeypatch.setattr(graph, "WIDE_EDGES", wide)
        taken.clear()
        assert as_dict(graph.downstream_reach(s, e, hub_edges=hub)) == expected
        assert taken and all(near.edges.count() <= len(edges) for near in taken)
    # The first hop takes the edges of the three seeds that are there, and no others.
    assert taken[0].edges.count() == sum(src in {"n0", "n3", "n24"} for src, _ in edges)
    i = spark.createDataFrame([("j1", "n0"), ("j2", "n9")], "job_id string, node string")
    o = spark.createDataFrame([("j1", "n9"), ("j2", "far")], "job_id string, node string")
    linked = e.unionByName(graph.job_edges(i, o).select("src", "dst"))
    assert as_dict(graph.downstream_reach(s, e, jobs=(i, o))) == as_dict(graph.downstream_reach(s, linked))


def test_what_a_search_found_is_grouped_by_node_where_it_lies(spark):
    s, e = frames(spark, [("c", "a"), ("d", "b")], [("a", "b"), ("b", "c"), ("c", "a")])
    per_pair = graph.downstream_reach(s, e).groupBy("node", "change_id").agg(F.min("hop").alias("hop"))
    assert as_dict(per_pair) == {("c", "b"): 1, ("c", "c"): 2, ("d", "c"): 1, ("d", "a"): 2}
    assert "Exchange" not in per_pair._jdf.queryExecution().executedPlan().toString()


def test_lineage_responses_are_packed_and_read_back(spark, tmp_path):
    entity = F.expr(
        "named_struct('urn', concat('urn:li:dataset:', id % 7), 'type', 'DATASET', 'name', 'public.orders', "
        "'properties', named_struct('customProperties', array(named_struct('key', 'file', 'value', 'models/a.sql'))), "
        "'ownership', named_struct('owners', array(named_struct('owner', named_struct('urn', 'urn:li:corpuser:a'), "
        "'type', 'TECHNICAL_OWNER'))))"
    )
    hit = F.struct(entity.alias("entity"), F.lit(1).cast("long").alias("degree"))
    page = F.struct(F.lit(1).cast("long").alias("total"), F.array(hit).alias("searchResults"))
    responses = spark.range(0, 5000, 1, 1).select(F.concat(F.lit("c"), "id").alias("change_id"), page.alias("downstreams"))
    files.write_lineage(responses, f"{tmp_path}/packed")
    files.write_json(responses, f"{tmp_path}/plain")
    sizes = [sum(f.stat().st_size for f in (tmp_path / name).glob("part-*")) for name in ("packed", "plain")]
    assert sizes[0] * 5 < sizes[1]
    rows = files.lineage_hits(files.read_lineage(spark, f"{tmp_path}/packed"))
    assert rows.count() == 5000 and rows.select("entity.urn").distinct().count() == 7


def test_exports_are_packed_and_read_back(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 1).select(
        F.lit("c").alias("change_id"), F.format_string("n%06d", "id").alias("node"), F.repeat(F.lit("reads a "), F.lit(20)).alias("evidence")
    )
    files.export_assessment(rows.limit(1), rows, f"{tmp_path}/export")
    assert sum(f.stat().st_size for f in (tmp_path / "export" / "assets").glob("part-*")) < 3000 * 60
    assert spark.read.schema(rows.schema).json(f"{tmp_path}/export/assets").exceptAll(rows).count() == 0


def test_names_that_share_a_number_get_another_salt(spark, monkeypatch):
    """Numbers stand for names only where no two share one; a search on them finds what names find."""
    names = spark.createDataFrame([(["a", "b", None],), (["b", "cc"],)], "names array<string>")
    assert graph.salt_of([F.col("names")], [names]) == 0
    number = graph.number
    monkeypatch.setattr(graph, "number", lambda name, salt: F.length(name).cast("long") if salt < 2 else number(name, salt))
    assert graph.salt_of([F.col("names")], [names]) == 2
    same = names.select(F.transform("names", lambda n: F.when(n.isNotNull(), "a")).alias("names"))
    assert graph.salt_of([F.col("names")], [same]) == 0 and graph.salt_of([F.col("names")], [names.limit(0)]) == 0
    assert spark.range(1).select(number(F.lit(None).cast("string"), 0)).first()[0] is None


def test_a_reach_on_numbers_is_one_on_names(spark, monkeypatch):
    changes = spark.createDataFrame([("c", "a", "x"), ("d", "b", "x"), ("n", None, "x")], "change_id string, node string, column_name string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "board"), ("b", "ee"), ("c", "a"), (None, "z")], "src string, dst string")
    columns = spark.createDataFrame([("a", "x", "b", "y"), ("b", "y", "q", "x"), ("b", "x", "c", "x")], "src string, src_col string, dst string, dst_col string")
    entities = spark.createDataFrame([("board", ("DASHBOARD",)), ("b", ("DATASET",))], "node string, entity struct<type:string>")
    estate = assessment.Estate(changes, edges, columns, entities, None, None)
    number = graph.number
    for shared in (False, True):
        if shared:
            monkeypatch.setattr(graph, "number", lambda name, salt: F.length(name).cast("long") if salt < 1 else number(name, salt))
        for hops in (None, 2):
            found = assessment.reach(estate, hops)
            plain = graph.impact_reach(changes, edges, columns, hops)
            rows = found.nodes
            assert sorted(map(str, rows.collect())) == sorted(map(str, plain.select(*rows.columns).collect())) and rows.count() > 6
            sets = graph.dashboard_sets(found.boards, edges, hops)
            exposed = graph.dashboard_exposure(plain, changes, sets, hops)
            assert sorted(map(tuple, found.exposed.collect())) == sorted(map(tuple, exposed.select("change_id", "node").collect())) != []
            assert dict(found.pairs.dtypes)["place"] == "bigint" and found.salt == int(shared)


def test_siblings_move_no_more_of_an_entity_than_is_read(spark):
    def entity(urn, kind="DATASET", owner="o"):
        return (urn, kind, "n", ([("k", "v")],), ([((owner,), "BUSINESS_OWNER")],))

    physical, logical = "urn:li:dataset:(urn:li:dataPlatform:postgres,{},PROD)", "urn:li:dataset:(urn:li:dataPlatform:dbt,{},PROD)"
    hits = [("c", "a", 2, entity(physical.format("b"))), ("c", "a", 1, entity(physical.format("z"), owner=None)), ("c", "a", 1, entity(physical.format("y"))),
            ("c", "a", 3, entity(logical.format("a"))), ("d", "a", 1, entity(logical.format("q"))), ("d", "b", 1, entity("x", "DASHBOARD")), ("d", "e", 1, None)]
    rows = spark.createDataFrame(hits, f"change_id string, node string, degree int, entity {schemas.ENTITY}")
    urns = ["change_id", "node", "hop", "physical.urn", "logical.urn"]
    whole, narrow = siblings.merge_siblings(rows).select(*urns), siblings.merge_siblings(rows, first_fields=1).select(*urns)
    assert sorted(map(str, narrow.collect())) == sorted(map(str, whole.collect())) and narrow.count() == 2
    assert siblings.merge_siblings(rows, first_fields=1).schema["physical"].dataType.names == ["urn"]
