"""Exact dedup, quality, SimHash, sharding, licenses."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import components, exact_dedup, license_scan, pu_quality, shard_packing, simhash_trie
from tests_support import unsigned


def test_exact_groups_on_hard_rows(hard):
    rows = hard.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = exact_dedup.exact_groups(hard, fan_in=2).collect()
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max(i for i in ids if i is not None)
    assert sum(r.kept for r in got) == len(groups)
    least = exact_dedup.exact_groups(hard, keep="smallest").collect()
    assert all(r.keep_id == min(i for i in by_digest[r.text_sha256] if i is not None) for r in least)


@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_tree_of_any_width_gives_the_same(given, fan_in):
    many = given.repartition(23)
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(many, fan_in=fan_in).collect()}
    assert rows == {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(given.coalesce(1)).collect()}


def test_drop_copies_keeps_one_row_of_each_text(hard, empty):
    kept = exact_dedup.drop_copies(hard)
    assert kept.columns == hard.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in hard.collect()})
    assert exact_dedup.drop_copies(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0


def test_simhash_of_small_texts():
    assert simhash_trie.simhash("") == 0 and simhash_trie.simhash(" \n") == 0
    assert simhash_trie.simhash("A b") == simhash_trie.simhash("a\tB")
    import xxhash

    assert simhash_trie.simhash("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash_trie.simhash("É x y") != simhash_trie.simhash("é x y")


def linked_groups(fps, max_bits):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                parent[root(b)] = root(a)
    groups = defaultdict(set)
    for f in fps:
        groups[root(f)].add(f)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("node_limit", [20_000, 8])
def test_trie_join_loses_no_link(spark, node_limit):
    rng = random.Random(node_limit)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {0, 1, (1 << 64) - 1, 1 << 63, 0xF, *centres}
    for c in centres:
        for _ in range(60):
            fps.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
            fps.add(c ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)))
    table = spark.createDataFrame([(unsigned(f),) for f in sorted(fps)], "fp long")
    links = simhash_trie.near_links(table, node_limit=node_limit)
    roots = {r.u % (1 << 64): r.root % (1 << 64) for r in components.component_roots(links).collect()}
    groups = defaultdict(set)
    for f in fps:
        groups[roots.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == linked_groups(fps, 3)


def test_finer_views_lose_no_link(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps}
    for n in (10, 10**9, 10**13):
        found = set()
        for order, same in simhash_trie._views(n, 3):
            assert sorted(b for low, width in order for b in range(low, low + width)) == list(range(64))
            agreeing, left = 0, same
            for low, width in order:
                if left <= 0:
                    break
                agreeing |= ((1 << width) - 1) << low
                left -= width
            found |= {(a, b) for a in fps for b in fps if a < b and not (a ^ b) & agreeing}
        near = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
        assert near <= found


def test_near_groups_on_hard_rows(hard, empty):
    got = simhash_trie.near_groups(hard).collect()
    assert len(got) == hard.count()
    by_fp = {simhash_trie.simhash(r.text or ""): None for r in hard.collect()}
    groups = linked_groups(by_fp, 3)
    group_of = {f: k for k, g in enumerate(groups) for f in g}
    least = {}
    for r in got:
        if r.doc_id is not None:
            k = group_of[r.fp % (1 << 64)]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.rep.doc_id == least[group_of[r.fp % (1 << 64)]] for r in got)
    kept = simhash_trie.keep_one_of_each(hard)
    assert kept.columns == hard.columns and kept.count() == len(groups)
    assert simhash_trie.near_groups(empty).count() == 0 and simhash_trie.keep_one_of_each(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    roots = {r.u: r.root for r in components.component_roots(links).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_prior_and_learning_without_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (3000, 2)), rng.normal(-2, 1, (1000, 2))
    mean, scale, w = pu_quality.fit(good[:1500], np.vstack([good[1500:], bad[:500]]), 0.75)
    score = lambda x: pu_quality._logistic(pu_quality.expand((x - mean) / scale) @ w)
    assert (score(good) > 0.5).mean() > 0.9 and (score(bad) < 0.5).mean() > 0.9


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = pu_quality.score_rows(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([s >= 0.7 for s in good]) > 0.98
    assert np.mean([s < 0.7 for s in bad]) > 0.9


def test_quality_on_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(3, 1), (5, 1), (5, 0), (None, 1), (2, None), (0, 0)], "doc_id long, quality int")
    rows = pu_quality.score_rows(hard, labels).collect()
    assert len(rows) == hard.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    nobody = labels.limit(0)
    assert {r.score for r in pu_quality.score_rows(hard, nobody).collect()} == {0.5}
    assert pu_quality.score_rows(empty, labels).count() == 0
    kept = pu_quality.keep_good(hard, labels)
    assert kept.columns == hard.columns and kept.count() == sum(r.predicted for r in rows)


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    import zlib

    taught = {r.doc_id for r in pu_quality.training_labels(labels).collect()}
    assert taught == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_items_go_where_the_dot_product_is_highest():
    vectors = np.array([[0.3, 0.3, 0.3], [0.2, 0.2, 0.2], [0.2, 0.2, 0.2], [0.15, 0.15, 0.15], [0.15, 0.15, 0.15]])
    placed = shard_packing.place_items(vectors, 2)
    loads = [vectors[placed == s].sum(axis=0)[0] for s in (0, 1)]
    # By hand: .3 | .2, then .2 to the emptier side (.3 | .4), .15 to the left, .15 to the right.
    assert np.allclose(loads, [0.45, 0.55])


def test_shards_are_near_equal_and_gapless(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = shard_packing.shard_documents(docs).toPandas()
    by = rows.groupby("shard").agg(b=("size", "sum"), n=("slot", "count"), least=("slot", "min"), most=("slot", "max"), u=("slot", "nunique"))
    assert len(by) == 40 and len(rows) == docs.count()
    assert by.b.max() < 1.02 * by.b.mean() and by.b.min() > 0.98 * by.b.mean()
    assert ((by.least == 0) & (by.most + 1 == by.n) & (by.u == by.n)).all()
    assert shard_packing.shard_documents(empty).count() == 0


def test_a_group_with_a_third_of_the_rows_is_split(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text")
    rows = shard_packing.shard_documents(docs).toPandas()
    by = rows.groupby("shard")["size"].sum()
    assert len(by) == 40 and by.max() < 1.05 * by.mean()


def test_shards_of_hard_rows(hard):
    rows = shard_packing.shard_documents(hard).collect()
    assert len(rows) == hard.count() and {r.law for r in rows} == {"bytes"}
    assert min(r.size for r in rows) == 16 and {r.text_crc32 for r in rows if r["size"] == 16} == {0}


def test_license_markup():
    a = license_scan.Automaton("under the [[old [[x]]]] {{1-2}} license", "l")
    accepted = {"under the a license": 4, "under the old a b license": 6, "under the old x a license": 6}
    for text, n in accepted.items():
        assert a.longest(text.encode().split(), 0) == n
    for text in ("under the license", "under the x a b license", "under the a b c license", "under a license"):
        assert a.longest(text.encode().split(), 0) == 0


def test_license_scan_of_hard_rows(hard, empty):
    rows = {r.doc_id: r for r in license_scan.scan_licenses(hard).collect()}
    assert (rows[8].base_labels, rows[8].n_base, rows[8].first_word) == ("mit", 1, 4)
    assert rows[9].labels == "apache-2" and rows[0].labels == "" and rows[0].first_word is None
    assert rows[10].n_words == 30_000 and license_scan.scan_licenses(empty).count() == 0


def test_optional_regions_never_change_the_verdict():
    s = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES)
    for text, label in (
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation,"
         " either version 3 of the License, or (at your option) any later version", "gpl-3"),
        ("under the GNU Public License, version 3", ""), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("under the MIT\u00e9 license", ""), ("Copyright (c) 2020 Some Body. All rights reserved", "all-rights-reserved"),
    ):
        assert s.scan(text)[5] == label, text


def test_every_word_of_long_texts_counts():
    s = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES)
    n, places, first, last, *_ = s.scan("under the mit license " + "filler " * 50_000 + "under the mit license")
    assert (n, places, first, last) == (50_008, 2, 0, 50_004)
    assert Counter(s.scan("cc by nc cc by nc")[:4]) == Counter((6, 2, 0, 3))
