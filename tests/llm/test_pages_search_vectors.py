"""Page text, ranked search and whitening beside brute force."""

import html
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from faultline.llm import page_text, ranked_search, whitening
from faultline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("text", "n_chars", "name", "check", "page", "names", "repeats", "at")],
])


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, *["other"] * 8) for r in rows], PAGES).repartition(3)


def texts_of(spark, rows):
    out = {}
    for r in page_text.extract(pages_of(spark, rows)).collect():
        assert r.n_chars == len(r.text)
        out.setdefault(r.page_id, []).append(r.text)
    return out


def test_articles_are_whole(spark):
    """Every given page: the text between the article tags, block by block."""
    rows = {r.page_id: r for r in QUERIES["op11_host_suffix_array"](spark, SF_DIR).collect()}
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*)</article>", page.html, re.S).group(1)
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1|br|b)>", article))
        assert rows[page.page_id].text == "\n".join(b for b in blocks if b)
        assert rows[page.page_id].n_repeated == 0


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("plain &lt; words", "plain < words"),
    ("<main><header><h1>A &amp; b</h1><i>by me</i></header><p>One<p>Two<aside>no</aside><li>a<li>b</main>", "A & b\nOne\nTwo\na\nb"),
    ("<form><main><p>in a form</p><form><p>no</p></form></main></form>", "in a form"),
    ("<nav><a>no</a><article><p>kept</article>", "kept"),
    ("<article><p>x<div class='comments-area'><article>reader</article></div><p>y</article>", "x\ny"),
    ("<article><p>a<br>b   <b>c</b>d</p><script>if (a < b) '</p>'</script><style>p{}</style></article>", "a b cd"),
    ("<body class='has-sidebar'><div class='with-ads-none'>open</div><div id=cookie-banner>no</div><div hidden>too</div>", "open\ntoo"),
    ("<main><p>main</p><article><p>article</p></article></main>", "article"),
    ("<article> &nbsp; </article><p>open</p>", "open"),
    ("<p>&#233;&hellip;&unknown; &copy</p>", "é…&unknown; ©"),
    ("<div role=navigation>no</div><p class=ad>no<p>yes", "yes"),
    ("<i>x" * 20000, " ".join(["x" * 20000])),
])
def test_markup(spark, source, text):
    blocks = page_text.blocks_of(source)
    level = page_text.wanted_level(blocks)
    assert "\n".join(" ".join(w) for at, chrome, w in blocks if at == level and not chrome) == text


def covered_by_force(streams, mine):
    """Tokens of ``mine`` in a run of MIN_RUN or more that another stream holds, longest runs and all."""
    out = set()
    for other in streams:
        if other == mine:
            continue
        for i in range(len(mine)):
            for j in range(len(other)):
                n = 0
                while i + n < len(mine) and j + n < len(other) and mine[i + n] == other[j + n]:
                    n += 1
                if n >= page_text.MIN_RUN:
                    out |= set(range(i, i + n))
    return out


def test_open_pages_lose_what_their_host_repeats(spark):
    rng = random.Random(5)
    notice = "we and our partners store data on this device to measure visits".split()
    rows = []
    for k in range(24):
        host = "https://a.example/x" if k % 3 else "//B.example:80/"
        own = [f"w{rng.randrange(40)}" for _ in range(30)]
        menu = "".join(f"<li>{m}</li>" for m in ["home", "news", "sport", "about", "help"])
        body = f"<div><p>{' '.join(own[:15])}</p><div>{' '.join(notice[rng.randrange(4):])}</div><p>{' '.join(own[15:])}</p></div>"
        rows.append((k, f"{host}{k}", f"<ul>{menu}</ul>{body}<nav>menu words</nav>"))
    rows.append((100, rows[1][1], "<article><p>all of the article stays</p></article><div>" + " ".join(notice) + "</div>"))
    rows.append((101, *rows[2][1:]))  # a copy is no evidence against itself
    found = texts_of(spark, rows)
    streams = {}
    for page, url, source in rows:
        blocks = page_text.blocks_of(source)
        streams.setdefault(page_text.host_of(url), []).append((page, page_text.stream_of(blocks), blocks))
    assert set(streams) == {"a.example", "b.example"}
    for members in streams.values():
        for page, stream, blocks in members:
            if page == 100:
                assert found[page] == ["all of the article stays"]
                continue
            gone, at, lines = covered_by_force([s for _, s, _ in members], stream), 1, []
            for _, chrome, words in blocks:
                kept = [w for k, w in enumerate(words) if at + k not in gone]
                at += len(words) + 1
                if kept and not chrome:
                    lines.append(" ".join(kept))
            assert found[page] == ["\n".join(lines)]
            assert "partners" not in found[page][0] and "sport" not in found[page][0] and lines


def test_hard_pages(spark):
    same = "<p>one two three four five six seven eight nine ten</p>"
    rows = [(1, None, None), (2, None, ""), (3, "u", same), (3, "u", same), (None, None, same), (5, "//h", "<p>" + "long word " * 50000)]
    found = texts_of(spark, rows)
    assert found[1] == found[2] == [""] and len(found[3]) == 2 and found[3][0].startswith("one") and len(found[5][0]) == 499_999
    assert found[None][0].startswith("one")
    assert page_text.extract(pages_of(spark, rows).limit(0)).count() == 0


def scores_by_force(items, docs):
    split = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return split.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    listed = [(doc_id, terms(text)) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in listed), sum(len(t) for _, t in listed)
    frequency = {}
    for _, t in listed:
        for term in set(t):
            frequency[term] = frequency.get(term, 0) + 1
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, found in listed:
            score = 0
            for term in terms(text):
                tf = found.count(term)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[term] + 1)))
                    m = 100 - 25 + (25 * len(found) * n_docs) // n_terms
                    score += w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:ranked_search.TOP], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("items_at_once, cells", [(512, 1 << 22), (3, 64)])
def test_search_equals_brute_force(spark, monkeypatch, items_at_once, cells):
    monkeypatch.setattr(ranked_search, "MAX_ITEMS", items_at_once)
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Été", "漢字", "A-b", "x_y"]

    def text():
        return " ".join(words[min(63, int(rng.expovariate(0.08)))] for _ in range(rng.randrange(1, 60)))

    docs = [(k, text()) for k in range(300)] + [(300, None), (301, ""), (302, "?!"), (None, "w1 w2 W3")]
    docs += [(400 + k, docs[5][1]) for k in range(40)] + [(7, docs[7][1])]
    items = [(k, text()) for k in range(11)] + [(20, None), (21, "nowhere to be found"), (22, "w1 w1 w1 W1"), (3, "w2 été")]
    schema = "doc_id long, text string, score string, n string, places string"
    documents = spark.createDataFrame([(*d, "x", "x", "x") for d in docs], schema).repartition(5)
    found = ranked_search.search(spark.createDataFrame(items, "item_id long, text string"), documents)
    assert sorted([tuple(r) for r in found.collect()], key=str) == scores_by_force(items, docs)


def test_search_skips_pairs_without_changing_results():
    """Bounds leave most pairs unscored where documents differ, and the best are the same."""
    rng = np.random.default_rng(2)
    terms = {str(k).encode(): k for k in range(400)}
    items = [{int(t): 1 for t in 50 * (k % 8) + rng.choice(50, 12, False)} for k in range(64)]
    block = ranked_search.Block(list(range(64)), terms, items)
    corpus = ranked_search.Corpus(4096, 4096 * 20, np.full(400, 2000, np.int64))
    search = ranked_search.Search(block, corpus, 5)
    best = [[] for _ in items]
    for start in range(0, 4096, 512):
        places = [np.sort(50 * int(rng.integers(8)) + rng.choice(50, 20, False)) for _ in range(512)]
        counts = [rng.integers(1, 4, 20) for _ in range(512)]
        dense = ranked_search.gains(places, counts, np.full(512, 20), corpus)
        search.add(list(range(start, start + 512)), dense)
        for k, item in enumerate(items):
            score = dense[:, list(item)].sum(axis=1)
            best[k] += [(int(s), start + d) for d, s in enumerate(score) if s > 0]
    assert search.best == [sorted(b, key=lambda h: (-h[0], h[1]))[:5] for b in best]
    assert search.pairs_scored < 0.35 * 64 * 4096


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranked_search.search(items.limit(0), docs).count() == 0
    assert ranked_search.search(items, docs.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.search(items, docs.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, "a b " * 200_000), (2, "b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in ranked_search.search(items, huge).collect()] == [(1, 1, 1)]


def spectra():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 40):
        basis = np.linalg.qr(rng.standard_normal((size, size)))[0]
        half = max(1, size // 2)
        for values in (rng.random(size) * 100, np.repeat([5.0, 3.0, 1.0], size)[:size], 10.0 ** -np.arange(size),
                       np.concatenate([np.ones(half), np.zeros(size - half)])):
            values = np.sort(values)[::-1]
            whole = (basis * values) @ basis.T
            yield values, (whole + whole.T) / 2


def test_slices_of_known_spectra():
    for values, matrix in spectra():
        for shift in np.linspace(-0.1, 1.1, 13) * values[0] + 1.7e-3:
            assert whitening.count_above(matrix, shift) == (values > shift).sum()
        found, vectors = whitening.leading_components(matrix, 32)
        n = len(found)
        assert n == min(32, (values > 4 * whitening.RESOLUTION * np.abs(matrix).sum(axis=1).max()).sum())
        assert np.abs(found - values[:n]).max() < 1e-13 * values[0] and (np.diff(found) <= 1e-13 * values[0]).all()
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-7
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * values[0]


def whitened_by_force(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    off = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(off.T @ off / n)
    values, basis = values[::-1], basis[:, ::-1]
    deviation = [sum(int(n * a - b) ** 2 for a, b in zip(row.tolist(), sums.tolist())) for row in x]
    return n, deviation, off @ basis / np.sqrt(values), values / values.sum()


def check_whitened(rows, ids, vectors, components):
    n, deviation, projected, share = whitened_by_force(vectors)
    assert len(rows) == n * components
    by_row = {}
    for r in rows:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for k, vec_id in enumerate(ids):
        assert sorted(by_row[vec_id]) == list(range(1, components + 1))
        for c, r in by_row[vec_id].items():
            assert (r.n, r.deviation) == (n, deviation[k]) and r.identity_error <= 1e-9
            assert abs(r.explained - share[c - 1]) < 1e-9 * share[c - 1]
            sign = signs.setdefault(c, np.sign(r.whitened) * np.sign(projected[k, c - 1]))
            assert abs(r.whitened - sign * projected[k, c - 1]) < 1e-7


def test_whitening_equals_brute_force(spark):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    rows = QUERIES["op13_spectrum_slicing"](spark, SF_DIR).collect()
    check_whitened(rows, [i for i, _ in given], [v for _, v in given], 32)


def test_whitening_of_hard_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k, (rng.standard_normal(5) * [9, 5, 3, 2, 1]).tolist()) for k in range(60)]
    good += [(60, good[0][1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("-inf")] * 5), (105, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, n string, whitened string, component string, deviation string"
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in good + bad], schema).repartition(4)
    check_whitened(whitening.whiten(table).collect(), [k for k, _ in good], [v for _, v in good], 5)
    for few in (table.limit(0), table.filter("vec_id > 99"), table.filter("vec_id = 3")):
        assert whitening.whiten(few).filter("vec_id < 105 and vec_id <> 3").count() == 0
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 5.0]), (4, [1.0, 5.0])], "vec_id long, embedding array<double>")
    out = whitening.whiten(far)
    assert out.filter("vec_id is null").count() == out.filter("vec_id = 1").count() > 0


def test_a_page_is_parsed_once(spark, monkeypatch):
    parses, parse = spark.sparkContext.accumulator(0), page_text.blocks_of

    def counted(source):
        parses.add(1)
        return parse(source)

    monkeypatch.setattr(page_text, "blocks_of", counted)
    menu = "<div>" + "".join(f"<p>{m}</p>" for m in ["home", "news", "sport", "about"]) + "</div>"
    rows = [(k, f"//h/{k}", f"{menu}<article><p>article {k}</p></article><p>own{k}</p>") for k in range(4)]
    rows.append((4, "//h/4", f"{menu}<p>{' '.join(f'w{k}' for k in range(9))}</p>"))
    assert texts_of(spark, rows) == {**{k: [f"article {k}"] for k in range(4)}, 4: [" ".join(f"w{k}" for k in range(9))]}
    assert parses.value == len(rows)


def test_pages_with_an_article_are_looked_up_too(spark):
    """What the host repeats beside an article is counted, and the article stays whole."""
    notice = "we and our partners store data on this device to measure visits"
    rows = [(k, f"//h/{k}", f"<nav>menu own{k}</nav><article><p>{notice}</p></article><div>{notice}</div>") for k in range(3)]
    rows += [(3, "//other/3", rows[0][2]), (4, "//h/4", f"<div>{notice}</div><p>all of this page's own words stay</p><nav>x {notice}</nav>")]
    found = {r.page_id: r for r in page_text.extract(pages_of(spark, rows)).collect()}
    assert {k: (r.text, r.n_repeated, r.n_beside) for k, r in found.items()} == {
        **{k: (notice, 0, 12) for k in range(3)}, 3: (notice, 0, 0), 4: ("all of this page's own words stay", 12, 12)}


def test_pages_stay_where_they_were_parsed(spark):
    """No exchange holds the texts: what is found of a page comes to them."""
    rows = [(k, f"//h/{k}", f"<article><p>text {k}</p></article><div>{'a b c d e f g h i'}</div>") for k in range(5)]
    plan = page_text.extract(pages_of(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "article" in line]
    assert "Bucketed: true" in plan
