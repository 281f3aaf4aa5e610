"""Chains of steps, references, stop states and orders against brute-force versions."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark import catalog, catalog_trees  # noqa: F401
from foliospark.operators import anchors, chains, ordered, paginate
from foliospark.operators.chains import Step
from foliospark.sources.pages import MOST_ROWS, element_chains, nodes
from foliospark.streaming import limits


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(0, 4) if depth else 3):
        tag = rng.choice(["div", "span", "b", "ul"])
        own = rng.choice(["", ' class="x"', ' class="x y"', ' id="i"'])
        out.append(f"<{tag}{own}>t{random_page(rng, depth + 1) if depth < 4 else ''}</{tag}>")
    return "".join(out)


def brute_select(rows, steps):
    """node_ids that the steps find, by walking down from every match."""
    by = {r.node_id: r.chain for r in rows}
    parent = {i: max((j for j in by if len(by[j]) == len(c) - 1 and j < i), default=None) for i, c in by.items()}

    def fits(step, e):
        if step.tag and e.tag != step.tag or step.ident and e.id != step.ident or any(w not in (e.cls or "").split() for w in (step.cls or "").split()):
            return False
        k, n = (e.nth, e.n_same) if step.tag else (e.place, e.n_all)
        return step.place is None or k == (step.place if step.place > 0 else n + step.place + 1)

    def above(i):
        while (i := parent[i]) is not None:
            yield i
        yield None

    found = {None}
    for step in steps:
        found = {i for i, c in by.items() if fits(step, c[-1]) and (parent[i] in found if step.child else any(a in found for a in above(i)))}
    return found


@pytest.mark.parametrize(
    "steps",
    [
        [Step("div")],
        [Step("div", child=True), Step("b")],
        [Step("div"), Step("div"), Step("div")],
        [Step("div"), Step(child=True, place=-1)],
        [Step(cls="x y"), Step("span", child=True, place=2)],
        [Step("ul"), Step(ident="i"), Step(child=True), Step("b", place=1)],
        [Step(child=True, place=2), Step(cls="x", child=True), Step("span")],
    ],
)
def test_chains(spark, steps):
    rng = random.Random(8)
    pages = [(i, random_page(rng)) for i in range(40)] + [(100, None), (101, ""), (102, "no element")]
    table = element_chains(spark.createDataFrame(pages, "page_id long, html string"))
    rows = table.collect()
    found = {(r.page_id, r.node_id) for r in chains.selected(table, steps).collect()}
    expected = {(p, i) for p, _ in pages for i in brute_select([r for r in rows if r.page_id == p], steps)}
    assert found == expected and found
    assert "Join" not in chains.selected(table, steps)._jdf.queryExecution().toString()


def test_bad_chains(spark):
    table = element_chains(spark.createDataFrame([(1, "<p>")], "page_id long, html string"))
    for steps in ([], [Step()] * 63):
        with pytest.raises(ValueError):
            chains.selected(table, steps)


@pytest.mark.parametrize("nearest", [False, True])
def test_references(spark, nearest):
    docs = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    own = [("a", "one", 3, True), ("a", "gone", 5, False), ("a", "early", 1, False), ("a", "one", 9, True), ("a", "back", 2, False), ("a", "back", 7, True), ("b", "", 1, True)]
    anchors_ = spark.createDataFrame(own, "path string, fragment string, at int, kept boolean")
    refs = [(1, "a", "one", False), (2, "a", "gone", True), (3, "a", "gone", False), (4, "a", "early", False), (5, "a", None, False), (6, "a", "", True), (7, "a", "never", True), (8, "a", "never", False), (9, "z", "one", True), (10, None, None, True), (11, "b", "x", True), (12, "a", "back", False), (1, "a", "one", False)]
    found = {r.ref: (r.kind, r.path, r.at) for r in anchors.bound(spark.createDataFrame(refs, "ref long, path string, fragment string, nav boolean"), docs, anchors_, nearest).collect()}
    none = ("none", None, None)
    expected = {1: ("anchor", "a", 3), 2: ("degraded", "a", None), 3: none, 4: none, 5: ("document", "a", None), 6: ("document", "a", None), 7: ("degraded", "a", None), 8: none, 9: none, 10: none, 11: ("degraded", "b", None), 12: ("anchor", "a", 7)}
    if nearest:
        expected |= {2: ("near", "a", 3), 3: ("near", "a", 3)}
    assert found == expected


def brute_stop(pages, start, most, stop):
    at, seen, urls, why = start, [], [], None
    while True:
        nxt, items = pages.get((start, at), (None, []))
        urls.append(at)
        new = [x for x in dict.fromkeys(items or []) if x not in seen]
        seen += new
        if not items:
            why = "zero-new"
        elif not new:
            why = "loop"
        elif nxt is not None and nxt not in urls and nxt in stop:
            why = "chapter-boundary"
        elif nxt is None or nxt in urls:
            why = "end"
        elif len(urls) == most:
            why = "cap"
        if why:
            return (start, len(urls), len(seen), why), seen
        at = nxt


@pytest.mark.parametrize("most", [1, 5, 8, 50])
def test_stops(spark, most):
    rng = random.Random(most)
    rows, starts = [], []
    for c in range(60):
        n = rng.randint(1, 12)
        names = [f"{c}-{k}" for k in range(n)]
        starts.append(names[0])
        for k, u in enumerate(names):
            nxt = rng.choice([names[k + 1] if k + 1 < n else None] * 8 + [rng.choice(names), None, f"lost{c}"])
            items = rng.choice([[f"i{k}", f"i{k + 1}"]] * 6 + [["i0"], [], None, [f"j{rng.randint(0, 3)}"] * 2])
            rows.append((names[0], u, nxt, items, "x"))
    stop = [f"{c}-{rng.randint(1, 6)}" for c in range(0, 60, 4)]
    pages = spark.createDataFrame(rows, "start string, url string, next string, items array<string>, step string")
    ends, items = paginate.stopped(pages, most, spark.createDataFrame([(x,) for x in stop], "url string"))
    by = {(r[0], r[1]): (r[2], r[3]) for r in rows}
    expected = {s: brute_stop(by, s, most, stop) for s in starts}
    assert {tuple(r) for r in ends.collect()} == {e for e, _ in expected.values()}
    found = {}
    for r in items.orderBy("start", "step", "place").collect():
        found.setdefault(r.start, []).append(r.item)
    assert found == {s: x for s, (_, x) in expected.items() if x}
    assert len({e[3] for e, _ in expected.values()}) >= (2 if most == 1 else 4)


def test_stops_of_nothing(spark):
    none = spark.createDataFrame([], "start string, url string, next string, items array<string>")
    ends, items = paginate.stopped(none)
    assert ends.count() == items.count() == 0


@pytest.mark.parametrize("digit", [1, 2, 6])
def test_distinct_between(spark, digit, monkeypatch):
    """A hot store and a hot key, over more partitions than groups."""
    rng = random.Random(digit)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice(["k"] * 3 + list("abcdefgh") + [None]), 2 * i, "x") for i in range(700)]
    monkeypatch.setattr(ordered, "DIGIT", digit)
    monkeypatch.setattr(ordered.dominance, "__defaults__", ("n", "p", digit))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        df = spark.createDataFrame(rows, "store string, key string, at long, p string").drop("p").repartition(5)
        found = {r["at"]: r.distance for r in ordered.distinct_between(df, "store", "key", "at").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected, last = {}, {}
    for k, (store, key, at, _) in enumerate(rows):
        since = last.get((store, key))
        expected[at] = None if since is None else len({r[1] for r in rows[since + 1 : k] if r[0] == store})
        last[store, key] = k
    assert found == expected


def test_order_of_nothing(spark):
    df = spark.createDataFrame([], "store string, key string, at long")
    assert ordered.distinct_between(df, "store", "key", "at").count() == 0


@pytest.mark.parametrize("ttl", [1, 7, 1000])
def test_cache_lives(spark, ttl):
    """As a cache read by read: reads don't make a value live longer."""
    rng = random.Random(ttl)
    reads = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.randint(0, 90), None, 5]), "x") for _ in range(200)]
    found = {(r.k, r.t): (r.loaded, r.life) for r in limits.cache_lives(spark.createDataFrame(reads, "k string, t long, __at string"), "k", "t", ttl).collect()}
    expected = {}
    for k in {r[0] for r in reads}:
        since, life = None, 0
        for t in sorted({r[1] for r in reads if r[0] == k and r[1] is not None}):
            fresh = since is None or t >= since + ttl
            since, life = (t, life + 1) if fresh else (since, life)
            expected[k, t] = (fresh, life)
    assert found == expected


@pytest.mark.parametrize("n", [2, 9, 40, 141])
def test_chain_stops_of_a_cut_block(spark, tmp_path, n):
    """The last block ends early: the page that its last one names isn't there, and isn't counted."""
    rows = [(i, f"http://x/{i}", f'<nav><a href="/w{i}">w</a><a href="/v{i % 3}">v</a></nav>') for i in range(n)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = catalog.QUERIES["chain_stops"](spark, str(tmp_path)).select("block", "pages", "n_items", "stopped_by")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalog.SQL["chain_stops"]).fetchall())


def test_article_text_of_cut_references(spark, tmp_path):
    """A reference without its semicolon stays as it stands."""
    rows = [(0, "u", "<article><h1>a&amp</h1><p>b &amp; c&lt;d &notit &am & e&amp;lt;</p></article>"), (1, "u", "<article>&amp&amp;&gt</article>"), (2, "u", "<p>x&amp</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = sorted(map(tuple, catalog.QUERIES["dom_article_text"](spark, str(tmp_path)).collect()))
    assert found == sorted(con.execute(catalog.SQL["dom_article_text"]).fetchall()) == [(0, "a&amp\nb & c<d &notit &am & e&lt;"), (1, "&amp&&gt")]


@pytest.mark.parametrize("read", [nodes, element_chains])
def test_batches_of_nodes_are_small(spark, read):
    """Pages go to Python in small batches, and their nodes come back in several; none is lost."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, "10000")
    pages = spark.range(3000).coalesce(1).select(F.col("id").alias("page_id"), F.concat(F.lit("<ul>"), F.repeat(F.lit("<li>x</li>"), 20), F.lit("</ul>")).alias("html"))
    counts = read(pages).groupBy("page_id").count()
    each = 41 if read is nodes else 21
    assert 500 * each > MOST_ROWS
    assert int(spark.conf.get(setting)) <= 500
    assert counts.agg(F.count("*"), F.min("count"), F.max("count")).first()[:] == (3000, each, each)
