"""Records with errors, pages of many sources, visits and files set aside, against literal vectors and brute-force versions."""

import random
from collections import deque
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark import catalog, catalog_trees  # noqa: F401
from foliospark.operators import paginate, records
from foliospark.operators.chains import Step
from foliospark.operators.records import Field
from foliospark.plans import paging
from foliospark.sources import files
from foliospark.sources.pages import element_chains

FIELDS = [
    Field("title", (Step("b"),), needed=True),
    Field("author", (Step("i", child=True),), pattern=r"^by (.*)$", fails="page"),
    Field("cover", (Step("img"),), "src", pattern=r"^(http.*)$"),
    Field("own", (), None),
    Field("key", (), "id"),
]


def found(spark, pages, read=records.records):
    rows, failed = read(element_chains(spark.createDataFrame(pages, "page_id long, html string")), [Step("div", "hit")], FIELDS)
    return {(r.page_id, r.title, r.author, r.cover, r.own, r.key) for r in rows.collect()}, {tuple(r) for r in failed.collect()}


def test_records(spark):
    pages = [
        (1, '<div class="hit" id="k"> own <p><b> a </b></p><i>by x</i><img src="http://c"></div><div class="hit"><b>b</b></div>'),
        (2, '<div class="hit"><i>nobody</i></div><div class="hit"><b> </b><b>second</b><img src="ftp://c"></div>'),  # no title: its author's error doesn't count
        (3, '<div class="hit"><b>a</b><i>by x</i></div><div class="hit"><b>b</b><i>nobody</i></div>'),  # the whole page fails
        (4, '<div class="hit"><b>out</b><div class="hit"><b>in</b><i>by y</i></div></div>'),  # regions in each other
        (5, "<p>no hit"),
        (6, None),
    ]
    rows, failed = found(spark, pages)
    assert rows == {(1, "a", "x", "http://c", "own", "k"), (1, "b", None, None, None, None), (2, "second", None, None, None, None), (4, "out", None, None, None, None), (4, "in", "y", None, None, None)}
    assert failed == {(3, "author")}


def test_details(spark):
    pages = [(1, '<div class="hit"><b>a</b></div><div class="hit"><b>b</b></div>'), (2, "<p>none"), (3, '<div class="hit"><b>a</b><i>nobody</i></div>'), (4, '<div class="hit">no title</div>')]
    rows, failed = found(spark, pages, records.details)
    assert {r[:2] for r in rows} == {(1, "a")} and failed == {(2, "NO_REGION"), (3, "author"), (4, "NO_REGION")}


def brute_paged(answers, source, most, attempts):
    page, tries, total, items = 1, 1, 0, []
    while True:
        total += 1
        error, own = answers.get((source, page, tries), ("NO_ANSWER", None))
        if own is None or error is not None:
            if tries == attempts:
                return (source, page - 1, total, "failed", error or "NO_ANSWER"), items
            tries += 1
            continue
        new = [x for x in dict.fromkeys(own) if x not in items]
        items += new
        if not new or page == most:
            return (source, page, total, "cap" if new else "end", None), items
        page, tries = page + 1, 1


@pytest.mark.parametrize("most,attempts", [(10, 3), (2, 1), (1, 2)])
def test_paged(spark, most, attempts):
    rng = random.Random(most)
    answers = {}
    for s in range(40):
        for page in range(1, 12):
            for tries in range(1, 4):
                if rng.random() < 0.9:
                    bad = rng.random() < 0.25
                    answers[f"s{s}", page, tries] = ("HTTP", None) if bad else (None, [f"i{rng.randint(0, 3 * page)}" for _ in range(rng.randint(0, 4))])
    table = spark.createDataFrame([(*k, *v) for k, v in answers.items()], "source_id string, page int, attempt int, error string, items array<string>")
    asked_for = []

    def fetch(asked):
        asked_for.extend(tuple(r) for r in asked.collect())
        return asked.join(table, ["source_id", "page", "attempt"])

    sources = spark.createDataFrame([(f"s{s}",) for s in range(40)] * 2, "source_id string")
    items, ends = paging.paged(sources, fetch, most, attempts)
    expected = [brute_paged(answers, f"s{s}", most, attempts) for s in range(40)]
    assert {tuple(r) for r in ends.collect()} == {e for e, _ in expected}
    own = {}
    for r in items.orderBy("source_id", "page", "place").collect():
        own.setdefault(r.source_id, []).append(r["item"])
    assert own == {e[0]: x for e, x in expected if x}
    assert len(asked_for) == len(set(asked_for)) == sum(e[2] for e, _ in expected)  # nothing is asked twice, and nothing after the end


def test_paged_nothing(spark):
    items, ends = paging.paged(spark.createDataFrame([], "source_id string"), lambda asked: asked)
    assert items.count() == ends.count() == 0


def test_visits(spark):
    rng = random.Random(2)
    starts, links, expected = [], [], set()
    for book in range(12):
        docs = [f"d{k}" for k in range(rng.randint(1, 30))]
        own_starts = [(d, rank) for rank, d in enumerate(rng.choices(docs, k=rng.randint(0, 4)))]
        own_links = {d: [rng.choice([*docs, "elsewhere"]) for _ in range(rng.randint(0, 3))] for d in docs}
        starts += [(book, *x) for x in own_starts]
        links += [(book, d, k, to) for d, out in own_links.items() for k, to in enumerate(out)]
        queue, step = deque(), {}
        order = []
        for d, _ in own_starts:
            if d not in step:
                step[d] = 0
                queue.append(d)
        while queue:
            d = queue.popleft()
            order.append(d)
            for to in own_links.get(d, []):
                if to not in step:
                    step[to] = step[d] + 1
                    queue.append(to)
        expected |= {(book, d, step[d], k) for k, d in enumerate(order)}
    found = paginate.visits(spark.createDataFrame(starts, "book long, doc string, rank int"), spark.createDataFrame(links, "book long, doc string, ord int, to string"))
    assert {tuple(r) for r in found.collect()} == expected


def test_files(spark, tmp_path):
    contents = {"a.json": b'[{"n": 1}, {"n": 2}]', "b.json": b"[]", "mark.json": b"\xef\xbb\xbf[3]", "cut.json": b'[{"n": 1}', "kind.json": b'{"n": 1}', "blank.json": b" \n", "none.json": b"", "latin.json": b'["\xe9"]', "skipped.txt": b"x"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    values, aside = files.read_json(spark, str(tmp_path), glob="*.json")
    name = F.regexp_extract("file", r"([^/]*)$", 1).alias("file")
    assert {(r.file, r.v) for r in values.select(name, F.to_json("value").alias("v")).collect()} == {("a.json", '[{"n":1},{"n":2}]'), ("b.json", "[]"), ("mark.json", "[3]")}
    rows = {r.file: (r.reason, bytes(r.content)) for r in aside.select(name, "reason", "content").collect()}
    reasons = {"cut.json": "NOT_JSON", "kind.json": "OTHER_KIND", "blank.json": "EMPTY", "none.json": "EMPTY", "latin.json": "NOT_UTF8"}
    assert rows == {f: (reason, contents[f]) for f, reason in reasons.items()}


def test_bundled_files(spark, tmp_path):
    contents = {"a.json": b'[{"n": 1},\n {"n": 2}]', "b.json": b"[]", "mark.json": b"\xef\xbb\xbf[3]", "cut.json": b'[{"n": 1}', "kind.json": b'{"n": 1}', "blank.json": b" \n", "none.json": b"", "latin.json": b'["\xe9\x00"]'}
    (tmp_path / "loose").mkdir()
    for name, data in contents.items():
        (tmp_path / "loose" / name).write_bytes(data)
    loose = spark.read.format("binaryFile").load(str(tmp_path / "loose"))
    nothing = spark.createDataFrame([("/none.json", None, None)], "path string, content binary, modificationTime timestamp")
    files.bundle(loose.select("path", "content", "modificationTime").union(nothing).repartition(2), str(tmp_path / "bundles"))
    values, aside = files.read_bundled_json(spark, str(tmp_path / "bundles"))
    name = F.regexp_extract("file", r"([^/]*)$", 1).alias("file")
    assert {(r.file, r.v) for r in values.select(name, F.to_json("value").alias("v")).collect()} == {("a.json", '[{"n":1},{"n":2}]'), ("b.json", "[]"), ("mark.json", "[3]")}
    rows = {r.file: (r.reason, bytes(r.content)) for r in aside.select(name, "reason", "content").collect()}
    reasons = {"cut.json": "NOT_JSON", "kind.json": "OTHER_KIND", "blank.json": "EMPTY", "none.json": "EMPTY", "latin.json": "NOT_UTF8"}
    assert rows == {f: (reason, contents[f]) for f, reason in reasons.items()}


def test_many_files_are_few_on_disk(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS c_custkey, 'c' || i AS c_name FROM range(3000) t(i)) TO '{tmp_path}/in/customer.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/in/customer.parquet'")
    monkeypatch.setattr(catalog_trees, "shared_dir", lambda spark: f"file://{tmp_path}/files")
    found = catalog.QUERIES["quarantined_files"](spark, str(tmp_path / "in"))
    rows = found.select("block", "reason", "n", "total").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, con.execute(catalog.SQL["quarantined_files"]).fetchall()))
    assert 0 < sum(p.is_file() and p.name.startswith("part-") for p in Path(tmp_path, "files").rglob("*")) <= 8  # of 150 blocks
