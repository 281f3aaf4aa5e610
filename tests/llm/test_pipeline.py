"""The pipeline against a brute-force version, stage by stage, and on odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from foliospark.llm import mixing, near_texts
from foliospark.llm.common import written

from .test_operators import SCHEMA, WORDS, brute_judged, brute_mixture, multi, odd_rows  # noqa: F401

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def brute_quality(rows):
    return [r for r, judged in zip(rows, brute_judged(rows), strict=True) if judged[-1]]


def brute_lines(rows):
    pages, counts = Counter(r["source"] or "" for r in rows), Counter()
    bare = lambda x: x.strip(" \t\r")
    for r in rows:
        counts.update({(r["source"] or "", bare(x)) for x in (r["text"] or "").split("\n")})
    out = []
    for r in rows:
        h = r["source"] or ""
        kept = "\n".join(x for x in (r["text"] or "").split("\n") if not (bare(x) and counts[h, bare(x)] >= 5 and counts[h, bare(x)] / pages[h] > 0.05))
        out.append(r | {"text": kept, "n_chars": len(kept)})
    return out


def brute_shingles(text, shingle=5):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def brute_groups(rows):
    """A forest over rows whose sets of shingles have a similarity of 0.8 or more; all pairs."""
    sets, forest = [brute_shingles(r["text"]) for r in rows], near_texts.Forest(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if not either or both >= 0.8 * either:
                forest.join(a, b)
    return forest


def brute_near(rows):
    forest, least = brute_groups(rows), {}
    for k, r in enumerate(rows):
        least[forest.root(k)] = min(least.get(forest.root(k), r["doc_id"]), r["doc_id"])
    return [r for k, r in enumerate(rows) if r["doc_id"] == least[forest.root(k)]]


def key(rows):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows)


@pytest.mark.parametrize("kind", ["given", "odd"])
def test_stages(spark, multi, kind):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet") if kind == "given" else spark.createDataFrame([r for r in odd_rows(copies=False) if r[1]], SCHEMA).select(*cp.COLUMNS)
    rows, stages = rows_of(docs), dict(cp.STAGES)
    for name, brute in (("quality_rules", brute_quality), ("line_dedup", brute_lines), ("simhash", brute_near)):
        rows = brute(rows)
        docs = written(stages[name](spark, docs, SF))
        assert docs.columns == list(cp.COLUMNS) and key(rows_of(docs)) == key(rows), name
    assert rows
    docs = written(stages["mixing"](spark, docs, SF))
    counted = [(r["doc_id"], r["source"], len(WORDS.findall(r["text"]))) for r in rows]
    sources = Counter()
    for _, source, n in counted:
        sources[source] += n
    table = spark.createDataFrame([(x, 1, n) for x, n in sources.items()], "source string, docs long, tokens long")
    alpha = mixing.exponent(table, gain=cp.GAIN, max_repeats=cp.MAX_REPEATS)
    assert kind != "given" or 0 < alpha < 1
    expected = brute_mixture(counted, alpha, None, mixing.BLOCK_ROWS)
    assert docs.columns == list(cp.COLUMNS) and Counter((r["doc_id"], r["source"]) for r in rows_of(docs)) == Counter(x[:2] for x in expected.elements())
    assert {r["doc_id"] for r in rows_of(docs)} == {r["doc_id"] for r in rows}
    encoded = sorted(stages["byte_bpe"](spark, docs, SF).collect(), key=lambda r: (r.mix_file, r.mix_row))
    assert [(r.doc_id, r.source) for r in encoded] == [x[:2] for x in sorted(expected.elements(), key=lambda x: x[4])]
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert all(r["ids"] == multi.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r["ids"]) for r in encoded)


def test_run(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "source", "n_tokens", "ids", "mix_file", "mix_row"]
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "simhash", "mixing", "byte_bpe"] and cp.ORACLE_SQL is None


def test_empty_and_odd(spark):
    for rows in ([], odd_rows()):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in cp.STAGES:
            docs = written(stage(spark, docs, SF))
        assert docs.count() >= bool(rows)


def test_copies_keep_their_lines(spark):
    copied = "\n".join(f"line {k} of a text with many copies" for k in range(4))
    pages = [f"menu of the site\nown words of page {k}" for k in range(15)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([copied] * 30 + pages + pages[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in rows_of(dict(cp.STAGES)["line_dedup"](spark, docs, SF))}
    assert out == {r[0]: copied if r[0] < 30 else r[1].split("\n")[1] for r in rows}


def test_null_and_repeated_rows(spark):
    say = lambda k, n=60: " ".join(f"w{k}x{j}" for j in range(n))
    texts = [(None, say(0)), (None, say(0)), (1, say(0)), (None, say(1)), (None, say(1)), (None, "short"), (None, say(2))]
    texts += [(2, say(3)), (2, say(3)), (2, say(3)), (3, say(3)), (4, say(4)), (4, say(5)), (5, say(6)), (5, "short"), (None, "short"), (6, say(5))]
    rows = [dict(zip(cp.COLUMNS, (i, t, "en", "s" if k % 3 else None, len(t)), strict=True)) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(cp.STAGES)
    rows, docs = brute_quality(rows), written(stages["quality_rules"](spark, docs, SF))
    assert key(rows_of(docs)) == key(rows) and len(rows) == 14
    out = rows_of(stages["simhash"](spark, docs, SF))
    forest = brute_groups(rows)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[forest.root(k)].append(r)
    least = Counter((g[0]["text"], min((r["doc_id"] for r in g if r["doc_id"] is not None), default=None)) for g in groups.values())
    assert Counter((r["text"], r["doc_id"]) for r in out) == least and len(out) == 7


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("kind", ["small", "large", "large and hot"])
def test_near_groups(spark, monkeypatch, kind):
    """Dense groups, chains, a text in very many copies, unlike texts that meet in a band: in one task, and by blocks."""
    from foliospark.llm import common

    if kind != "small":
        monkeypatch.setattr(near_texts, "GROUP", 4)
    if kind == "large and hot":
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
        monkeypatch.setattr(common, "BROADCAST_BYTES", 500)
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [" ".join(say(120)) for _ in range(30)]
    base = say(300)
    texts += [" ".join(edited(base, rng, rng.randint(1, 9))) for _ in range(40)]  # some are within 0.8 of each other, some aren't
    chain = say(200)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(chain, rng, 3)
    texts += [" ".join(base).upper().title()] * 40 + ["a b"] * 3 + [None, "", "  "] + ["A b", "b a"]
    order = rng.sample(range(len(texts)), len(texts))
    rows = [{"doc_id": i, "text": texts[k], "lang": "en", "source": "s", "n_chars": 1} for i, k in enumerate(order)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r["doc_id"] for r in rows_of(dict(cp.STAGES)["simhash"](spark, docs, SF))) == sorted(r["doc_id"] for r in brute_near(rows))


@pytest.mark.parametrize("bound", [0.5, 0.8])
def test_links_of_any_sets(bound):
    """Spanning links connect exactly what all pairs connect."""
    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(60):
        base = rng.integers(0, 60, 30)
        sets = [np.unique(np.where(rng.random(30) < rng.choice([0.02, 0.1, 0.5]), rng.integers(0, 99, 30), base)).astype(np.uint64) for _ in range(25)]
        jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        for cut in (None, 10):
            own, others = sets[:cut], None if cut is None else sets[cut:]
            whole, forest = near_texts.Forest(25), near_texts.Forest(25)
            for a in range(len(own)):
                for b in range(a + 1 if cut is None else cut, 25):
                    if jaccard(sets[a], sets[b]) >= bound:
                        whole.join(a, b)
            for a, b in near_texts.links_of(own, others, bound):
                assert jaccard(sets[a], sets[b]) >= bound
                forest.join(a, b)
            assert [forest.root(k) for k in range(25)] == [whole.root(k) for k in range(25)]
