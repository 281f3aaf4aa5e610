"""Spelling variants against a brute-force version, on odd and on given tables."""

import random
import re
import zlib
from collections import Counter

import pytest

from foliospark.llm import spelling
from foliospark.shared import written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n string, l string, a string, b string, key string, form string, root string"


def brute_words(rows, slip, least, least_n):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= least_n}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(9)
    words = ["halloo", "hallooo", "halloooo", "hàlloo", "hallo×o", "hall÷oo", "aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abaaaa"]
    words += ["common" + "".join(rng.choice("abé") for _ in range(4)) for _ in range(60)]  # one half, a third of all words
    words += ["".join(rng.choice("abÿ") for _ in range(4)) + "ending" for _ in range(40)] + ["y" * 3000, "y" * 2999 + "z"]
    texts = [None, "", "12 ,. é", "Übermut ÜBERMUT übermut", "\U0001f600hallooĀhalloo"]
    for k in range(400):
        texts.append(" ".join(rng.choice(words[: 1 + rng.randrange(len(words))]) for _ in range(rng.randint(1, 40))))
    texts += [texts[-1]] * 3 + ["halloo HALLOO, " * 3000]
    return [(None if k % 50 == 0 else k // 2, t) + ("x",) * 8 for k, t in enumerate(texts)]


@pytest.mark.parametrize("group,slip", [(64, 199), (2, 7), (1, 3)])
def test_variants(spark, odd, group, slip):
    df = spark.createDataFrame(odd, SCHEMA).repartition(3)
    words = brute_words([r[:2] for r in odd], slip, 6, 5)
    expected = brute(words)
    assert found(spelling.variants(df, slip=slip, group=group)) == expected
    assert sum(r[1] is not None for r in expected) > 10


def test_given(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    words = brute_words([tuple(r) for r in df.select("doc_id", "text").collect()], 199, 6, 20)
    assert found(spelling.variants(df, least_n=20, group=8)) == brute(words)


def test_chain(spark):
    """Forms are followed to the last; ties go to the first in code-point order."""
    counts = {"wordaa": 1, "wordab": 5, "wordbb": 25, "wordbbc": 125, "wordbbcd": 625, "wordbbce": 625, "zzzzzz": 3}
    words = written(spark.createDataFrame(list(counts.items()), "word string, n long"))
    rows = {r.word: r for r in spelling.forms(words, group=1).collect()}
    assert {w: (r.form, r.root) for w, r in rows.items()} == {"wordaa": ("wordab", "wordbbcd"), "wordab": ("wordbb", "wordbbcd"), "wordbb": ("wordbbc", "wordbbcd"), "wordbbc": ("wordbbcd", "wordbbcd"), "wordbbcd": (None, "wordbbcd"), "wordbbce": (None, "wordbbce"), "zzzzzz": (None, "zzzzzz")}


def test_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None) + ("x",) * 8, (2, "a b c") + ("x",) * 8], SCHEMA)).count() == 0


def test_sums_are_bounded(spark, odd):
    """Words are passed on whenever a task holds many."""
    df = spark.createDataFrame(odd, SCHEMA).repartition(2)
    expected = brute_words([r[:2] for r in odd], 199, 6, 1)
    assert {r.word: r.n for r in spelling.counted(df, keep=5).collect()} == expected
