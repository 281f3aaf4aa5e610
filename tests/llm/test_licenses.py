"""License scans against a brute-force version, on odd and on given tables."""

import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest

from foliospark.llm import licenses

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, h string, p string, t string, d string, n string, template string, run string, candidates string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates=licenses.TEMPLATES, gram=3):
    words = split(text)
    base = []
    for phrase, label in licenses.PHRASES.items():
        sought = phrase.split()
        base += [(k, label) for k in range(len(words)) if words[k : k + len(sought)] == sought]
    spans = []
    for number, (_, notice) in enumerate(templates):
        sought = split(notice)
        votes = Counter()
        for p in range(len(words) - gram + 1):
            for t in range(len(sought) - gram + 1):
                votes[p - t] += words[p : p + gram] == sought[t : t + gram]
        stretches, run_start, before = defaultdict(list), None, None
        for d in sorted(d for d, n in votes.items() if n):
            if before is None or d - before > 3:
                run_start = d
            before = d
            stretches[run_start, (d - run_start) // len(sought)].append(d)
        for ds in stretches.values():
            if sum(votes[d] for d in ds) >= max(1, 0.3 * (len(sought) - gram + 1)):
                first = max(0, ds[0] - 3)
                there = words[first : ds[-1] + len(sought) + 3]
                blocks = [b for b in SequenceMatcher(None, sought, there, autojunk=False).get_matching_blocks() if b.size]
                share = sum(b.size for b in blocks) / len(sought)
                if share >= 0.8:
                    spans.append((-share, -len(sought), number, first + blocks[0].b, first + blocks[-1].b + blocks[-1].size))
    kept = []
    for s in sorted(set(spans)):
        if all(s[4] <= o[3] or o[4] <= s[3] for o in kept):
            kept.append(s)
    own = {label for _, label in base}
    labels = own | {templates[s[2]].label for s in kept}
    starts = [k for k, _ in base]
    score = 1.0 if base else max((-s[0] for s in kept), default=0.0)
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), round(score, 9), len(kept))


def found(df, **options):
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), len(r.spans)) for r in licenses.scan(df, **options).collect())


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "é", "the", "license", "under", "version", "3"]) for _ in range(n))
    notices = [t.text for t in licenses.TEMPLATES]

    def hurt(text):
        words = text.split()
        for _ in range(rng.randint(0, 1 + len(words) // 8)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["word"], [words[k], "more"]])
        return " ".join(words)

    texts = [None, "", " .,", "cc BY-nc", "cc by nc by nc cc by nc", "UNDER the\nMIT-License!!", "Apache License, Version 2.0", "apache license version 20", "under the mit licenseé", "İ under the mit license"]
    texts += [f"{say(9)}. {n}. {say(5)}" for n in notices] + [f"{say(4)} {hurt(rng.choice(notices))} {say(4)}" for _ in range(60)]
    texts += [" ".join(notices), "licensed under the " * 500, f"{say(4000)} {notices[1]} {say(10)} {notices[1]}", "released under the MIT License " * 40]
    rows = [(None if k % 9 == 0 else k // 2, t) + ("x",) * 8 for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-2:], SCHEMA).repartition(3)


def test_odd(odd):
    assert found(odd) == Counter((r.doc_id, *brute(r.text)) for r in odd.collect())


def test_given(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert found(docs) == expected
    named = {label for *_, labels, _, _ in expected for label in labels.split(",")}
    assert {"", "mit", "apache-2", "cc-by-nc"} == named
    asked = licenses.query(spark, SF).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), r.n_spans) for r in asked) == expected


def test_beyond_broadcasts(odd, monkeypatch):
    """Many templates and candidates are joined by a shuffle."""
    expected = found(odd)
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert found(odd) == expected


def test_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_versions_are_told_apart(spark):
    text = "This work is licensed under the GNU General Public License, version 2."
    (row,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.labels, row.base_labels, row.score, [(s.start, s.end) for s in row.spans]) == ("gpl-2", "", 1.0, [(3, 12)])
