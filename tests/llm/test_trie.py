"""The trie of conversations against a brute-force version, on odd and on given tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from foliospark.llm import conversation_trie as ct
from foliospark.shared import written

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, path string, chars string, t string, base string, node string"


def name(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    """Rows (conv_id, turn, role, text) -> the rows of the contract."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, name(role, text), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in made.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))

    def below(node):
        return [node] + [y for x in children[node] for y in below(x)]

    out = set()
    for node, convs in members.items():
        under = below(node)
        out.add(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                len(children[node]),
                sum(not children[x] for x in under),
                sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in under),
                hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
            )
        )
    return out


def found(df, **options):
    nodes = ct.trie(written(ct.rebuilt(written(ct.turn_arrays(df)))), **options)
    rows = nodes.drop("node").collect()
    assert len(rows) == len(set(rows)) == nodes.select("node").distinct().count()
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = [(None, 1, "user", "of no conversation"), (7, None, None, None), (7, None, "user", "two without a number"), (7, 0, "user", "é😀" * 3000), (7, 0, "a", "tie"), (7, 0, "a", "tie")]
    for c in range(100, 260):  # a hot group of copies, a hot first turn, and others
        rows.append((c, 0, "system", "one first turn"))
        if c % 3:
            rows += [(c, k, "user", f"the same {k}") for k in range(1, 4)]
        else:
            rows += [(c, k, rng.choice(["user", None]), rng.choice(["x", "", None, "yy"])) for k in range(1, rng.randint(2, 9))]
    rows += [(400, k, "user", f"long {k}") for k in range(120)] + [(401, k, "user", f"long {k}") for k in range(121)]  # 400 is the base of 401
    rows += [(305, k, "user", "no base, few turns") for k in range(2)]
    return [r + ("p", "c", "t", "b", "n") for r in rows]


@pytest.mark.parametrize("options", [{}, {"fan": 2, "chunk": 3, "waiting": 4}, {"fan": 3, "chunk": 1, "waiting": 0}])
def test_trie(spark, odd, options):
    df = spark.createDataFrame(odd, SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9" if options else before)
        assert found(df, **options) == brute([r[:4] for r in odd])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_given(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(df, fan=2) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_one_text_of_many(spark):
    """Copies over all partitions: one chain of nodes, its ends in pieces."""
    rows = [(100 * c, k, "user", f"turn {k}") for c in range(300) for k in range(3)]
    df = spark.createDataFrame([r + ("",) * 5 for r in rows], SCHEMA)
    assert found(df, fan=2, chunk=7) == brute(rows)


def test_nothing(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set()
    assert found(spark.createDataFrame([(None, 1, "a", "b") + ("",) * 5], SCHEMA)) == set()
