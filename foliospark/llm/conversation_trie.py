"""The prefix trie of conversations, from one global sort.

A turn is named by an MD5 of its role and text, a conversation by the row of its turns' names (its path, 16 bytes a
turn). Paths are sorted over all partitions, copies by conv_id, so that a hot group of copies is cut like any other
rows. In this order the conversations that start with the same turns stand together: a node of the trie is an interval in
which neighbours share at least its depth (their longest common prefix, LCP). Each partition sweeps its rows with a
stack of open nodes: a row closes the nodes deeper than its LCP with the row before and opens those of its own.

What a partition can't close are the nodes on its first row's path (they may have begun before) and on its last
row's (they may go on). Those open stacks are passed on, and the stacks of FAN neighbouring partitions are swept by one
task in the same way, level by level, until one is left. So no task ever sees more than its rows and FAN stacks.

A node's parent has its conv_id only when it is closed. Closed nodes wait for that in a bounded buffer; what outgrows it
or waits for a node that stays open gets its parent's conv_id by a join afterwards. The hash over a node's ends is made on
the way; ends of open nodes, and lists beyond CHUNK, are written in pieces in order and hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, small_batches, spread_join, written

KEY, BLOCK, MOST_TAKEN = 16, 100, 6
#: Open stacks of so many neighbouring partitions are swept in one task.
FAN = 64
#: Ends of a node that are hashed at once, and closed nodes that wait for their parents in one task.
CHUNK, WAITING = 65_536, 20_000
#: Rows of an Arrow batch of the sweep's output, and characters of pieces in it.
_BATCH, _HEAVY = 10_000, 8 << 20
_ROOT, _NO_ENDS = b"", hashlib.sha256(b"").hexdigest()

_SWEPT = pa.schema(
    [
        ("kind", pa.int8()),  # 0: a closed node, 1: one of an open stack, 2: a piece of a node's ends
        ("part", pa.int32()),
        ("at", pa.int64()),  # place in the stack, or first conv_id of a piece
        ("left", pa.bool_()),
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("depth", pa.int64()),
        ("chars", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("waits", pa.bool_()),  # the parent's conv_id is still to come
        ("asked", pa.bool_()),  # some child waits
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("in_pieces", pa.bool_()),
        ("ends", pa.string()),  # their hash, or the piece
    ]
)
_DDL = "kind byte, part int, at long, left boolean, node binary, parent binary, depth long, chars long, conv_id long, parent_conv_id long, waits boolean, asked boolean, n_convs long, n_children long, n_leaves long, saved_tokens long, in_pieces boolean, ends string"


class _Node:
    """An open node. n_leaves and saved are those of closed children."""

    __slots__ = ("node", "parent", "depth", "chars", "least", "n", "children", "leaves", "saved", "left", "asked", "in_pieces", "ends", "waiting")

    def __init__(self, node: bytes, parent: bytes, depth: int, chars: int, left: bool):
        self.node, self.parent, self.depth, self.chars, self.left = node, parent, depth, chars, left
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.asked = self.in_pieces = False
        self.ends: str | None = None
        self.waiting: list[dict] = []


class Sweep:
    """A stack of open nodes over rows in path order; out has the rows to be written."""

    def __init__(self, part: int, waiting: int = WAITING):
        self.part, self.most, self.held, self.heavy = part, waiting, 0, 0
        self.stack: list[_Node] = []  # by depth
        self.out: list[dict] = []
        self.opened: list[dict] = []  # closed here, but begun before

    def _row(self, x: _Node, **more) -> dict:
        return {"kind": 0, "part": self.part, "at": None, "left": x.left, "node": x.node, "parent": x.parent, "depth": x.depth, "chars": x.chars, "conv_id": x.least, "parent_conv_id": None, "waits": x.depth > 0, "asked": x.asked, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "in_pieces": x.in_pieces, "ends": x.ends} | more

    def _flush(self, x: _Node) -> None:
        """Children that wait go out without their parent's conv_id."""
        x.asked |= bool(x.waiting)
        self.out += x.waiting
        self.held -= len(x.waiting)
        x.waiting = []

    def pop(self, last: bool = False) -> None:
        """Closes the deepest node; one that may have begun in an earlier partition goes out as open. last: nothing can be open."""
        x = self.stack.pop()
        if x.left and not last:
            self._flush(x)
            self.opened.append(self._row(x, kind=1))
            return
        leaves = x.leaves if x.children else 1
        saved = x.saved + (x.n - 1) * x.chars
        for child in x.waiting:
            child["parent_conv_id"], child["waits"] = x.least, False
        self.out += x.waiting
        self.held -= len(x.waiting)
        row = self._row(x, n_leaves=leaves, saved_tokens=saved, ends=None if x.in_pieces else x.ends or _NO_ENDS)
        if not self.stack:
            self.out.append(row)
            return
        up = self.stack[-1]
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        up.waiting.append(row)
        self.held += 1
        if self.held > self.most:
            for y in self.stack:
                self._flush(y)

    def full(self) -> bool:
        return len(self.out) >= _BATCH or self.heavy >= _HEAVY

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What is to be written so far."""
        for k in range(0, len(self.out), _BATCH):
            yield pa.RecordBatch.from_pylist(self.out[k : k + _BATCH], _SWEPT)
        self.out, self.heavy = [], 0

    def finish(self, last: bool = False) -> None:
        """The end of the rows: the left path's closed nodes and the whole stack stay open, in path order."""
        if last:
            while self.stack:
                self.pop(last=True)
            return
        for x in self.stack:
            self._flush(x)
        common = [x for x in self.stack if x.left]
        rest = [x for x in self.stack if not x.left]
        left = self.opened[::-1]
        rows = [self._row(x, kind=1) for x in common] + left + [self._row(x, kind=1) for x in rest]
        for k, row in enumerate(rows):
            row["at"] = k
        self.out += rows


def _sweep_paths(chunk: int, waiting: int):
    """Sorted rows (path, chars, conv_id) of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sweep(TaskContext.get().partitionId(), waiting)
        before: bytes | None = None
        ends: list[int] = []

        def piece(x: _Node) -> None:
            text = ",".join(map(str, ends))
            own.out.append(own._row(x, kind=2, at=ends[0], ends=text))
            own.heavy += len(text)
            x.in_pieces = True
            ends.clear()

        def settle(x: _Node, at_end: bool) -> None:
            """All rows that end at x in this partition are read."""
            if ends and (x.left or x.in_pieces or at_end):
                piece(x)
            elif ends:
                x.ends = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
                ends.clear()

        for batch in batches:
            for path, chars, conv in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if path != before:
                    first = before is None
                    if first:
                        own.stack.append(_Node(_ROOT, _ROOT, 0, 0, True))
                        shared = 0
                    else:
                        settle(own.stack[-1], False)
                        shared, most = 0, min(len(before), len(path)) // KEY
                        while shared < most and path[shared * KEY : (shared + 1) * KEY] == before[shared * KEY : (shared + 1) * KEY]:
                            shared += 1
                        while len(own.stack) > shared + 1:
                            own.pop()
                    lengths = chars.values.to_pylist()
                    for d in range(shared, len(path) // KEY):
                        up = own.stack[-1]
                        name = hashlib.blake2b(up.node + path[d * KEY : (d + 1) * KEY], digest_size=KEY).digest()
                        own.stack.append(_Node(name, up.node, d + 1, lengths[d], first))
                    before = path
                for x in own.stack:
                    x.n += 1
                    if x.least is None or conv < x.least:
                        x.least = conv
                ends.append(conv)
                if len(ends) >= chunk:
                    piece(own.stack[-1])
                if own.full():
                    yield from own.taken()
        if before is not None:
            settle(own.stack[-1], True)
            own.finish()
        yield from own.taken()

    return run


def _sweep_stacks(waiting: int, last: bool):
    """Open stacks, sorted by partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sweep(TaskContext.get().partitionId(), waiting)
        first = None
        for batch in batches:
            for r in batch.to_pylist():
                first = r["part"] if first is None else first
                d = r["depth"]
                if d >= len(own.stack) or own.stack[d].node != r["node"]:
                    while len(own.stack) > d:
                        own.pop(last)
                    own.stack.append(_Node(r["node"], r["parent"], d, r["chars"], r["left"] and r["part"] == first))
                x = own.stack[d]
                x.least = r["conv_id"] if x.least is None else min(x.least, r["conv_id"])
                x.n += r["n_convs"]
                x.children += r["n_children"]
                x.leaves += r["n_leaves"]
                x.saved += r["saved_tokens"]
                x.asked |= r["asked"]
                x.in_pieces |= r["in_pieces"]
                x.ends = x.ends or r["ends"]
                if own.full():
                    yield from own.taken()
        if own.stack:
            own.finish(last)
        yield from own.taken()

    return run


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first conv_id: one running hash for each node."""
    held, state, done = None, None, []
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != held:
                if held is not None:
                    done.append((held, state.hexdigest()))
                held, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if held is not None:
        done.append((held, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done])], ["node", "piece_sha"])


def turn_arrays(turns: DataFrame) -> DataFrame:
    """conv_id, path, chars: the turns' names, end to end, and their texts' lengths, by turn (null first; equal turns by name).

    Texts are named before the exchange, which moves 40 bytes a turn. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    named = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), name.alias("name"), F.length(text).alias("chars")).alias("t"),
    )
    sorted_ = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return sorted_.select("conv_id", F.array_join(F.transform("t", lambda x: F.hex(x["name"])), "").alias("path"), F.col("t.chars").alias("chars")).withColumn("path", F.unhex("path"))


def rebuilt(arrays: DataFrame, block: int = BLOCK, most: int = MOST_TAKEN) -> DataFrame:
    """Each conversation c (of a written table of arrays) with its first h turns from conversation c - c % block; h = crc32(c) % most.

    A base has fewer than 2 * block conversations, so no key of the join is hot.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % block
    bases = arrays.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(path, 1, {KEY * (most - 1)})").alias("base_path"), F.slice("chars", 1, most - 1).alias("base_chars"))
    met = arrays.withColumn("base", base).withColumn("h", h).join(bases, "base", "left")
    none = F.array().cast("array<int>")
    path = F.concat(F.expr(f"substring(coalesce(base_path, X''), 1, {KEY} * h)"), F.expr(f"substring(path, {KEY} * h + 1)"))
    rest = F.when(F.size("chars") > F.col("h"), F.expr("slice(chars, h + 1, greatest(size(chars) - h, 0))")).otherwise(none)
    return met.select("conv_id", path.alias("path"), F.concat(F.expr("slice(coalesce(base_chars, cast(array() AS array<int>)), 1, h)"), rest).alias("chars"))


def trie(arrays: DataFrame, fan: int = FAN, chunk: int = CHUNK, waiting: int = WAITING) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, path, chars: a written table), one row each.

    node (its name), conv_id (smallest member), depth, parent_conv_id (of the root: null), n_convs (members), n_children,
    n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its subtree, each node's members but one,
    times the code points of its last text), ends_sha256 (of the conv_ids that end here, ascending, comma-joined).
    Conversations without turns end at the root. Copies are members like others. No conversation: no node.
    """
    spark = arrays.sparkSession
    small_batches(spark, 2_000)
    rows = arrays.select("path", "chars", "conv_id").repartitionByRange(partitions(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    swept = written(rows.mapInArrow(_sweep_paths(chunk, waiting), _DDL))
    levels = [swept.filter("kind = 0")]
    opened = swept.filter("kind = 1")
    n = (opened.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups = -(-n // fan)
        sent = opened.repartitionById(groups, F.floor(F.col("part") / fan).cast("int")).sortWithinPartitions("part", "at")
        level = written(sent.mapInArrow(_sweep_stacks(waiting, groups == 1), _DDL))
        levels.append(level.filter("kind = 0"))
        if groups == 1:
            break
        opened, n = level.filter("kind = 1"), groups
    pieces = swept.filter("kind = 2").select("node", F.col("ends").alias("text"), F.col("at").alias("first"))
    hashes = written(pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "text").mapInArrow(_hash_pieces, "node binary, piece_sha string"))
    closed = levels[0]
    for level in levels[1:]:
        closed = closed.union(level)
    # the few nodes whose ends came in pieces, then the nodes whose parents closed late
    whole = closed.filter("NOT in_pieces").unionByName(spread_join(closed.filter("in_pieces"), hashes, ["node"]).withColumn("ends", F.col("piece_sha")).drop("piece_sha"))
    parents = written(closed.filter("asked").select(F.col("node").alias("parent"), F.col("conv_id").alias("late")))
    late = spread_join(whole.filter("waits"), parents, ["parent"]).withColumn("parent_conv_id", F.col("late")).drop("late")
    names = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return whole.filter("NOT waits").select(*names).union(late.select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_conversation_trie: the trie of all rebuilt conversations."""
    arrays = written(turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(written(rebuilt(arrays))).drop("node")


#: Each prefix of each rebuilt conversation by its turns' MD5s; crc32 bit by bit; subtrees by every node's ancestors.
SQL = """
WITH t AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, list(name ORDER BY turn NULLS FIRST, name) AS names, list(chars ORDER BY turn NULLS FIRST, name) AS chars FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, names, chars, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM a),
r AS (
  SELECT h.conv_id, coalesce(list_slice(b.names, 1, h.h), []) || coalesce(list_slice(h.names, h.h + 1, len(h.names)), []) AS names,
    coalesce(list_slice(b.chars, 1, h.h), []) || coalesce(list_slice(h.chars, h.h + 1, len(h.chars)), []) AS chars
  FROM h LEFT JOIN a b ON b.conv_id = h.base),
p AS (
  SELECT conv_id, d, array_to_string(list_slice(names, 1, d), ',') AS path, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, len(names) = d AS ends, names
  FROM r, unnest(range(len(names) + 1)) AS u(d)),
n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, any_value(list_slice(names, 1, d)) AS names,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY path, d),
k AS (SELECT array_to_string(list_slice(names, 1, d - 1), ',') AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path, d)),
up AS (
  SELECT array_to_string(list_slice(names, 1, e), ',') AS path, e AS d, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM own, unnest(range(d + 1)) AS u(e) GROUP BY ALL)
SELECT own.conv_id, own.d AS depth, m.conv_id AS parent_conv_id, own.n_convs, own.n_children, up.leaves AS n_leaves, up.saved::BIGINT AS saved_tokens, own.ends_sha256
FROM own JOIN up USING (path, d) LEFT JOIN n m ON m.d = own.d - 1 AND m.path = array_to_string(list_slice(own.names, 1, own.d - 1), ',')
"""
