"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern; each piece is encoded for itself. Over the places of a piece's
bytes lies a segment tree: a leaf holds the rank of the pair of the part that starts there and the next
one, with its place, and each inner node the least of its two, so that the root is the leftmost pair of
the least rank. A merge makes the next part's leaf empty and updates the leaves of the merged part and of
its left neighbour, each along its way to the root. Short pieces go through one tree level at a time for
many pieces at once (numpy); long ones have a tree of their own. Workers keep the ids of pieces they have
seen, in a store of bounded size.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, map_batches, small_batches, spread

#: Pieces that a worker keeps, their bytes, and the longest piece that goes through the common tree.
KEEP, KEEP_BYTES, SHORT = 300_000, 32 << 20, 64
_NONE = np.int64(2**62)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = KEEP):
        self.ranks, self.keep, self.spent = ranks, keep, 0
        self.pieces_of = regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.pair_keys = np.array([p for p, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [0], np.int64)
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; a negative id on either side, or no such pair: -1."""
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], -1)

    def _merge_many(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Pieces of 2 to `leaves` bytes (a power of two), each with its row of every array."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        place = np.arange(leaves)
        inside = place < size[:, None]
        ids = np.full((n, leaves + 2), -1, np.int64)  # one column on each side of the places: the end, and the place before the first
        ids[:, :leaves] = np.where(inside, self.byte[raw], -1)
        after = np.broadcast_to(np.minimum(place + 1, leaves), (n, leaves + 2 - 2)).copy()
        after = np.concatenate([after, np.full((n, 2), leaves)], axis=1)
        before = np.concatenate([np.broadcast_to(place - 1, (n, leaves)), np.full((n, 2), leaves + 1)], axis=1)
        before[:, 0] = leaves + 1
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        rank = self._rank(ids[:, :leaves], ids[:, 1 : leaves + 1])
        tree[:, leaves:] = np.where(rank >= 0, rank * leaves + place, _NONE)
        node = leaves
        while node > 1:
            tree[:, node // 2 : node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            top = tree[live, 1]
            at = top % leaves
            gone = after[live, at]
            ids[live, at] = top // leaves
            ids[live, gone] = -1
            nxt, prev = after[live, gone], before[live, at]
            after[live, at] = nxt
            before[live, nxt] = at
            for leaf, left, right in ((at, ids[live, at], ids[live, nxt]), (gone, None, None), (prev, ids[live, prev], ids[live, at])):
                rank = np.full(len(live), -1) if left is None else self._rank(left, right)
                ok = leaf < leaves
                rows, leaf, rank = live[ok], leaf[ok], rank[ok]
                tree[rows, leaves + leaf] = np.where(rank >= 0, rank * leaves + leaf, _NONE)
                node = (leaves + leaf) // 2
                while len(node) and node[0] >= 1:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node // 2
            live = live[tree[live, 1] < _NONE]
        ids = ids[:, :leaves].astype("<i4")
        return [row[row >= 0].tobytes() for row in ids]

    def _merge_one(self, piece: bytes) -> bytes:
        """A long piece: the same tree in a list."""
        n, ranks = len(piece), self.ranks
        leaves = 1 << (n - 1).bit_length()
        none = len(ranks) * leaves + leaves
        starts_at = list(range(n + 1))  # a part's start to the next part's
        nxt, prev = [*range(1, n + 1), n], [*range(-1, n)]
        tree = [none] * (2 * leaves)

        def key(i: int) -> int:
            j = nxt[i]
            r = ranks.get(piece[i : nxt[j]]) if j < n else None
            return none if r is None else r * leaves + i

        for i in range(n):
            tree[leaves + i] = key(i)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = leaves + i
            tree[node] = value
            node //= 2
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node //= 2

        alive = [True] * n
        while tree[1] < none:
            i = tree[1] % leaves
            j = nxt[i]
            alive[j] = False
            nxt[i] = nxt[j]
            prev[nxt[j]] = i
            put(j, none)
            put(i, key(i))
            if prev[i] >= 0:
                put(prev[i], key(prev[i]))
        return np.array([ranks[piece[i : nxt[i]]] for i in starts_at[:n] if alive[i]], "<i4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces not yet known into the store."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            if b in self.ranks:
                self.known[p] = self.ranks[b].to_bytes(4, "little")
            elif len(b) > SHORT:
                self.known[p] = self._merge_one(b)
            else:
                classes.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((p, b))
        for leaves, group in classes.items():
            for k in range(0, len(group), 2048):
                part = group[k : k + 2048]
                for (p, _), ids in zip(part, self._merge_many([b for _, b in part], leaves), strict=True):
                    self.known[p] = ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (little-endian 32-bit) of each text."""
        out = []
        for k in range(0, len(texts), 32):
            split = [self.pieces_of(t) for t in texts[k : k + 32]]
            if len(self.known) > self.keep or self.spent > KEEP_BYTES:
                self.known.clear()
                self.spent = 0
            new: set[str] = set()
            for pieces in split:
                new.update(pieces)
            new = new.difference(self.known)  # looks up the new ones; difference_update would go over the store
            self.spent += sum(map(len, new))
            self.learn(new)
            known = self.known
            out += [np.frombuffer(b"".join([known[p] for p in pieces]), "<i4") for pieces in split]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()])


_CODEC: list = []


def _codec(shared: Shared, pattern: str) -> Codec:
    """The worker's codec, kept for its next tasks."""
    if not _CODEC or _CODEC[0] != (shared.key, pattern):
        _CODEC[:] = [(shared.key, pattern), Codec(read_ranks(shared.value), pattern)]
    return _CODEC[1]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids array<int> (and decoded binary, the bytes that the ids stand for). Null and empty texts: no ids.

    ranks is the path of a rank file on the driver; its bytes (under 1 MB for 50,000 tokens) are broadcast.
    Every document is encoded for itself, whatever its length: repeated rows give equal results. Columns named ids or
    decoded are replaced, others stay. Empty docs: empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks or default_ranks(), "rb") as f:
        shared = Shared(spark, f.read())
    pattern = pattern or default_pattern()
    new = ["ids", *["decoded"] * decoded]
    names = [c for c in docs.columns if c not in new]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, pattern)
        ids = codec.encode([t or "" for t in batch.column(names.index(text)).to_pylist()])
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))]
        if decoded:
            columns.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, [*names, *new])

    docs = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, make, schema + ", ids array<int>" + ", decoded binary" * decoded)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_byte_bpe over all documents."""
    out = encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), decoded=True)
    listed = F.btrim(F.replace(F.col("ids").cast("string"), F.lit(", "), F.lit(",")), F.lit("[]"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
