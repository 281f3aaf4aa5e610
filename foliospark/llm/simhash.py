"""SimHash near-dedup with vantage-point trees.

Fingerprints are 64 bits wide. Equal ones are first made one row with the smallest doc_id. The distinct ones
are put into shards by a vantage-point tree on top, made of a bounded sample: at each node a fingerprint
goes to the inner or outer side by its Hamming distance to the vantage point. Its home is one shard; it is
also sent, as a query, to each other shard that its ball of MAX_BITS reaches by the triangle inequality.
Each shard goes on with a tree of its own, down to small leaves that are compared exactly, with all its
queries side by side. Of the links found a shard gives a spanning forest only, so that a dense group of n
fingerprints gives n rows. The components of these links are found by alternating star operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, small_batches, spread, spread_join, text_bytes, written

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: The top tree: distinct fingerprints a shard (in the mean), sampled fingerprints for each, and its levels, which
#: bound what the driver holds (2**20 shards of 65,536 are 69 billion fingerprints; beyond that shards grow).
SHARD_ROWS, SAMPLE, MAX_DEPTH = 65_536, 16, 20
#: A vantage point is the one of so many sampled ones whose distances to so many others vary most.
CANDIDATES, SPREAD = 8, 512
#: Up to this many edges a node's edges may stand in one task.
PLAIN_EDGES = 1_000_000
_LEAF = 48
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit number; 0 for one without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[shingle - 1 :] - 1 if len(words) >= shingle else ends[-1:] - 1).tolist()
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], ">u8")
    total = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        total += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep_text: bool = False) -> DataFrame:
    """docs with fp (long), without the text, unless it is to be kept. Null and empty texts: 0. A column fp is replaced."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in (text, "fp")]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [simhash(t, shingle) for t in text_bytes(batch.column(len(names)))]
        columns = batch.columns if keep_text else batch.columns[:-1]
        return pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.int64())], [*names, *[text] * keep_text, "fp"])

    kept = docs.select(*[f"`{c}`" for c in (*names, text)])
    fields = kept.schema.fields if keep_text else kept.schema.fields[:-1]
    return map_batches(kept, make, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp long"]))


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _vantage(points: np.ndarray) -> np.uint64:
    """Of some of the points the one whose distances to others vary most, so that few of them are near the median."""
    asked = points[:: -(-len(points) // CANDIDATES)]
    spread = [_distance(points[:: -(-len(points) // SPREAD)], p).var() for p in asked]
    return asked[int(np.argmax(spread))]


def top_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """A heap of (vantage point, radius): distances up to the radius go to child 2 i, others to 2 i + 1; node 1 is the root."""
    tree = [(0, 0)] * (1 << depth)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        part = parts.pop(node)
        vantage = _vantage(part) if len(part) else np.uint64(0)
        d = _distance(part, vantage)
        radius = int(np.median(d)) if len(part) else 31
        tree[node] = (int(vantage), radius)
        parts[2 * node], parts[2 * node + 1] = part[d <= radius], part[d > radius]
    return tree


def place(points: np.ndarray, tree: list[tuple[int, int]], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the point, shard, and whether it is the point's home, for each shard that its ball reaches."""
    index, node, home = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
    vantages = np.array([v for v, _ in tree], np.uint64)
    radii = np.array([r for _, r in tree], np.int16)
    for _ in range(len(tree).bit_length() - 1):
        d = np.bitwise_count(points[index] ^ vantages[node]).astype(np.int16)
        r = radii[node]
        inner, outer = d <= r + bits, d > r - bits
        index = np.concatenate([index[inner], index[outer]])
        home = np.concatenate([(home & (d <= r))[inner], (home & (d > r))[outer]])
        node = np.concatenate([2 * node[inner], 2 * node[outer] + 1])
    return index, node - len(tree), home


class Forest:
    """Spanning links of numbered points."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links_within(points: np.ndarray, homes: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between home points and all points (with distinct fingerprints) of a shard."""
    forest, found = Forest(len(points)), []
    stack = [(np.flatnonzero(homes), np.arange(len(points)))]
    while stack:
        own, asking = stack.pop()
        if len(own) and len(asking) and len(own) > _LEAF:
            vantage = points[own[len(own) // 2]]
            d = _distance(points[own], vantage)
            radius = int(np.median(d))
            if (d > radius).any():
                q = _distance(points[asking], vantage)
                stack.append((own[d <= radius], asking[q <= radius + bits]))
                stack.append((own[d > radius], asking[q > radius - bits]))
                continue
        for k in range(0, len(own), 256):
            some = own[k : k + 256]
            for m in range(0, len(asking), 4096):
                ask = asking[m : m + 4096]
                a, b = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[ask]) <= bits)
                found += [(i, j) for i, j in zip(some[a].tolist(), ask[b].tolist(), strict=True) if i != j and forest.join(i, j)]
    return found


def links(distinct: DataFrame, bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """a, b: spanning links between fingerprints fp (distinct, a written table) of at most `bits` differing bits."""
    n = distinct.count()
    depth = min(MAX_DEPTH, (n // shard_rows).bit_length())
    wanted = SAMPLE << depth
    share = F.pmod(F.xxhash64(F.lit(5), "fp"), F.lit(2**40)) < int(min(1.0, 2 * wanted / max(n, 1)) * 2**40)
    sample = distinct.filter(share).select("fp").limit(4 * wanted).toArrow().column(0).to_numpy() if depth else np.zeros(0, np.int64)
    tree = top_tree(np.unique(sample).view(np.uint64), depth) if depth else [(0, 0)]

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = batch.column(0).to_numpy().view(np.uint64)
        index, shard, home = place(points, tree, bits) if depth else (np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool))
        return pa.RecordBatch.from_arrays([pa.array(points[index].view(np.int64)), pa.array(shard.astype(np.int32)), pa.array(home)], ["fp", "shard", "home"])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        points = np.concatenate([b.column(0).to_numpy().view(np.uint64) for b in parts])
        found = links_within(points, np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in parts]), bits)
        pairs = points.view(np.int64)[np.array(found, np.int64).reshape(-1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    sent = map_batches(distinct.select("fp"), send, "fp long, shard int, home boolean")
    return sent.groupBy("shard").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of the edges (a, b) reaches.

    Rounds of star operations, each a written table, until nothing changes: every node's larger neighbours
    are linked to its least neighbour (large star), then its smaller ones (small star).
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def star(big: DataFrame, least: DataFrame) -> DataFrame:
        """A component's root has as many edges as the component has nodes: of many edges the hot nodes' are not shuffled."""
        return big.join(least, "a") if size[0] <= PLAIN_EDGES else spread_join(big, written(least), ["a"])

    while size[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = star(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = star(large, least)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).filter("a <> b").distinct()
        new = written(small)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges, before = new, size
        if now == before:
            break
        size = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups_of(rows: DataFrame, key: str, bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """key, fp, component_id (the smallest key reachable) of a written table with key and fp, with any number of rows of one fp."""
    distinct = written(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct, bits, shard_rows))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named)
    of_root = written(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = written(spread_join(named, of_root, ["root"]).select("fp", "component_id"))
    return spread_join(rows.select(key, "fp"), of_fp, ["fp"]).select(key, "fp", "component_id")


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = MAX_BITS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """key, fp, component_id for each row of docs: its fingerprint and the smallest key that it reaches by links.

    Texts of any length are read whole. Texts without words (null or empty) have fingerprint 0 and link with each
    other and what else is near. Rows with a null key get a component like others but lend it no name; a component
    of such rows alone has a null name. Repeated rows are in one component. Other columns are left out. Empty docs:
    empty result.
    """
    return groups_of(written(fingerprints(docs.select(F.col(key).alias(key), F.col(text).alias(text)), text, shingle)), key, bits, shard_rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_simhash over all documents."""
    out = near_groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
