"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least a bound, exactly verified.

A SimHash ball that holds such pairs is far too wide for a vantage-point tree over fingerprints to prune (the README
has the figures), so the tree's narrow links are only the first of two sources of candidates; the second are bands
of minimum hashes: texts that agree in all ROWS hashes of one of BANDS bands meet in a group (a pair of similarity s does
with a chance of 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8). Every candidate pair is verified by the two whole sets.

Texts with equal sets are one from the start. A group of at most GROUP texts and GROUP_HASHES hashes is looked at in one task: by the
triangle inequality, which holds for the Jaccard distance, two texts are only compared if their distances to a vantage
text differ by no more than the bound, and only until they are connected. Texts of a larger group (unlike ones with a passage in
common, or very many copies) meet again in narrower bands, of more hashes, where only near copies are still together. In what is large
there too every text is compared with the group's first one; those that are not connected by that are compared with all texts of the
group, block by block. What comes out are spanning links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import scratch
from .common import map_batches, small_batches, spread_join, text_bytes, written
from .simhash import Forest, components, links
from .words import gram_hashes, mix, word_hashes

SHINGLE, SIMILARITY, BANDS, ROWS, BITS = 5, 0.8, 20, 5, 2
GROUP, GROUP_HASHES = 200, 2_000_000
#: Bands of the texts of larger groups: a pair of similarity 0.8 meets in one with a chance of 0.9994, one of 0.3 with 0.003.
SUB_BANDS, SUB_ROWS = 40, 8
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FACTORS = mix(np.arange(1, BANDS * ROWS + 3, dtype=np.uint64)) | np.uint64(1)
_SUB_FACTORS = mix(np.arange(1, SUB_BANDS * SUB_ROWS + 1, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """A hash of each shingle, repeats included; fewer words: of all of them; none: nothing."""
    words = word_hashes(text.translate(_LOWER))[0]
    return gram_hashes(words, min(shingle, len(words))) if len(words) else words


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of shingles, as a signed number."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">i8")[0])


def band_keys(own: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band of a set of hashes; no keys for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    factors = _FACTORS[: bands * rows] if (bands, rows) == (BANDS, ROWS) else _SUB_FACTORS[: bands * rows]
    least = np.array([(own * f).min() for f in factors]).reshape(bands, rows)
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys + least[:, k])
    return keys.view(np.int64)


def sketched(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with fp, set_a, set_b (128 bits that name its set of shingles), n_set, bands. Columns of these names are replaced."""
    small_batches(docs.sparkSession)
    new = ("fp", "set_a", "set_b", "n_set", "bands")
    names = [c for c in docs.columns if c not in new]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for t in text_bytes(batch.column(names.index(text))):
            hashes = shingle_hashes(t, shingle)
            own = np.unique(hashes)
            ids = [int(x.sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in (own, mix(own ^ _FACTORS[-1]))]
            out.append((fingerprint(hashes) if len(own) else 0, *ids, len(own), band_keys(own)))
        if not out:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], [*names, *new])

    docs = docs.select(*[f"`{c}`" for c in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, make, f"{fields}, fp long, set_a long, set_b long, n_set long, bands array<bigint>")


def similarity(a: np.ndarray, b: np.ndarray, bound: float = 0.0) -> float:
    """The Jaccard similarity of two sorted sets; 0 where their sizes alone rule the bound out."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < bound * len(large):
        return 0.0
    if not len(large):
        return 1.0
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both / (len(a) + len(b) - both)


def links_of(own: list[np.ndarray], others: list[np.ndarray] | None, bound: float) -> list[tuple[int, int]]:
    """Spanning links among sets (others None), or between own and other ones (numbered after them)."""
    if len(own) < 2 and others is None:
        return []
    sets = own + (others or [])
    forest, found = Forest(len(sets)), []
    far = np.array([1 - similarity(sets[0], s) for s in sets])  # distances to the vantage set
    for i in range(len(own)):
        near = np.flatnonzero(np.abs(far - far[i]) <= 1 - bound + 1e-9)
        for j in near[near > (i if others is None else len(own) - 1)].tolist():
            if forest.root(i) != forest.root(j) and similarity(sets[i], sets[j], bound) >= bound:
                forest.join(i, j)
                found.append((i, j))
    return found


def _as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _sorted_groups(width: int, bound: float):
    """Links within groups that come one after another, sorted by their first `width` columns: (..., side, node, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        members: list[tuple] = []

        def close(out: list) -> None:
            own = [(n, _as_set(h)) for s, n, h in members if s == 0]
            others = [(n, _as_set(h)) for s, n, h in members if s == 1]
            nodes = [n for n, _ in own + others]
            found = links_of([h for _, h in own], [h for _, h in others] if others else None, bound)
            out += [(nodes[i], nodes[j]) for i, j in found if nodes[i] != nodes[j]]

        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(k).to_pylist() for k in range(width + 3)]
            for row in zip(*columns, strict=True):
                if row[:width] != held:
                    close(out)
                    held, members = row[:width], []
                members.append(row[width:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        out = []
        close(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, bound: float) -> DataFrame:
    """Of pairs (a, b) those whose sets are similar enough. A node of very many pairs is not shuffled to."""
    one = spread_join(pairs, sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), ["b"], F.length("hb"))
    both = spread_join(written(one), sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), ["a"], F.length("ha"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [similarity(_as_set(a), _as_set(b), bound) >= bound for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return map_batches(both.select("a", "b", "ha", "hb"), make, "a long, b long")


def _hashes(rows: DataFrame, nodes: DataFrame, text: str, shingle: int) -> DataFrame:
    """node, hashes (the sorted set, as bytes) of the rows with these numbers. A written table."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["node", "hashes"])

    asked = spread_join(rows.select(F.col("__row").alias("node"), text), nodes, ["node"])
    return written(map_batches(asked.select("node", text), make, "node long, hashes binary"))


def _grouped(members: DataFrame) -> DataFrame:
    """node, band, n, size, first of the members (node, n_set, band) of groups of several texts; of groups with the same texts one is left. A written table."""
    sums = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_set").alias("size"), F.min("node").alias("first"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    groups = written(sums.filter("n > 1").groupBy("n", "size", "first", "who").agg(F.min("band").alias("band")).select("band", "n", "size", "first"))
    return written(spread_join(members.select("node", "n_set", "band"), groups, ["band"]))


def _sub_bands(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_set, band: the narrower bands of these nodes' sets. A written table."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [_as_set(h) for h in batch.column(1).to_pylist()]
        keys = pa.array([band_keys(h, SUB_BANDS, SUB_ROWS) for h in own], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in own], pa.int64()), keys], ["node", "n_set", "bands"])

    some = spread_join(sets, nodes, ["node"]).select("node", "hashes")
    return written(map_batches(some, make, "node long, n_set long, bands array<bigint>").select("node", "n_set", F.explode("bands").alias("band")))


def links_between(rows: DataFrame, reps: DataFrame, text: str = "text", shingle: int = SHINGLE, bound: float = SIMILARITY) -> DataFrame:
    """a, b: spanning links between the representatives reps (node, fp, n_set, bands: written) of rows (__row, text: written)."""
    # narrow candidates: the tree's links between fingerprints, and texts with one fingerprint
    by_fp = written(reps.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    tree = written(links(by_fp.select("fp"), BITS).hint("rebalance"))
    end = lambda c: by_fp.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}"))
    tree = spread_join(written(spread_join(tree, end("a"), ["a"])), end("b"), ["b"]).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    same = spread_join(reps.select("node", "fp"), written(by_fp.filter("n > 1").select("fp", "first")), ["fp"])
    pairs = written(tree.union(same.select(F.col("node").alias("a"), F.col("first").alias("b"))).filter("a <> b").distinct())
    # wide candidates: groups of a band
    members = _grouped(written(reps.select("node", "n_set", F.explode("bands").alias("band"))))
    small = (F.col("n") <= GROUP) & (F.col("size") <= GROUP_HASHES)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct()
    sets = _hashes(rows, written(nodes), text, shingle)
    inside = members.filter(small).select("band", "node")
    # texts of large groups meet in narrower bands; of what is large there, all are compared with the first
    crowd = written(members.filter(~small).select("node").distinct())
    if crowd.isEmpty():
        crowded = None
    else:
        crowded = _grouped(_sub_bands(sets, crowd))
        inside = inside.union(crowded.filter(small).select("band", "node"))
        star = crowded.filter(~small).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
        pairs = written(pairs.union(star).distinct())
    found = _verified(pairs, sets, bound)
    met = spread_join(written(inside), sets, ["node"], F.length("hashes")).select("band", F.lit(0).alias("side"), "node", "hashes")
    found = written(found.union(met.repartition("band").sortWithinPartitions("band", "node").mapInArrow(_sorted_groups(1, bound), "a long, b long")).hint("rebalance"))
    # the rest of large groups: what isn't connected with the group's first text is compared with all of it
    if crowded is None:
        return found
    large = written(crowded.filter(~small).select("band", "node", "first"))
    if large.isEmpty():
        return found
    roots = written(components(found).select("node", "root"))
    of = lambda name: F.coalesce(F.col(f"{name}_root"), F.col(name))
    joined = large.join(roots.select("node", F.col("root").alias("node_root")), "node", "left").join(roots.select(F.col("node").alias("first"), F.col("root").alias("first_root")), "first", "left")
    rest = written(joined.filter(of("node") != of("first")).select("band", "node"))
    if rest.isEmpty():
        return found
    n_rest = rest.groupBy("band").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("asking"))
    n_all = large.groupBy("band").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("asked"))
    blocks = written(n_rest.join(n_all, "band"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asking = spread_join(rest, blocks, ["band"]).select("band", block("asking").alias("p"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("q"), F.lit(0).alias("side"), "node")
    asked = spread_join(large.select("band", "node"), blocks, ["band"]).select("band", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("p"), block("asked").alias("q"), F.lit(1).alias("side"), "node")
    blocked = spread_join(written(asking.union(asked)), sets, ["node"], F.length("hashes")).select("band", "p", "q", "side", "node", "hashes")
    more = blocked.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q", "side", "node").mapInArrow(_sorted_groups(3, bound), "a long, b long")
    return written(found.union(more).hint("rebalance"))


def near_rows(rows: DataFrame, key: str, text: str = "text", shingle: int = SHINGLE, bound: float = SIMILARITY) -> DataFrame:
    """__row of each row that isn't the first (by key, without ties) of its group. rows: a written table of sketched() with __row, a number of each row.

    Null and empty texts have the empty set, and are one group. Texts of fewer words than a shingle are one shingle.
    Repeated rows have equal sets. Empty rows: empty result. A written table; those made on the way go.
    """
    with scratch(rows.sparkSession):
        least = written(rows.groupBy("set_a", "set_b", "n_set").agg(F.min(F.struct(key, "__row")).alias("first")).select("set_a", "set_b", "n_set", F.col("first.__row").alias("node"), F.col(f"first.{key}").alias("key")))
        reps = written(rows.select(F.col("__row").alias("node"), "fp", "n_set", "bands").join(least.select("node"), "node"))
        roots = written(components(links_between(rows, reps, text, shingle, bound)))
        named = written(least.join(roots, "node", "left").select("set_a", "set_b", "n_set", "node", "key", F.coalesce("root", "node").alias("root")))
        stays = written(named.groupBy("root").agg(F.min(F.struct("key", "node")).alias("m")).select("root", F.col("m.node").alias("stays")))
        of_set = written(spread_join(named.select("set_a", "set_b", "n_set", "root"), stays, ["root"]).drop("root"))
        return written(spread_join(rows.select("__row", "set_a", "set_b", "n_set"), of_set, ["set_a", "set_b", "n_set"]).filter("__row <> stays").select("__row"), lasting=True)
