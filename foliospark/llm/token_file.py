"""Token ids in files of word-aligned Simple-8b blocks.

A 64-bit word has a selector in its upper 4 bits and ids in its lower 60: as many, of as few bits each, as
fit. Selector 15 is the escape: the next whole word is one id of 60 bits or more. A block holds the ids of
some documents in a row: a header (magic, range, place of its first id in the range, counts), each
document's doc_id, number of ids and word offset, then the words; documents begin at words of their own.
Blocks of one range of doc_id stand one after another, in ascending order, in files of FILE_BLOCKS blocks at
most, and end with the mark that Spark's text writer puts there. All words of a block are decoded at once, selector by selector.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, Shared, in_ranges, map_batches, shared_dir, small_batches, with_range, written

#: Ids in a word, and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 15
MARK, MAGIC = "S8BLOCK\n", b"SIMPLE8B"
BLOCK_IDS, KEEP, END_ID = 262_144, 600_000, 2
#: The stores of stretches have KEEP of them at most, of so many bytes; the newer one becomes the older one when it has half of that.
KEEP_BYTES = 32 << 20
#: Texts of about so many bytes are encoded at once.
SLICE = 1 << 21
#: A file has at most as many blocks, so that a reader holds some 100 MB.
FILE_BLOCKS = 128
_HEAD = struct.Struct("<8sqqqq")  # magic, range, first id's place in the range, documents, words


def pack(ids: np.ndarray) -> np.ndarray:
    """The words of unsigned 64-bit ids."""
    return pack_all([ids])[0]


def pack_all(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all docs' ids, one after another, and each one's number of words. Each begins at a word of its own."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    n = int(sizes.sum()) + len(docs)
    ends = np.cumsum(sizes + 1) - 1  # a place after each document that fits into no word
    ids = np.zeros(n + int(COUNTS[0]), np.uint64)
    inside = np.ones(n, bool)
    inside[ends] = False
    ids[:n][inside] = np.concatenate([np.zeros(0, np.uint64), *(d.astype(np.uint64, copy=False) for d in docs)])
    # the narrowest selector for each id alone; the widest of k ids in a row, for the k of each selector
    need = np.searchsorted((np.uint64(1) << BITS.astype(np.uint64)) - np.uint64(1), ids).astype(np.int8)
    need[n:] = ESCAPE
    need[ends] = ESCAPE
    choice = np.full(n, len(COUNTS), np.int8)  # none fits: the escape
    widest, k = need, 1
    for s in range(len(COUNTS) - 1, -1, -1):
        while k < COUNTS[s]:
            more = min(k, int(COUNTS[s]) - k)
            widest = np.maximum(widest, np.concatenate([widest[more:], np.full(more, ESCAPE, np.int8)]))
            k += more
        choice[widest[:n] <= s] = s
    counts = np.append(COUNTS, 1)[choice]
    counts[ends] = 1
    step = counts.tolist()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    starts = starts[inside[starts]]
    chosen = choice[starts]
    size = np.where(chosen == len(COUNTS), 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        own = chosen == s
        if s == len(COUNTS):
            words[where[own]] = np.uint64(ESCAPE << 60)
            words[where[own] + 1] = ids[starts[own]]
            continue
        word, first = np.full(int(own.sum()), s << 60, np.uint64), starts[own]
        for i in range(int(COUNTS[s])):
            word |= ids[first + i] << np.uint64(i * int(BITS[s]))
        words[where[own]] = word
    return words, np.bincount(np.searchsorted(ends, starts), size, len(docs)).astype(np.int64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of a block's words, all at once."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    value = np.zeros(n, bool)
    # A word after an escape is a value whatever its own upper bits are; only escapes need a look in order.
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not value[i] and i + 1 < n:
            value[i + 1] = True
    counts = np.where(value, 0, np.append(COUNTS, [0, 1])[selector])
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]), np.uint64)
    for s in np.unique(selector[~value]):
        own = np.flatnonzero((selector == s) & ~value)
        if s == ESCAPE:
            out[ends[own] - 1] = words[own + 1]
            continue
        k = int(COUNTS[s])
        shift = (np.arange(k) * BITS[s]).astype(np.uint64)
        out[(ends[own] - k)[:, None] + np.arange(k)] = (words[own][:, None] >> shift) & np.uint64((1 << int(BITS[s])) - 1)
    return out


def write_block(part: int, first: int, ids: list[int], docs: list[np.ndarray]) -> bytes:
    body, words = pack_all(docs)
    table = np.zeros((len(ids), 3), "<i8")
    table[:, 0] = ids
    table[:, 1] = [len(d) for d in docs]
    table[:, 2] = np.cumsum(words) - words
    return _HEAD.pack(MAGIC, part, first, len(ids), len(body)) + table.tobytes() + body.astype("<u8").tobytes()


def read_blocks(file: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """range, place of the first id in it, the documents' table, all ids, of each block of a file."""
    at = 0
    while at < len(file):
        magic, part, first, n, words = _HEAD.unpack_from(file, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += _HEAD.size
        table = np.frombuffer(file, "<i8", 3 * n, at).reshape(n, 3)
        at += 24 * n
        ids = unpack(np.frombuffer(file, "<u8", words, at))
        at += 8 * words + len(MARK)
        if len(ids) != table[:, 1].sum():
            raise ValueError("a block has other ids than its table says")
        yield part, first, table, ids


#: ASCII marks that may end a stretch (no apostrophe, which may belong to what is before it), and the bytes that
#: may stand before them: a letter or digit, or the last two of a letter of U+00C0 to U+024F (not the signs among them, nor the dotted I,
#: which ends in a mark in lower case).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ENDS, _LEADS = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_LEADS[0xC3:0xCA] = True
_SIGNS = [0xC397, 0xC3B7, 0xC4B0]
_BETWEEN = "\x01"


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each value begins and the last one ends."""
    _, bounds, data = strings.cast(pa.string()).buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(bounds, np.int32)[strings.offset :][: len(strings) + 1].astype(np.int64)


def _gathered(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of flat, sizes long from first on, one after another."""
    upto = np.cumsum(sizes)
    return flat[np.arange(int(sizes.sum())) + np.repeat(first - (upto - sizes), sizes)]


class Encoder:
    """Ids of texts by a tokenizers file; keeps the ids of pieces of stretches without white space that it has seen.

    Where the tokenizer splits marks from letters and digits (which is looked at once), marks at the end
    of a stretch are a piece of their own, so that a word's ids are found with any marks after it; Arrow cuts them off all distinct stretches at once. Where it puts
    all into lower case, so are pieces of ASCII letters and digits before they are looked up. Where its last ids of words are ids of
    their own kind (an end-of-word suffix), many words are encoded as one text and told apart by these.
    """

    def __init__(self, config: bytes, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(config)
        self.keep, self.spent = keep, 0
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}  # the store before it was last emptied; what is met again comes back
        one = self.tokenizer.encode
        alone = one(_BETWEEN, add_special_tokens=False).ids
        self.between = alone[0] if len(alone) == 1 else -1
        self.splits = self.between >= 0 and one(f"ab {_BETWEEN} c", add_special_tokens=False).ids == one("ab", add_special_tokens=False).ids + alone + one("c", add_special_tokens=False).ids and all(one(a + b, add_special_tokens=False).ids == one(a, add_special_tokens=False).ids + one(b, add_special_tokens=False).ids for a in ("a", "Bcd", "7", "xé", "it's") for b in ".,;:!?%)]}>\"&*/_-+=~^`|$#@(<[{\\")

        said = json.loads(config)
        steps = said.get("normalizer") or {}
        steps = steps.get("normalizers", [steps])
        # of ASCII letters and digits these change the case alone; added tokens are looked for before
        plain = all(x.get("type") in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or (x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"}) for x in steps)
        self.lower = self.splits and plain and any(x["type"] == "Lowercase" for x in steps) and not any(x["content"].isalnum() for x in said.get("added_tokens", []))
        suffix = said.get("model", {}).get("end_of_word_suffix")
        self.last = np.zeros(0, bool)
        if suffix and self.splits and len(one("ab cd ef", add_special_tokens=False).ids) == sum(len(one(x, add_special_tokens=False).ids) for x in ("ab", "cd", "ef")):
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def learn(self, new: list[str]) -> None:
        """Puts the ids of pieces not yet known into the store."""
        if len(self.last):
            self._learn_words([p for p in new if p.isalpha()])
            new = [p for p in new if not p.isalpha()]
        self._learn(new)

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters alone as texts of many. A word ends with an id of that kind at least once; if there are as many such ids as words, each does once."""
        known = self.known
        for k in range(0, len(words), 512):
            part = words[k : k + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(part):
                self._learn(part)
                continue
            raw, at = ids.tobytes(), 0
            for p, end in zip(part, ends.tolist(), strict=True):
                known[p] = raw[at:end]
                at = end

    def _learn(self, new: list[str]) -> None:
        """Many pieces as one text, with a character between them that has an id of its own."""
        between = self.between
        for k in range(0, len(new), 512):
            part = new[k : k + 512]
            found = self.tokenizer.encode_batch_fast([f" {_BETWEEN} ".join(part)], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == between), len(ids)).tolist()
            if len(ends) != len(part) or not self.splits:  # a piece has that character
                self.known.update((p, np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()) for p in part)
                continue
            raw, at = ids.tobytes(), 0
            for p, end in zip(part, ends, strict=True):
                self.known[p] = raw[4 * at : 4 * end]
                at = end + 1

    def _cut(self, stretches: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Distinct stretches without the marks at their ends, and these marks (none where the stretch stays whole)."""
        heads, n = stretches, len(stretches)
        cut, marks = np.zeros(n, bool), b""
        sizes = np.zeros(n, np.int64)
        if self.splits and n:
            bare = pc.ascii_rtrim(stretches, characters=_MARKS)
            left, full = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (bare, stretches))
            at = np.flatnonzero((left > 0) & (left < full))
            data, bounds = _bytes_of(bare)
            last = data[bounds[at + 1] - 1]
            before = np.where(left[at] > 1, data[np.maximum(bounds[at + 1] - 2, 0)], 0)
            at = at[_ENDS[last] | (_LEADS[before] & ~np.isin((before.astype(np.int64) << 8) | last, _SIGNS))]
            at = at[~pc.match_substring(stretches.take(pa.array(at)), "<|").to_numpy(zero_copy_only=False)]
            cut[at] = True
            heads = pc.if_else(pa.array(cut), bare, stretches)
            sizes[at] = (full - left)[at]
            data, bounds = _bytes_of(stretches)
            marks = _gathered(data, bounds[at] + left[at], sizes[at]).tobytes()
            if self.lower:
                heads = pc.if_else(pc.ascii_is_alnum(heads), pc.ascii_lower(heads), heads)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return heads, pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(marks)])

    def _ids_of(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct stretches, one after another, and how many each has."""
        if 2 * len(self.known) > self.keep or 2 * self.spent > KEEP_BYTES:
            self.known, self.older, self.spent = {"": b""}, self.known, 0
        heads, tails = self._cut(stretches)
        numbered = pa.concat_arrays([heads.cast(pa.string()), tails]).dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, older = self.known, self.older
        ids = list(map(known.get, pieces))
        unknown, new = [k for k, x in enumerate(ids) if x is None], []
        self.spent += int(pc.binary_length(numbered.dictionary).to_numpy()[unknown].sum())
        for k in unknown:
            p = pieces[k]
            if (found := older.get(p)) is None:
                new.append(p)
            else:
                known[p] = found
        self.learn(new)
        for k in unknown:
            ids[k] = known[pieces[k]]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        code = numbered.indices.to_numpy().reshape(2, -1).T.ravel()  # a stretch's head, then its tail
        here = sizes[code]
        return _gathered(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(sizes) - sizes)[code], here), here.reshape(-1, 2).sum(1)

    def encode_column(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of each text of a string column (null: none), 32 bits each, little-endian, as a binary column; end is put after each.

        Arrow cuts the texts at white space and numbers the distinct stretches, whose ids are then gathered at once.
        """
        parts, at, most = [], 0, min(SLICE, KEEP_BYTES // 2)  # the store's bound holds with a slice's own stretches
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            parts.append(self._encode_slice(texts.slice(at, upto - at), end))
            at = upto
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _encode_slice(self, texts: pa.Array, end: int | None) -> pa.Array:
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends_of_texts = np.cumsum(pc.list_value_length(words).to_numpy())
        numbered = words.flatten().dictionary_encode()
        ids, sizes = self._ids_of(numbered.dictionary)
        code = numbered.indices.to_numpy()
        here = sizes[code]
        upto = np.cumsum(here)
        flat = _gathered(ids, (np.cumsum(sizes) - sizes)[code], here)
        bounds = np.concatenate([[0], np.concatenate([[0], upto])[ends_of_texts]])
        if end is not None:
            flat = np.insert(flat, bounds[1:], end)
            bounds = bounds + np.arange(len(bounds))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, 32 bits each, little-endian."""
        return self.encode_column(pa.array(texts, pa.binary()).cast(pa.string())).to_pylist()


_ENCODER: list = []


def _encoder(shared: Shared) -> Encoder:
    if not _ENCODER or _ENCODER[0] != shared.key:
        _ENCODER[:] = [shared.key, Encoder(shared.value)]
    return _ENCODER[1]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of docs (doc_id, text) below path, in ascending order of doc_id (null first; equal ones by their ids).

    Texts are encoded where they are read; their ids go to ranges of doc_id, neighbouring ranges to one partition, sorted, and are packed there. So files ascend
    by name, and blocks in each. Every range is a part of one file, or of some in a row; its blocks have block_ids ids, or one
    longer document, whatever its length. Null and empty texts have the end id alone. Repeated rows are documents of their
    own, other columns are left out. No docs: no blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer or default_tokenizer(), "rb") as f:
        shared = Shared(spark, f.read())
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged, ranges = with_range(docs, "doc_id")

    def ids_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), _encoder(shared).encode_column(batch.column(1), end_id), batch.column(2)], ["doc_id", "ids", "range"])

    rows = in_ranges(map_batches(ranged.select("doc_id", "text", "range"), ids_of, "doc_id long, ids binary, range int"), ranges, "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, ids, docs_ = None, 0, 0, [], []
        for batch in batches:
            out = []
            for i, raw, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if ids and (own != part or held >= block_ids):
                    out.append(write_block(part, first, ids, docs_))
                    first, held, ids, docs_ = first + held, 0, [], []
                if own != part:
                    part, first = own, 0
                ids.append(i)
                docs_.append(np.frombuffer(raw, "<u4"))
                held += len(docs_[-1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["block"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([write_block(part, first, ids, docs_)], pa.binary())], ["block"])

    blocks = rows.mapInArrow(run, "block binary").select(F.col("block").cast("string"))
    blocks.write.option("lineSep", MARK).option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (array<long>) from the files below path. No blocks: no rows."""
    small_batches(spark)
    return _read(spark, path, _rows_of_ids, "range int, doc_id long, place long, n_tokens long, ids array<long>").select("doc_id", "start", "ids")


def _read(spark: SparkSession, path: str, rows, columns: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = written(map_batches(files, rows, columns))
    # one row for each range
    totals = found.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    base = totals.withColumn("base", F.sum("n").over(Window.orderBy("range")) - F.col("n")).select("range", "base")
    out = found.join(F.broadcast(base), "range").withColumn("start", F.col("base") + F.col("place"))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _rows_of_ids(batch: pa.RecordBatch) -> pa.RecordBatch:
    return _rows(batch, lambda ids, ends: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))), pa.list_(pa.int64()), "ids")


def _rows_of_crc(batch: pa.RecordBatch) -> pa.RecordBatch:
    def crc(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        raw = ids.astype("<u4").tobytes()
        return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.int64())

    return _rows(batch, crc, pa.int64(), "ids_crc32")


def _rows(batch: pa.RecordBatch, last, kind: pa.DataType, name: str) -> pa.Table | None:
    out = []
    names = ["range", "doc_id", "place", "n_tokens", name]
    for file in batch.column(0):
        for part, first, table, ids in read_blocks(file.as_py()):
            ends = np.cumsum(table[:, 1])
            out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(table), part, np.int32)), pa.array(table[:, 0].astype(np.int64)), pa.array(first + ends - table[:, 1]), pa.array(table[:, 1].astype(np.int64)), last(ids, ends)], names))
    return pa.Table.from_batches(out) if out else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_token_file: all documents' ids, written to files and read back."""
    path = shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return _read(spark, path, _rows_of_crc, "range int, doc_id long, place long, n_tokens long, ids_crc32 long").select("doc_id", "start", "n_tokens", "ids_crc32")
