"""Token counts by a map-side lookup in two tiers.

A text is cut before each run of blanks into pre-tokens, which the tokenizer encodes independently (no
piece of the model has a blank after another character), so that a document's tokens are the sum over
its pre-tokens. First tier: a broadcast table of the TABLE most frequent pre-tokens' lengths. Second
tier: a store of bounded size in each worker; what neither has is encoded there. Pre-tokens are never
shuffled: for the table, each task counts its own share of the whole corpus in bounded memory, and only
its HEAVY most frequent ones are summed up.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, map_batches, small_batches, spread

TABLE, HEAVY, KEEP, LIMIT = 20_000, 4_000, 300_000, 4096
#: The workers' stores are also emptied when their pre-tokens have so many characters.
KEEP_CHARS = 16 << 20
_BLANK = "▁"
_runs = regex.compile(" {2,}").search


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first blank; the model puts one before every text."""
    text = text.replace(_BLANK, " ")
    if not text:
        return []
    parts = text.split(" ")
    if not _runs(text) and parts[0] and parts[-1]:
        return parts
    # Blanks in a row belong to the word after them, those at the end are a pre-token of their own.
    out, blanks = [], 0
    for i, part in enumerate(parts):
        if part or i == len(parts) - 1:
            out.append(" " * blanks + part)
            blanks = 0
        else:
            blanks += 1
    return out


class Counts:
    """Lengths of pre-tokens by one sentencepiece model."""

    def __init__(self, model: bytes, table: dict[str, int], keep: int = KEEP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table, self.keep, self.spent = table, keep, 0
        self.known: dict[str, int] = {}
        self.alone = len(self.model.encode("a ")) - len(self.model.encode("a"))  # a single blank; the model drops an empty text

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(x) if p else self.alone for p, x in zip(parts, self.model.encode(parts, num_threads=1), strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for k in range(0, len(texts), 32):
            held = [Counter(pre_tokens(t)) for t in texts[k : k + 32]]
            if len(self.known) > self.keep or self.spent > KEEP_CHARS:
                self.known.clear()
                self.spent = 0
            table, known = self.table, self.known
            new = list({p for c in held for p in c if p not in table and p not in known})
            self.spent += sum(map(len, new))
            known.update(zip(new, self.lengths(new), strict=True))
            out += [sum([n * (table[p] if p in table else known[p]) for p, n in c.items()]) for c in held]
        return out


_COUNTS: list = []


def _counts(model: Shared, table: Shared) -> Counts:
    if not _COUNTS or _COUNTS[0] != (model.key, table.key):
        _COUNTS[:] = [(model.key, table.key), Counts(model.value, json.loads(table.value))]
    return _COUNTS[1]


def frequent(docs: DataFrame, text: str = "text", table: int = TABLE, heavy: int = HEAVY) -> list[str]:
    """At most `table` of the most frequent pre-tokens, from all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(p for p in pre_tokens(t) if len(p) < 64)
                    if len(seen) > 20 * heavy:
                        seen = Counter(dict(seen.most_common(5 * heavy)))
        top = seen.most_common(heavy)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["part", "n"])

    found = docs.select(text).mapInArrow(run, "part string, n long")
    rows = found.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(table).collect()
    return [r["part"] for r in rows]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count(docs: DataFrame, model: str | None = None, text: str = "text", limit: int = LIMIT, table: int = TABLE) -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit. Null and empty texts: 0 tokens. Special strings count as plain text.

    Columns of these names are replaced, others stay; texts of any length are counted whole; repeated rows give equal
    results. Empty docs: empty result. The model must have no
    normalisation and no piece that goes on after a blank within it, else ValueError.
    """
    import sentencepiece

    spark = docs.sparkSession
    small_batches(spark)
    with open(model or default_model(), "rb") as f:
        proto = f.read()
    pieces = sentencepiece.SentencePieceProcessor(model_proto=proto)
    if any(regex.search(f"[^{_BLANK}]{_BLANK}", pieces.id_to_piece(i)) for i in range(pieces.get_piece_size())) or len(pieces.encode("Å  ﬁ", out_type=str)) == len(pieces.encode("Å fi", out_type=str)):
        raise ValueError("the model's tokens go across blanks, or it normalises texts")
    common = [p for p in frequent(docs, text, table) if p]
    lengths = Shared(spark, json.dumps(dict(zip(common, Counts(proto, {}).lengths(common), strict=True))).encode())
    shared = Shared(spark, proto)
    names = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
        n = _counts(shared, lengths).counts(texts)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [*names, "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, make, schema + ", n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_token_counts over all documents."""
    return count(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).select("doc_id", "n_bytes", "n_tokens", "over_limit")
