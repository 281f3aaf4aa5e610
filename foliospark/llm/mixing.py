"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised: 1 leaves the shares as they are,
0 makes all alike, more than 1 sharpens them. The exponent is bisected until the weights have a target
entropy, or until no source is read more than max_repeats times. The sums that this needs are aggregations of
the table of sources: each step tries GRID exponents in one job and goes on in the interval between two of
them, and only these sums reach the driver, never the sources.

A source's budget is its weight times the budget of all. It is realised as block permutations: a document belongs to a
block of its source for good, by a hash (2**k blocks of about BLOCK_ROWS documents). Each pass over a source permutes the numbers of
its blocks, by a bijection of k bits whose constants are hashes of source and pass, and the documents in each block, by
another hash. Every whole pass takes all blocks; the last one takes whole blocks in their order until the budget is met, and the
block in which it is met is cut at a place. That place is all that the last step needs to know of a source, so that texts are
never moved to choose among them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binding import let
from .common import lookup_join, partitions, written

GRID, BLOCK_ROWS, SEED = 33, 16, 7
#: Halvings of the interval of exponents, and its end for targets that sharpen.
STEPS, MOST_EXPONENT = 30, 16.0
#: Places in a pass are whole numbers below this, exact as doubles; a source has at most 2**MOST_BITS blocks.
PLACES, MOST_BITS = 2**52, 30
#: The query's target: this share of the way from the sources' own entropy to the largest possible one.
GAIN = 0.5


def named(source: Column) -> Column:
    """A source's name without nulls; a null source is another one than that of the empty name."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("s"), source.cast("string")))


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame, source: str = "source", tokens: Column | None = None) -> DataFrame:
    """source, docs, tokens of each source; words of the text unless another measure is given. A written table."""
    n = words() if tokens is None else tokens
    return written(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"), F.sum(F.coalesce(n, F.lit(0))).alias("tokens")))


def _bisect(value: Callable[[list[float]], list[float]], target: float, low: float, high: float) -> float:
    """The least exponent of the interval, to 2**-STEPS of it, whose falling value is at most target (high if none is)."""
    if value([low])[0] <= target:
        return low
    for _ in range(STEPS // int(math.log2(GRID - 1))):
        grid = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
        at = next((i for i, v in enumerate(value(grid)) if i and v <= target), None)
        if at is None:
            return high
        low, high = grid[at - 1], grid[at]
    return high


def entropies(sources: DataFrame, total: float, exponents: list[float]) -> list[float]:
    """The entropy of the sources' weights at each exponent, in one job."""
    rows = sources.select((F.col("tokens") / F.lit(float(total))).alias("share"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    power = F.pow("share", "a")
    sums = {r["a"]: (r["z"], r["l"]) for r in rows.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share") * F.col("a")).alias("l")).collect()}
    return [math.log(sums[a][0]) - sums[a][1] / sums[a][0] for a in exponents]


def exponent(sources: DataFrame, entropy: float | None = None, gain: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent for a target entropy, for a repetition limit, or the larger one of both.

    The target is a share of the largest possible entropy (entropy), or of the way from the sources' own entropy
    to that (gain, 0 to 1). A target below the sources' own entropy sharpens: the exponent is over 1, MOST_EXPONENT
    at most. With max_repeats the source with the fewest tokens is read at most so often as the one with the most. Sources
    without tokens don't count. No source, or no target and no limit: 1.
    """
    sources = sources.filter("tokens > 0")
    n, total, least, most = sources.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n or (entropy, gain, max_repeats) == (None, None, None):
        return 1.0
    found = []
    if max_repeats is not None:
        found.append(_bisect(lambda grid: [(most / least) ** (1 - a) for a in grid], max_repeats, 0.0, 1.0))
    if (entropy, gain) != (None, None):
        own = entropies(sources, total, [1.0])[0]
        target = own + gain * (math.log(n) - own) if entropy is None else entropy * math.log(n)
        ends = (0.0, 1.0) if own <= target else (1.0, MOST_EXPONENT)
        found.append(_bisect(lambda grid: entropies(sources, total, grid), target, *ends))
    return max(found)


def budgets(sources: DataFrame, alpha: float, budget: float | None = None) -> DataFrame:
    """sources with exponent, weight, budget (long), passes: what each source gives to a budget of tokens.

    Without a budget: the least one that reads every source once in full at least.
    """
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(F.lit(0.0))
    z, cover = sources.agg(F.sum(power), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / power))).first()
    z = z or 1.0
    budget = (cover or 0.0) * z if budget is None else budget
    weight = power / F.lit(z)
    out = sources.withColumn("exponent", F.lit(alpha)).withColumn("weight", weight).withColumn("budget", F.round(weight * F.lit(float(budget))).cast("long"))
    return out.withColumn("passes", F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(F.lit(0.0)))


def _digest(*parts: str | Column) -> Column:
    """A hash from 0 to PLACES: the first 13 hex digits of an MD5."""
    texts = [F.lit(x) if isinstance(x, str) else x for x in parts]
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(SEED)), *texts)), F.lit(13)), 16, 10).cast("long")


def _shifted(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n.cast("int"))


def block_bits(docs: Column) -> Column:
    """k, where a source of so many documents has 2**k blocks."""
    n = F.ceil(docs / BLOCK_ROWS)
    return F.least(F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0), F.lit(MOST_BITS)).cast("int")


def block(name: Column, key: Column, bits: Column) -> Column:
    """A document's block, whatever the pass."""
    return _shifted(_digest("block", F.coalesce(key.cast("string"), F.lit("")), name), 52 - bits)


def slot(name: Column, own: Column, turn: Column, bits: Column) -> Column:
    """The place of a block among those of its source in a pass: a bijection of its number's bits."""
    most = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def round_(step: str, x: Column) -> Column:
        d = _digest("pass", step, turn.cast("string"), name)
        return let(d, lambda c: (x * c.bitwiseAND(most).bitwiseOR(F.lit(1)) + _shifted(c, F.lit(20))).bitwiseAND(most))

    return round_("b", let(round_("a", own), lambda x: x.bitwiseXOR(_shifted(x, F.floor((bits + 1) / 2)))))


def place(name: Column, key: Column, turn: Column, bits: Column) -> Column:
    """A document's place in a pass, from 0 to PLACES: block after block."""
    inside = _digest(turn.cast("string"), F.coalesce(key.cast("string"), F.lit("")), name)
    return slot(name, block(name, key, bits), turn, bits) * F.call_function("shiftleft", F.lit(1).cast("long"), 52 - bits) + _shifted(inside, bits)


def _last_places(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """name, last_place: the last place that each source's part of a pass takes, where it has one."""
    last = lookup_join(slim, plan.filter("rest > 0").select("name", "bits", "whole", "rest"), "name", "inner")
    last = last.withColumn("place", place(F.col("name"), F.col("key"), F.col("whole"), F.col("bits"))).withColumn("slot", _shifted(F.col("place"), 52 - F.col("bits")))
    totals = last.groupBy("name", "slot", "rest").agg(F.sum("tokens").alias("in_block"))
    before = F.sum("in_block").over(Window.partitionBy("name").orderBy("slot")) - F.col("in_block")
    cut = totals.withColumn("before", before).filter("before < rest AND before + in_block >= rest")
    cut = written(cut.select("name", F.col("slot").alias("cut"), "before"))
    inside = lookup_join(last, cut, "name", "inner").filter("slot = cut")
    inside = inside.groupBy("name", "place", "rest", "before").agg(F.sum("tokens").alias("here"))
    ahead = F.sum("here").over(Window.partitionBy("name").orderBy("place")) - F.col("here")
    return inside.withColumn("ahead", ahead).filter("before + ahead < rest").groupBy("name").agg(F.max("place").alias("last_place"))


def mix(docs: DataFrame, entropy: float | None = None, gain: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None, source: str = "source", key: str = "doc_id", tokens: Column | None = None, detail: bool = False) -> DataFrame:
    """docs, each row as often as its source's budget says; adds epoch (int, from 0), block (int, the same in all epochs) and mix_order (double).

    Sorted by mix_order, every stretch of the result holds the sources by their weights (arranged() does so).
    detail adds the source's exponent, weight and passes as well. Columns of docs with these names are replaced;
    all other columns stay as they are, whatever their names.

    A document's tokens are the words of its text, of any length, unless another measure is given; the last
    document taken may go over its source's budget. Documents without tokens (null or empty text) go with their
    source's whole passes and with their places in the last one; a source that has none but these gives
    nothing. A null source is a source of its own. Rows of a source with equal keys (null is one) have one
    place, so that they are taken together, all of them. Empty docs: empty result.
    """
    new = ["epoch", "block", "mix_order", *["exponent", "weight", "passes"] * detail]
    names = [c for c in docs.columns if c not in new]
    n = words() if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("row"), F.col(key).alias("key"), named(F.col(source)).alias("name"), n.alias("tokens"))
    slim = written(rows.select("key", "name", "tokens"))
    sources = source_tokens(slim, "name", F.col("tokens")).withColumnRenamed("source", "name")
    plan = budgets(sources, exponent(sources, entropy, gain, max_repeats), budget)
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = written(plan.withColumn("bits", block_bits(F.col("docs"))).drop("tokens", "docs", "budget"))
    plan = written(plan.join(_last_places(slim, plan), "name", "left").drop("rest"))
    joined = lookup_join(rows.drop("tokens"), plan, "name", "inner")
    of_pass = lambda turn: place(F.col("name"), F.col("key"), turn, F.col("bits"))
    turns = F.col("whole") + F.when(of_pass(F.col("whole")) <= F.col("last_place"), 1).otherwise(0)
    joined = joined.withColumn("turns", turns).filter("turns > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    joined = joined.withColumn("place", of_pass(F.col("epoch"))).withColumn("block", block(F.col("name"), F.col("key"), F.col("bits")).cast("int"))
    order = (F.col("epoch") + F.col("place") / PLACES) / F.col("passes")
    return joined.select("row.*", "epoch", "block", order.alias("mix_order"), *new[3:])


def arranged(mixture: DataFrame) -> DataFrame:
    """A mixture in order: partitions of equal stretches of mix_order, each sorted, so that files written are in order by name."""
    n = partitions(mixture.sparkSession)
    at = F.least(F.floor(F.col("mix_order") * n), F.lit(n - 1)).cast("int")
    return mixture.repartitionById(n, at).sortWithinPartitions("mix_order")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_mixing: every document's places in the mixture, with its source's exponent, weight and passes.

    The target lies half the way from the sources' own entropy to the largest; the budget is all tokens. Sources
    with more than their weight are cut by design, others repeat.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", words().alias("n_tokens"))
    slim = written(docs)
    total = slim.agg(F.sum("n_tokens")).first()[0] or 0
    out = mix(slim, gain=GAIN, max_repeats=None, budget=total, tokens=F.col("n_tokens"), detail=True)
    return out.withColumn("weight", F.round("weight", 9)).withColumn("passes", F.round("passes", 9)).withColumn("mix_order", F.round("mix_order", 12))


def _digest_sql(*parts: str) -> str:
    return f"('0x' || left(md5('{SEED}:' || {" || ':' || ".join(parts)}), 13))::BIGINT"


def _place_sql(turn: str) -> str:
    """place(): the block's slot in the upper bits."""
    key, most = "coalesce(doc_id::VARCHAR, '')", "((1::BIGINT << bits) - 1)"
    a, b = (_digest_sql("'pass'", f"'{step}'", f"({turn})::VARCHAR", "name") for step in "ab")
    first = f"(((({_digest_sql("'block'", key, 'name')} >> (52 - bits)) * ((({a}) & {most}) | 1) + (({a}) >> 20)) & {most}))"
    mixed = f"xor({first}, {first} >> ((bits + 1) // 2)::INT)"
    return f"(((({mixed}) * ((({b}) & {most}) | 1) + (({b}) >> 20)) & {most}) << (52 - bits)) + ({_digest_sql(f'({turn})::VARCHAR', key, 'name')} >> bits)"


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS name,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
s AS (SELECT name, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY name),
pos AS (SELECT name, tokens::DOUBLE / (SELECT sum(tokens) FROM s)::DOUBLE AS share FROM s WHERE tokens > 0),
target AS (SELECT own + {GAIN} * (ln(n) - own) AS t FROM (SELECT -sum(share * ln(share)) AS own, count(*) AS n FROM pos)),
halved(low, high, step) AS (SELECT 0.0::DOUBLE, 1.0::DOUBLE, 0
 UNION ALL SELECT CASE WHEN h <= t THEN low ELSE mid END, CASE WHEN h <= t THEN mid ELSE high END, step + 1
 FROM (SELECT low, high, step, any_value(t) AS t, any_value((low + high) / 2) AS mid,
   ln(sum(pow(share, (low + high) / 2))) - sum(pow(share, (low + high) / 2) * ln(share) * (low + high) / 2) / sum(pow(share, (low + high) / 2)) AS h
   FROM halved, pos, target WHERE step < {STEPS} GROUP BY low, high, step)),
alpha AS (SELECT max(high) AS exponent FROM halved WHERE step = {STEPS}),
w AS (SELECT name, docs, tokens, exponent, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, exponent) ELSE 0 END AS power FROM s, alpha),
plan AS (SELECT *, CASE WHEN tokens > 0 THEN budget / tokens ELSE 0 END AS passes, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
  least(CASE WHEN ceil(docs / {BLOCK_ROWS}) > 1 THEN length(bin(ceil(docs / {BLOCK_ROWS})::BIGINT - 1)) ELSE 0 END, {MOST_BITS})::INT AS bits
  FROM (SELECT *, power / sum(power) OVER () AS weight, round(power / sum(power) OVER () * sum(tokens) OVER ())::BIGINT AS budget FROM w)),
ordered AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY name ORDER BY place RANGE UNBOUNDED PRECEDING) - sum(n_tokens) OVER (PARTITION BY name, place), 0) AS ahead
  FROM (SELECT doc_id, name, n_tokens, budget - whole * tokens AS rest, {_place_sql("whole")} AS place FROM d JOIN plan USING (name))),
last AS (SELECT name, max(place) AS last_place FROM ordered WHERE ahead < rest GROUP BY name),
taken AS (SELECT *, unnest(range(whole + CASE WHEN {_place_sql("whole")} <= last_place THEN 1 ELSE 0 END)) AS epoch FROM d JOIN plan USING (name) LEFT JOIN last USING (name)),
placed AS (SELECT *, {_place_sql("epoch")} AS place FROM taken)
SELECT doc_id, source, n_tokens, epoch::INT AS epoch, ({_digest_sql("'block'", "coalesce(doc_id::VARCHAR, '')", "name")} >> (52 - bits))::INT AS block, round((epoch + place / {PLACES}) / passes, 12) AS mix_order,
  exponent, round(weight, 9) AS weight, round(passes, 9) AS passes FROM placed
"""
