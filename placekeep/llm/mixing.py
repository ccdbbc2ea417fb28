"""Mixing sources by temperature.

Source token shares are raised to an exponent between 0 (all alike) and 1 (as
they are). The exponent is found by bisection, either for a target entropy of
the weights or for a limit on how often the tokens of any source may repeat.
The weights are realised with whole documents under a token budget: each source
is dealt into blocks by a hash, each pass has a permutation of the blocks of its
own, whole passes come first, and the last pass ends where the source's share of
the budget does. That end is a place in the last pass's order for each source,
so choosing documents needs no sort, and no task holds a source: blocks stay
small, and repeated rows are added up before they meet.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placekeep.session import checkpointed

#: Documents in a block, about.
BLOCK_DOCS = 4_096
#: Most passes over any source's tokens.
REPEATS = 2.0
#: Exponents that one step of the bisection tries, and steps.
TRIED, STEPS = 31, 6
#: Source rows that are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


class Target(NamedTuple):
    """One of the two is set: entropy in nats, or passes over any source."""

    entropy: float | None = None
    repeats: float | None = REPEATS


def word_tokens(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def _order(parts: list[Column], seed: int) -> Column:
    return F.xxhash64(*parts, F.lit(seed))


def solve_exponent(sources: DataFrame, target: Target) -> float:
    """The largest exponent that meets the target, or 0 if none does.

    Each step tests evenly spaced exponents in one aggregation over the
    sources, which stay distributed, and keeps the interval where the answer
    changes (a bisection into TRIED + 1 parts).
    """
    t = F.col("tokens").cast("double")
    positive = sources.where("tokens > 0")
    ends = positive.agg(F.min("tokens"), F.max("tokens")).first()
    if not ends[0]:
        return 1.0
    low, high = 0.0, 1.0

    def met(exponents: list[float]) -> list[bool]:
        if target.entropy is None:
            return [(ends[1] / ends[0]) ** (1 - a) <= target.repeats for a in exponents]
        sums = [f for a in exponents for f in (F.sum(t**a), F.sum(t**a * a * F.log(t)))]
        row = positive.agg(*sums).first()
        return [math.log(z) - s / z >= target.entropy for z, s in zip(row[::2], row[1::2])]

    # Entropy falls with the exponent; passes over the smallest source do as well.
    rising = target.entropy is None
    if met([1.0])[0]:
        return 1.0 if not rising else _least(met)
    if not rising and not met([0.0])[0]:
        return 0.0
    for _ in range(STEPS):
        tried = [low + (high - low) * (i + 1) / (TRIED + 1) for i in range(TRIED)]
        good = [a for a, ok in zip(tried, met(tried)) if ok]
        bad = [a for a, ok in zip(tried, met(tried)) if not ok]
        low, high = (max(good, default=low), min(bad, default=high)) if not rising else (max(bad, default=low), min(good, default=high))
    return low if not rising else high


def _least(met) -> float:
    low, high = 0.0, 1.0
    if met([0.0])[0]:
        return 0.0
    for _ in range(STEPS * 5):
        middle = (low + high) / 2
        low, high = (low, middle) if met([middle])[0] else (middle, high)
    return high


def plan(docs: DataFrame, target: Target = Target(), budget: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> tuple[DataFrame, float]:
    """One row per source, and the exponent.

    Columns: source_key, tokens, docs, weight, quota, passes (whole ones),
    blocks, cut_turn, cut_block, cut_place (where the last pass ends; null if it
    has no document). Without ``budget`` it is the least at which every source has one
    whole pass. Sources without tokens get weight 0 and one pass.
    """
    base = docs.select(_source_key(F.col(source_col)).alias("source_key"), word_tokens(F.col(text_col)).alias("tokens"), _order([F.col(id_col), F.col(text_col)], seed).alias("place"))
    base = checkpointed(base)
    sources = checkpointed(base.groupBy("source_key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    exponent = solve_exponent(sources, target)
    power = F.when(F.col("tokens") > 0, F.col("tokens").cast("double") ** exponent).otherwise(0.0)
    total = sources.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.withColumn("weight", power / total)
    if budget is None:
        least = weighted.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
        budget = math.ceil(least or 0)
    # A whole pass must not be lost to rounding of the weights.
    share = F.col("weight") * float(budget)
    near = F.when(F.abs(share - F.round(share)) < 1e-6 * (1 + share), F.round(share)).otherwise(share)
    quota = F.floor(near + 1e-9).cast("long")
    sized = weighted.withColumn("quota", F.when(F.col("tokens") > 0, quota).otherwise(0)).withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("long"))
    sized = sized.withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(0)).withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS).cast("long"))
    sized = checkpointed(sized)
    small = F.broadcast(sized) if sized.count() <= BROADCAST_SOURCES else sized
    # Rows of one hash are taken or left together: they are one row from here on.
    alike = base.groupBy("source_key", "place").agg(F.sum("tokens").alias("tokens"))
    placed = alike.join(small.select("source_key", "blocks", "passes", "rest"), "source_key").withColumn("block", block_of(F.col("place"), F.col("blocks")))
    sums = placed.groupBy("source_key", "block").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    sums = sums.withColumn("turn", turn_of(F.col("block"), F.col("passes"), seed))
    ends = sums.withColumn("end", F.sum("sum").over(Window.partitionBy("source_key").orderBy("turn", "block")))
    first_over = F.min(F.struct("turn", "block", (F.col("end") - F.col("sum")).alias("before")))
    cut = checkpointed(ends.where("end > rest").groupBy("source_key").agg(first_over.alias("c")).select("source_key", F.col("c.turn").alias("cut_turn"), F.col("c.block").alias("cut_block"), F.col("c.before").alias("before")))
    cut_small = F.broadcast(cut) if cut.count() <= BROADCAST_SOURCES else cut
    inside = placed.join(cut_small, "source_key").where("block = cut_block")
    inside = inside.withColumn("until", F.col("before") + F.sum("tokens").over(Window.partitionBy("source_key").orderBy("place")))
    places = inside.where("until <= rest").groupBy("source_key").agg(F.max("place").alias("cut_place"))
    cuts = cut.select("source_key", "cut_turn", "cut_block")
    return checkpointed(sized.join(cuts, "source_key", "left").join(places, "source_key", "left")), exponent


def block_of(place: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(place, 32), blocks)


def turn_of(block: Column, number: Column, seed: int) -> Column:
    """The block's place in the permutation of pass ``number``; blocks of equal turn follow their own number."""
    return F.xxhash64(block, number, F.lit(seed))


def realise(docs: DataFrame, sources: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """Rows of ``docs`` as ``row`` (a struct of all columns), with weight, pass, turn, block and place; each once for each pass that holds it."""
    plan_columns = ("source_key", "weight", "passes", "blocks", "cut_turn", "cut_block", "cut_place")
    known = sources.select(*plan_columns)
    known = F.broadcast(known) if known.count() <= BROADCAST_SOURCES else known
    # The table's own columns stay inside the struct, so that no name of theirs meets one of the plan's.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, _source_key(F.col(source_col)).alias("source_key"), _order([F.col(id_col), F.col(text_col)], seed).alias("place"))
    joined = own.join(known, "source_key").withColumn("block", block_of(F.col("place"), F.col("blocks")))
    turn = turn_of(F.col("block"), F.col("passes"), seed)
    at, end = F.struct(turn.alias("t"), F.col("block").alias("b")), F.struct(F.col("cut_turn").alias("t"), F.col("cut_block").alias("b"))
    last = F.col("cut_turn").isNotNull() & ((at < end) | ((at == end) & (F.col("place") <= F.col("cut_place"))))
    copies = F.col("passes") + F.coalesce(last, F.lit(False)).cast("long")
    repeated = joined.withColumn("copies", copies).where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return repeated.select("row", "weight", "pass", turn_of(F.col("block"), F.col("pass"), seed).alias("turn"), "block", "place")


def mix(docs: DataFrame, target: Target = Target(), budget: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``id_col``, source, n_tokens, weight, pass, turn, block, place: the mixture's rows.

    Reading a source in order of pass, turn, block and place gives its block
    permutations, one for each pass. Null sources are one source of their own;
    null texts have no tokens; documents without tokens cost nothing; repeated
    rows are taken or left together. An empty table gives no rows. Other
    columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sources, _ = plan(own, target, budget, "id", "source", "text")
    rows = realise(own, sources, "id", "source", "text")
    return rows.select(F.col("row.id").alias(id_col), F.col("row.source").alias("source"), word_tokens(F.col("row.text")).alias("n_tokens"), "weight", "pass", "turn", "block", "place")


def mixed_documents(docs: DataFrame, target: Target = Target(), budget: int | None = None) -> DataFrame:
    """The mixture as rows of ``docs``, with its columns, whatever their names.

    Nulls, ties, repeated rows and empty tables as in :func:`mix`.
    """
    sources, _ = plan(docs, target, budget)
    return realise(docs, sources).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
