"""Candidate pairs of texts that lose no pair of a given sequence ratio, without comparing all.

A ratio of ``least`` bounds the lengths of both texts and the characters that
may be deleted from one or inserted from the other. Each of those spoils a
bounded number of a text's q-grams, so that among its rarest ones, one more than
can be spoilt, at least one stands in the other text's rarest ones as well
(prefix filter over bags of q-grams, in an order common to both sides). Pairs
are joined on those grams only. Two-letter grams serve texts in which some
must survive, single letters the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placekeep.session import checkpointed, spread


def _grams(text: str, q: int) -> Column:
    """The bag of q-grams: each with its number among equal ones."""
    plain = f"transform(sequence(1, length({text}) - {q - 1}), i -> substring({text}, i, {q}))"
    return F.expr(f"if(length({text}) >= {q}, transform({plain}, (x, i) -> concat(x, '\\u0001', size(filter(slice({plain}, 1, i), y -> y = x)))), array())")


def spoilt_sql(text: str, q: int, least: float) -> str:
    """The most grams of the text that a partner of at least that ratio can lack."""
    n = f"length({text})"
    low, high = f"cast(ceil({n} * {least} / (2 - {least}) - 1e-9) as int)", f"cast(floor({n} * (2 - {least}) / {least} + 1e-9) as int)"
    same = f"cast(ceil({least} * ({n} + m) / 2 - 1e-9) as int)"
    return f"array_max(transform(sequence({low}, greatest({low}, {high})), m -> {q} * ({n} - {same}) + {q - 1} * (m - {same})))"


def spoilt(text: str, q: int, least: float) -> Column:
    return F.expr(spoilt_sql(text, q, least))


def _prefixes(texts: DataFrame, q: int, least: float, order: DataFrame) -> DataFrame:
    """(form, part, indexed, gram): each text's rarest grams, one more than can be spoilt."""
    rows = texts.select("form", "part", "indexed", F.explode(_grams("form", q)).alias("gram"), (spoilt("form", q, least) + 1).alias("keep"))
    placed = rows.join(order, "gram").withColumn("n", F.row_number().over(Window.partitionBy("form", "part").orderBy("uses", "gram")))
    return placed.where("n <= keep").select("form", "part", "indexed", "gram")


def ratio_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct (part, a, b) that hold every pair of unequal texts whose sequence ratio is at least ``least``.

    Both sides have (form, part); only texts of one part meet. Equal texts are
    left to a join on the text. Nulls and empty texts have no partner.
    """

    def texts(df: DataFrame) -> DataFrame:
        some = df.select("form", "part").where("form <> '' AND part IS NOT NULL").distinct()
        return checkpointed(spread(some).withColumn("indexed", (F.length("form") - 1) > spoilt("form", 2, least)))

    a, b = texts(left), texts(right)
    found = None
    for q in (2, 1):
        order = checkpointed(a.unionByName(b).select(F.explode(_grams("form", q)).alias("gram")).groupBy("gram").agg(F.count("*").alias("uses")))
        x, y = (_prefixes(side.where("indexed") if q == 2 else side, q, least, order) for side in (a, b))
        x, y = x.withColumnsRenamed({"form": "a", "indexed": "ia"}), y.withColumnsRenamed({"form": "b", "indexed": "ib"})
        near = (F.least(F.length("a"), F.length("b")) * 2.0) / (F.length("a") + F.length("b")) >= least - 1e-9
        pairs = x.join(y, ["part", "gram"]).where(near & (F.col("a") != F.col("b")))
        pairs = (pairs if q == 2 else pairs.where("NOT (ia AND ib)")).select("part", "a", "b")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def containment_candidates(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Distinct (part, a, b): each text ``a`` of ``inner`` that stands within the longer text ``b`` of ``outer``.

    The rarest three letters of ``a`` (all of it, if shorter) stand in ``b`` as
    well; pairs are joined on them and then tested.
    """
    piece = lambda q: f"if(length(form) >= {q}, transform(sequence(1, length(form) - {q - 1}), i -> substring(form, i, {q})), array())"
    some = lambda df: df.select("form", "part").where("form <> '' AND part IS NOT NULL").distinct()
    whole = some(outer).select(F.col("form").alias("b"), "part", F.explode(F.expr(f"array_distinct(concat({piece(1)}, {piece(2)}, {piece(3)}))")).alias("gram"))
    uses = whole.groupBy("part", "gram").agg(F.count("*").alias("uses"))
    own = some(inner).select(F.col("form").alias("a"), "part", F.explode(F.expr(f"if(length(form) >= 3, array_distinct({piece(3)}), array(form))")).alias("gram"))
    # A gram of ``a`` that no longer text has rules all of them out.
    rarest = own.join(uses, ["part", "gram"], "left").groupBy("a", "part").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram")).alias("g"))
    keys = rarest.where("g.uses > 0").select("a", "part", F.col("g.gram").alias("gram"))
    return keys.join(whole, ["part", "gram"]).where((F.length("a") < F.length("b")) & F.contains("b", "a")).select("part", "a", "b").distinct()


def alike_candidates(left: DataFrame, right: DataFrame, least: float, contained: bool = True) -> DataFrame:
    """Distinct (part, a, b): equal texts, texts that contain one another, and those of :func:`ratio_candidates`."""
    some = lambda df, n: df.select(F.col("form").alias(n), "part", "form").where("form <> ''").distinct()
    out = some(left, "a").join(some(right, "b"), ["part", "form"]).select("part", "a", "b").unionByName(ratio_candidates(left, right, least))
    if contained:
        out = out.unionByName(containment_candidates(left, right)).unionByName(containment_candidates(right, left).select("part", F.col("b").alias("a"), F.col("a").alias("b")))
    return out.distinct()
