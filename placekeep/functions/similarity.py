"""Similarity scores as Column expressions.

All sequence ratios are difflib's (twice the matching characters by the total
length, in argument order), evaluated in Arrow batches; rules that decide
without the ratio give it nulls, which it skips.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from placekeep.functions import text as X
from placekeep.session import ship_package

#: Fixed values of the search score: the query stands within the text; the text within the query.
WITHIN, PART_MOST, PART_BASE, PART_SHARE = 0.95, 0.9, 0.55, 0.35


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)
    return _ratio(a, b)


def ratio_if(condition: Column, a: Column, b: Column) -> Column:
    """The ratio where ``condition`` holds; other rows cost nothing in Python."""
    return sequence_ratio(F.when(condition, a), F.when(condition, b))


def laddered(a: Column, b: Column, containment: Column) -> Column:
    """0 if either is empty, 1 if equal, ``containment`` if one holds the other, else the ratio."""
    empty, equal = (a == "") | (b == ""), a == b
    inside = F.contains(b, a) | F.contains(a, b)
    return F.when(empty, 0.0).when(equal, 1.0).when(inside, containment).otherwise(ratio_if(~empty & ~equal & ~inside, a, b))


def search_score(needle: Column, candidate: Column) -> Column:
    """Score of the fuzzy search tiers."""
    a, b = X.normal(needle), X.normal(candidate)
    share = F.length(b).cast("double") / F.greatest(F.length(a), F.lit(1))
    inside = F.least(F.lit(PART_MOST), F.lit(PART_BASE) + share * PART_SHARE)
    return laddered(a, b, F.when(F.contains(b, a), WITHIN).otherwise(inside))


def place_similarity(a: Column, b: Column) -> Column:
    return laddered(X.match_form(a), X.match_form(b), F.lit(0.92))


def item_similarity(a: Column, b: Column) -> Column:
    return laddered(X.import_name(a), X.import_name(b), F.lit(0.9))


def title_similarity(a: Column, b: Column) -> Column:
    """Ratio of normalised titles; 0 if either is empty."""
    x, y = X.title_text(a), X.title_text(b)
    empty = (x == "") | (y == "")
    return F.when(empty, 0.0).when(x == y, 1.0).otherwise(ratio_if(~empty & (x != y), x, y))


def loose_similarity(a: Column, b: Column) -> Column:
    x, y = X.title_text(X.loose_title(a)), X.title_text(X.loose_title(b))
    empty = (x == "") | (y == "")
    return F.when(empty, 0.0).when(x == y, 1.0).otherwise(ratio_if(~empty & (x != y), x, y))


def place_match_score(df: DataFrame) -> DataFrame:
    """Adds ``confidence``, the agreement of source places (columns a_*) with known ones (b_*): name, street_address, city, postal_code.

    Normal forms that the columns a_*_form and b_*_form already hold are used.
    """

    def present(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    for c in ("name", "street_address", "city"):
        # Columns of their own keep the score's expression small.
        form = lambda p: F.col(f"{p}_{c}_form") if f"{p}_{c}_form" in df.columns else X.match_form(F.col(f"{p}_{c}"))  # noqa: B023, E731
        df = df.withColumn(f"_l_{c}", form("a")).withColumn(f"_r_{c}", form("b"))
        df = df.withColumn(f"_{c}", laddered(F.col(f"_l_{c}"), F.col(f"_r_{c}"), F.lit(0.92)))
    n, s, c = F.col("_name"), F.col("_street_address"), F.col("_city")
    both_zip = present("a_postal_code") & present("b_postal_code")
    z = F.when(both_zip & (F.col("a_postal_code") == F.col("b_postal_code")), 1.0).otherwise(0.0)
    total = n * 0.4 + s * 0.25 + c * 0.25 + z * 0.1
    strong = (n >= 0.88) & (c >= 0.9)
    less = F.when(both_zip & (z == 0.0), 0.15).otherwise(0.0) + F.when(present("a_street_address") & present("b_street_address") & (s < 0.45), 0.15).otherwise(0.0)
    score = (
        F.when((c < 0.75) & ~((s >= 0.85) & (z == 1.0)), 0.0)
        .when(strong & ((s >= 0.8) | (z == 1.0)), total)
        .when(strong & ~present("b_street_address") & ~present("b_postal_code"), 0.82)
        .otherwise(F.greatest(F.lit(0.0), total - less))
    )
    made = [f"_{p}{c}" for c in ("name", "street_address", "city") for p in ("l_", "r_", "")]
    return df.withColumn("confidence", score).drop(*made)


def item_score(likeness: Column, maker: Column, known_maker: Column) -> Column:
    """Score of items from the likeness of their names and their makers' normal forms."""
    known = (maker != "") & (known_maker != "")
    m = F.when(known & (maker == known_maker), 1.0).when(known, 0.0).otherwise(0.5)
    return F.greatest(F.lit(0.0), likeness * 0.82 + m * 0.18 - F.when(m == 0.0, 0.12).otherwise(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words by the smaller word set, for texts of words joined by spaces."""
    x, y = F.array_distinct(F.filter(F.split(a, " "), lambda w: w != "")), F.array_distinct(F.filter(F.split(b, " "), lambda w: w != ""))
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.filter(F.split(a, " "), lambda w: w != ""), F.filter(F.split(b, " "), lambda w: w != "")
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)
