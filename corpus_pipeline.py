"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept. All but the last return the columns
of ``documents``, whatever further ones the table has; the last returns packed
pieces. Every stage takes an empty table and gives one. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placekeep.llm import langid, mixing, near_copies, packing, toxicity
from placekeep.llm.queries import tokenizer_files
from placekeep.session import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with one learned language for at least half of their letters.

    Null and empty texts and those without a letter go. Repeated rows share one
    fate; null ids are judged like others, and rows of null ``lang`` teach nothing.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic.

    Without labels of both classes all documents score that one class. Null and
    empty texts score the rate of toxic ones among such examples. Repeated rows
    share one fate; null ids are judged like others.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near duplicates: similarity 0.8 or more over shingles of five words.

    Rows that repeat that id leave one; rows with a null id stay. Texts without
    words are one component.
    """
    return near_copies.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, at most twice their tokens; every document stays at least once.

    Null sources are one source; null and empty texts have no tokens and one pass.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of each row into sequences; null and empty texts have the end id alone, null ids stay."""
    return packing.pack_documents(docs, *tokenizer_files())


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages need trained models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
