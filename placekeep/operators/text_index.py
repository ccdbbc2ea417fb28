"""Stored index for fuzzy search: the best texts for many questions, of which few are scored.

The index holds the distinct normal forms of the texts, their rows, and a
posting table of two-letter grams, longer pieces, and the forms short of one
letter. A search takes steps; each takes the questions for which those before
have not found k rows that no unseen text can reach. Questions meet the texts that
hold them, over their rarest piece; then the texts of one letter more or less,
which are found by equality; then, over their rarest grams, every text that can
score one of ``LEVELS`` or more (see :mod:`placekeep.operators.blocking` for why
none is missed). The last step takes them, in blocks, over all forms. In the last
two a text is only scored if upper bounds, of its letters and then of the longest
common subsequence, still reach the score that is asked for; in the last that is
the k-th best so far.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placekeep.functions import text as X
from placekeep.functions.similarity import PART_BASE, PART_MOST, PART_SHARE, WITHIN
from placekeep.operators.blocking import spoilt, spoilt_sql
from placekeep.session import checkpointed, ship_package

#: Texts of these scores or more are found by their grams, of the last one in any search.
LEVELS = (0.9, 0.8)
HIGH = LEVELS[-1]
#: Letters of a piece, and of the longest form that is stored short of one letter.
PIECE, LETTERS = 8, 64
#: Partitions of the posting table.
SLOTS = 64
#: Questions, and characters of them, that are taken together over all forms, on average.
BLOCK, CHARACTERS = 512, 1 << 20
#: Classes of letters in the first bound, and the widest question of the vectorised second one.
CLASSES, WORD = 64, 64
#: Cells of a padded table of texts.
CELLS = 1 << 22
_MARGIN = 1e-9


def contained_score(a: str, b: str) -> float | None:
    """The score of equal texts or of texts one of which holds the other, else None."""
    if a == b:
        return 1.0
    if a in b:
        return WITHIN
    return min(PART_MOST, PART_BASE + len(b) / len(a) * PART_SHARE) if b in a else None


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    rest = whole = (1 << len(a)) - 1
    for c in b:
        hit = rest & places.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & whole
    return len(a) - rest.bit_count()


def pair_score(a: str, b: str, least: float, count: list[int]) -> float | None:
    """The score of question ``a`` and text ``b``, or None below ``least``; ratios taken are counted."""
    score = contained_score(a, b)
    if score is None:
        total = (len(a) + len(b)) * (least - _MARGIN)
        if 2 * min(len(a), len(b)) < total or 2 * (Counter(a) & Counter(b)).total() < total or 2 * common(a, b) < total:
            return None
        count[0] += 1
        score = SequenceMatcher(None, a, b).ratio()
    return score if score >= least else None


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text begins (the end last)."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def letters(texts: list[str]) -> np.ndarray:
    """How often each class of letters stands in each text."""
    code, starts = code_points(texts)
    who = np.repeat(np.arange(len(texts)), np.diff(starts))
    return np.bincount(who * CLASSES + code % CLASSES, minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES).astype(np.int32)


def common_lengths(a: str, code: np.ndarray, starts: np.ndarray, some: np.ndarray) -> np.ndarray:
    """:func:`common` of ``a``, of at most ``WORD`` letters, with some of the texts."""
    out = np.zeros(len(some), np.int64)
    first, size = starts[some], starts[some + 1] - starts[some]
    known, at = np.unique(np.array([ord(c) for c in a], np.uint32), return_inverse=True)
    masks = np.zeros(len(known) + 1, np.uint64)
    np.bitwise_or.at(masks, at, np.uint64(1) << np.arange(len(a), dtype=np.uint64))
    rows = max(1, CELLS // max(1, int(size.max(initial=1))))
    for low in range(0, len(some), rows):
        own = slice(low, low + rows)
        place = np.arange(size[own].max(initial=0))
        cell = np.minimum(first[own, None] + place, max(0, len(code) - 1))
        near = np.minimum(np.searchsorted(known, code[cell]), len(known) - 1)
        hits = np.where((known[near] == code[cell]) & (place < size[own, None]), masks[near], np.uint64(0))
        rest = np.full(len(hits), ~np.uint64(0))
        for i in range(hits.shape[1]):
            hit = rest & hits[:, i]
            rest = (rest + hit) | (rest - hit)
        out[own] = np.bitwise_count(~rest & np.uint64((1 << len(a)) - 1))
    return out


class Scan:
    """Best texts of a block of questions, over the batches of one task."""

    def __init__(self, asked: list[str], k: int, least: float) -> None:
        self.asked, self.k = asked, k
        self.letters = letters(asked)
        self.least = np.full(len(asked), least)
        self.best: list[list[float]] = [[] for _ in asked]
        self.count = [0]

    def batch(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """(number of the question, of the text, score) of all that were among the k best, ties too, when they were seen."""
        own, (code, starts) = letters(texts), code_points(texts)
        size = np.diff(starts)
        for i, a in enumerate(self.asked):
            total = len(a) + size
            # Texts that are far too short or long can only hold the question or stand in it.
            shared = np.minimum(own, self.letters[i]).sum(1)
            inside = (shared == len(a)) | (shared == size)
            alike = 2 * shared >= total * (self.least[i] - _MARGIN)
            found: list[tuple[int, float]] = []
            for j in np.flatnonzero(inside).tolist():
                score = contained_score(a, texts[j])
                if score is not None:
                    alike[j] = False
                    if score >= self.least[i]:
                        found.append((j, score))
                        self.seen(i, score)
            some = np.flatnonzero(alike)
            if len(a) <= WORD:
                bound = 2 * common_lengths(a, code, starts, some) / total[some]
            else:
                bound = np.array([2 * common(a, texts[j]) / total[j] for j in some.tolist()])
            # The most promising first, so that the k-th best rises soon.
            for j, most in sorted(zip(some.tolist(), bound.tolist()), key=lambda x: (-x[1], x[0])):
                if most < self.least[i] - _MARGIN:
                    break
                self.count[0] += 1
                score = SequenceMatcher(None, a, texts[j]).ratio()
                if score >= self.least[i]:
                    found.append((j, score))
                    self.seen(i, score)
            yield from ((i, j, score) for j, score in found if score >= self.least[i])

    def seen(self, i: int, score: float) -> None:
        best = sorted([*self.best[i], score], reverse=True)[: self.k]
        self.best[i] = best
        if len(best) == self.k:
            self.least[i] = max(self.least[i], best[-1])


def _pieces(text: str, q: int = 2) -> Column:
    return F.expr(f"explode(if(length({text}) >= {q}, transform(sequence(1, length({text}) - {q - 1}), i -> substring({text}, i, {q})), array()))")


def _short_of_one(text: str) -> Column:
    """The text without one of its letters, for each."""
    return F.expr(f"explode(array_distinct(transform(sequence(1, length({text})), i -> concat(substring({text}, 1, i - 1), substring({text}, i + 1)))))")


def _form_id(form: Column) -> Column:
    return F.unhex(F.md5(form.cast("binary")))


class TextIndex:
    """Tables ``forms`` (id, form, size, rows), ``members`` (id, key columns), ``grams`` (slot, gram, id, size), ``pieces`` (piece, id) and ``shorter`` (shorter, id) in one folder.

    Rows whose texts are all null or without a letter or digit aren't in the index.
    Equal forms are one form, whatever the number of their rows; rows of equal
    keys are one row.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], fields: int) -> None:
        self.spark, self.keys, self.fields = spark, keys, fields
        self.forms, self.members, self.pieces, self.shorter = (spark.read.parquet(f"{folder}/{t}") for t in ("forms", "members", "pieces", "shorter"))
        # An empty table of partitions has no files to take the columns from.
        self.grams = spark.read.schema("id binary, size int, gram string, slot int").parquet(f"{folder}/grams")

    @classmethod
    def build(cls, rows: DataFrame, keys: list[str], fields: list[Column], folder: str) -> TextIndex:
        """Index ``rows`` by the normal forms of ``fields``; the folder must be new."""
        spark = rows.sparkSession
        own = rows.select(*[F.col(f"`{k}`") for k in keys], F.explode(F.array_distinct(F.array(*[X.normal(F.coalesce(f, F.lit(""))) for f in fields]))).alias("_form")).where("_form <> ''")
        own = own.withColumn("_id", _form_id(F.col("_form"))).distinct()
        own.drop("_form").write.parquet(f"{folder}/members")
        own.groupBy(F.col("_id").alias("id"), F.col("_form").alias("form")).agg(F.count("*").alias("rows")).withColumn("size", F.length("form")).write.parquet(f"{folder}/forms")
        forms = spark.read.parquet(f"{folder}/forms")
        forms.select("id", _pieces("form", PIECE).alias("piece")).select("id", F.xxhash64("piece").alias("piece")).distinct().write.parquet(f"{folder}/pieces")
        forms.where(F.col("size") <= LETTERS).select("id", _short_of_one("form").alias("shorter")).select("id", F.xxhash64("shorter").alias("shorter")).write.parquet(f"{folder}/shorter")
        grams = forms.select("id", "size", _pieces("form").alias("gram")).distinct()
        # By ranges, so that the postings of a frequent gram are several tasks and files.
        grams = grams.withColumn("slot", F.pmod(F.xxhash64("gram"), F.lit(SLOTS)).cast("int")).repartitionByRange("slot", "gram", "id")
        grams.sortWithinPartitions("slot", "gram", "id").write.partitionBy("slot").parquet(f"{folder}/grams")
        return cls(spark, folder, keys, len(fields))

    def search(self, questions: DataFrame, k: int, least: float, id_col: str = "question_id", text_col: str = "question", scored: Accumulator | None = None, holding_first: bool = False) -> DataFrame:
        """(``id_col``, key columns, score): for each question the k best rows of a score of ``least`` or more, and all that tie with the k-th.

        With ``holding_first`` rows with a text that holds the question come before all that are only alike, as in the tiers of a search.

        A row's score is the best of its fields. The caller's own order decides among ties.
        Questions that are null or without a letter or digit find nothing; a repeated question finds its rows repeatedly.
        ``scored`` counts the ratios that were taken.
        """
        ship_package(self.spark)
        # Fewer than k rows have no more pairs of row and form than this, and k rows no more forms.
        few, most = (k - 1) * self.fields, k * self.fields
        asked = checkpointed(questions.select(F.col(f"`{id_col}`"), X.normal(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_ask")).where("_ask <> ''"))
        asks = asked.select(F.col("_ask").alias("ask")).distinct()
        sizes = self.forms.select("id", "rows")

        def open_(rest: DataFrame, found: DataFrame, sure: Column) -> DataFrame:
            """The questions without k rows in ``found`` of which it is sure that no unseen text scores as much."""
            enough = found.where(sure).join(sizes, "id").groupBy("ask").agg(F.sum("rows").alias("n")).where(F.col("n") > few).select("ask")
            return checkpointed(rest.join(enough, "ask", "left_anti"))

        found = checkpointed(self._holding(asks))
        rest = open_(asks, found, F.lit(True) if holding_first else F.col("score") == 1.0)
        if not rest.isEmpty():
            near = checkpointed(self._one_letter(rest, least, scored))
            found = found.unionByName(near)
            # A text of two letters more or fewer, or one exchanged, has a ratio of n / (n + 1) at most; one within the question has PART_MOST.
            n = F.length("ask")
            rest = open_(rest, found.dropDuplicates(["ask", "id"]), (F.col("score") > F.greatest(n / (n + 1.0), F.lit(PART_MOST)) + _MARGIN) & n.between(2, LETTERS - 1))
        for level in dict.fromkeys(max(x, least) for x in LEVELS):
            if not rest.isEmpty():
                near = checkpointed(self._by_grams(rest, level, scored))
                found = found.unionByName(near)
                rest = open_(rest, found.dropDuplicates(["ask", "id"]), (F.col("score") >= level) & F.expr(_by_grams_whole(level)))
        if least >= HIGH:
            rest = checkpointed(rest.where(f"NOT ({_by_grams_whole(least)})"))
        blocks = self._blocks(rest)
        for b in range(blocks):
            found = found.unionByName(self._scan(rest, b, blocks, most, least, scored))
        found = found.where(F.col("score") >= least).dropDuplicates(["ask", "id"])
        if holding_first:
            found = found.join(self.forms.select("id", "form"), "id").select("ask", "id", F.struct(F.contains("form", "ask").alias("held"), "score").alias("score"))
        best = found.withColumn("_rank", F.rank().over(Window.partitionBy("ask").orderBy(F.desc("score")))).where(F.col("_rank") <= most).select("ask", "id", "score")
        rows = self.members.withColumnRenamed("_id", "id").join(best, "id").drop("id")
        rows = rows.groupBy("ask", *[f"`{c}`" for c in self.keys]).agg(F.max("score").alias("score"))
        rows = rows.withColumn("_rank", F.rank().over(Window.partitionBy("ask").orderBy(F.desc("score")))).where(F.col("_rank") <= k).drop("_rank")
        if holding_first:
            rows = rows.withColumn("score", F.col("score.score"))
        return asked.join(rows, asked["_ask"] == rows["ask"]).drop("_ask", "ask")

    def _holding(self, asks: DataFrame) -> DataFrame:
        """(ask, id, score): all texts that hold the question or are it, for questions of two letters or more."""
        hits = None
        for long in (True, False):
            some = asks.where(F.length("ask") >= PIECE) if long else asks.where(F.length("ask").between(2, PIECE - 1))
            lists = self.pieces if long else self.grams.select("id", F.xxhash64("gram").alias("piece"))
            own = checkpointed(some.select("ask", _pieces("ask", PIECE if long else 2).alias("piece")).select("ask", F.xxhash64("piece").alias("piece")).distinct())
            uses = lists.join(own.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("uses"))
            # A piece that no text has rules all of them out.
            rarest = own.join(uses, "piece", "left").groupBy("ask").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "piece")).alias("p")).where("p.uses > 0").select("ask", F.col("p.piece").alias("piece"))
            part = rarest.join(lists, "piece").select("ask", "id").join(self.forms.select("id", "form"), "id").where(F.contains("form", "ask"))
            hits = part if hits is None else hits.unionByName(part)
        return hits.select("ask", "id", F.when(F.col("form") == F.col("ask"), 1.0).otherwise(WITHIN).alias("score"))

    def _one_letter(self, asks: DataFrame, least: float, scored: Accumulator | None) -> DataFrame:
        """(ask, id, score): all texts of at least that score that have one letter more or fewer than the question, for questions of fewer than ``LETTERS``."""
        some = asks.where(F.length("ask") < LETTERS)
        more = some.withColumn("shorter", F.xxhash64("ask")).join(self.shorter, "shorter").select("ask", "id")
        fewer = some.select("ask", _short_of_one("ask").alias("shorter")).select("ask", _form_id(F.col("shorter")).alias("id"))
        return self._scored(more.unionByName(fewer).distinct(), least, scored)

    def _scored(self, pairs: DataFrame, least: float, scored: Accumulator | None) -> DataFrame:
        """(ask, id, score) of the pairs (ask, id) of at least that score."""
        pairs = pairs.join(self.forms.select("id", "form"), "id").select("ask", "id", "form")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = [0]
            for batch in batches:
                scores = pa.array([pair_score(a, b, least, count) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())], pa.float64())
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["ask", "id", "score"])
                yield out.filter(scores.is_valid())
            if scored is not None:
                scored.add(count[0])

        return pairs.mapInArrow(score, "ask string, id binary, score double")

    def _by_grams(self, asks: DataFrame, least: float, scored: Accumulator | None) -> DataFrame:
        """(ask, id, score): all texts of at least that score, for questions that are long enough; those that only hold the question needn't be among them."""
        some = asks.where(_by_grams_whole(least)).select("ask", F.length("ask").alias("length"), spoilt("ask", 2, least).alias("spoilt"))
        pieces = some.select("ask", "length", "spoilt", _pieces("ask").alias("gram")).groupBy("ask", "length", "spoilt", "gram").agg(F.count("*").alias("n"))
        pieces = checkpointed(pieces.withColumn("slot", F.pmod(F.xxhash64("gram"), F.lit(SLOTS)).cast("int")))
        slots = [r.slot for r in pieces.select("slot").distinct().collect()]  # SLOTS at most
        lists = self.grams.where(F.col("slot").isin(slots)) if slots else self.grams.limit(0)
        uses = lists.join(pieces.select("slot", "gram").distinct(), ["slot", "gram"], "left_semi").groupBy("gram").agg(F.count("*").alias("uses"))
        # The rarest grams until one occurrence more than can be spoilt.
        before = Window.partitionBy("ask").orderBy("uses", "gram").rowsBetween(Window.unboundedPreceding, -1)
        rare = pieces.join(uses, "gram", "left").withColumn("uses", F.coalesce("uses", F.lit(0))).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        keys = rare.where("before <= spoilt").select("slot", "gram", "ask", "length")
        near = F.least("length", "size") * 2.0 / (F.col("length") + F.col("size")) >= least - _MARGIN
        pairs = keys.join(lists, ["slot", "gram"]).where(near).select("ask", "id").distinct()
        return self._scored(pairs, least, scored)

    def _blocks(self, asks: DataFrame) -> int:
        row = asks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("ask")), F.lit(0)).alias("size")).first()
        return max(-(-row.n // BLOCK), -(-row.size // CHARACTERS))

    def _scan(self, asks: DataFrame, b: int, blocks: int, k: int, least: float, scored: Accumulator | None) -> DataFrame:
        """(ask, id, score): the k best texts of one block of questions, ties too, from each task."""
        own = sorted(r.ask for r in asks.where(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == b).collect())  # about BLOCK questions
        shared = self.spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = Scan(shared.value, k, least)
            for batch in batches:
                hits = list(scan.batch(batch.column(1).to_pylist()))
                rows = pa.array([j for _, j, _ in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([scan.asked[i] for i, _, _ in hits], pa.string()), batch.column(0).take(rows), pa.array([s for _, _, s in hits], pa.float64())], ["ask", "id", "score"])
            if scored is not None:
                scored.add(scan.count[0])

        return self.forms.select("id", "form").mapInArrow(run, "ask string, id binary, score double")


def _by_grams_whole(least: float) -> str:
    """Whether some gram of a question survives in every text of that score."""
    return f"(length(ask) >= 2 AND length(ask) - 1 > {spoilt_sql('ask', 2, max(least, HIGH))})"
