"""Packing token sequences by shortest-pack-first over the length histogram.

Each document's ids are cut into pieces of the sequence length and one
remainder. Only the histogram of piece lengths (at most ``capacity`` bins)
reaches the driver, where packing patterns and their counts are found. Patterns
come back to the pieces by the pieces' rank within their length: the ranks of a
length are divided into intervals, one for each pattern that holds the length.
Ranks need no global sort and no task per length: pieces are numbered within
(length, salt), and the counts of those small groups give their first ranks.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placekeep.llm.common import map_rows, worker_state
from placekeep.session import checkpointed

CAPACITY = 1024
#: Id put after each document.
END = 0
#: Pieces in a (length, salt) group, at most on average.
GROUP = 50_000

#: Code points outside these ranges always go to the tokenizers library: the two
#: libraries' Unicode tables may be of different age.
_OTHER = re.compile("[^\\u0000-\\u052F\\u2000-\\u206F\\u20A0-\\u20BF]")


class Encoder:
    """Ids of a byte-level BPE file by the tokenizers library, without the special ones it could add at the ends.

    ``ranks_path`` may name the same vocabulary as tiktoken ranks; it is then
    used for texts where both give the same ids, several times faster. Texts
    that hold the file's special marks, whose strings have ids of their own,
    never are among them.
    """

    def __init__(self, path: str, ranks_path: str | None) -> None:
        self.path, self.own, self.fast = path, None, None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(path, encoding="utf-8") as f:
                marks = [x["content"] for x in json.load(f).get("added_tokens", [])]
            self.other = re.compile("|".join([_OTHER.pattern, *map(re.escape, marks)]))
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> np.ndarray:
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or self.other.search(text):
            return self.slow(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:
            # The library's native part panics on some very long runs of one class of characters.
            if type(e).__name__ != "PanicException":
                raise
            return self.slow(text)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how often each is used.

    Lengths are placed longest first, each into the pack with the most space
    left; whole counts move at once, so work follows the number of distinct
    lengths and patterns, not of pieces.
    """
    room: dict[int, dict[tuple[int, ...], int]] = {}
    most = 0

    def add(pack: tuple[int, ...], count: int) -> None:
        nonlocal most
        left = capacity - sum(pack)
        own = room.setdefault(left, {})
        own[pack] = own.get(pack, 0) + count
        most = max(most, left)

    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        todo = histogram[length]
        while todo:
            while most and not room.get(most):
                room.pop(most, None)
                most -= 1
            if most < length:
                add((length,), todo)
                break
            pack, count = room[most].popitem()
            used = min(count, todo)
            if used < count:
                room[most][pack] = count - used
            add((*pack, length), used)
            todo -= used
    return sorted(((p, c) for own in room.values() for p, c in own.items()), reverse=True)


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, intervals of ranks with their pattern's first sequence, offset and multiplicity."""
    rows, first, used = [], 0, {}
    for pack, count in patterns:
        at = 0
        for length in sorted(set(pack), reverse=True):
            times = pack.count(length)
            rank = used.get(length, 0)
            rows.append((length, rank, first, at, times))
            used[length] = rank + count * times
            at += length * times
        first += count
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (cols[:, 0] << 44) + cols[:, 1], "rank": cols[:, 1], "first": cols[:, 2], "offset": cols[:, 3], "times": cols[:, 4]}


def token_pieces(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids, with their checksum; one pass over the texts."""

    def run(batch: pa.RecordBatch) -> list:
        encode = worker_state(("encoder", path, ranks_path), lambda: Encoder(path, ranks_path))
        source, start, length, crc, total, mix = [], [], [], [], [], []
        ids = batch.column(0)
        for i, text in enumerate(batch.column(1)):
            tokens = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
            name = str(ids[i].as_py())
            for a in range(0, len(tokens), capacity):
                piece = tokens[a : a + capacity]
                source.append(i)
                start.append(a)
                length.append(len(piece))
                crc.append(zlib.crc32(piece.tobytes()))
                total.append(len(tokens))
                mix.append(xxhash.xxh64_intdigest(f"{name}:{a}") >> 2)
        return [ids.take(pa.array(source, pa.int64())), start, length, crc, total, mix]

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, mix long")


def pack_documents(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``start`` counts the document's ids before the piece, ``offset`` those
    before it in its sequence. Null and empty texts have the end id alone.
    Repeated rows are packed once each; null ids are kept. An empty table gives
    no rows. Ids are those of the tokenizer's file ``path``; special marks in a
    text have their own. A text of any length is encoded whole, so that a worker
    holds one text's ids (four bytes each) besides the batch. Other columns are
    ignored.
    """
    pieces = checkpointed(token_pieces(docs, path, ranks_path, capacity, id_col, text_col))
    salts = max(32, -(-pieces.count() // GROUP))
    salted = pieces.withColumn("salt", F.col("mix") % salts)
    counts = checkpointed(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(shortest_pack_first(histogram, capacity))
    bases = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("mix", id_col, "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("place", F.row_number().over(within) - 1).join(bases, ["length", "salt"])
    ranked = ranked.select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("place") + F.col("base")).alias("rank"))

    def run(batch: pa.RecordBatch) -> list:
        length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
        at = np.searchsorted(slots["key"], (length << 44) + rank, "right") - 1
        inner = rank - slots["rank"][at]
        times = slots["times"][at]
        return [*batch.columns[:5], pa.array(slots["first"][at] + inner // times), pa.array(slots["offset"][at] + inner % times * length)]

    kind = dict(docs.dtypes)[id_col]
    return map_rows(ranked, run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
