"""Near-duplicates by MinHash, with sequential Bayesian verification and exact confirmation.

Each text's set of shingles has ``BANDS`` band keys and, from other hash
functions, a signature of ``VALUES`` bytes. Copies with equal sets are one node.
Nodes that share a band key are candidates. A pair is looked at in batches of
its signatures: with m of n values equal and every similarity equally likely
before, it is dropped as soon as the probability of the wanted similarity falls
below ``MISS``. What survives is confirmed on the full sets.

Pairs come in two steps, so that a bucket's pairs never become rows:

1. Stars. Each member of a bucket meets its smallest node only. Links of this
   step make first components.
2. The rest. Nodes that have too many shingles of their own to reach the
   similarity with any other candidate are left out, which loses no link. In
   buckets that still hold several components, nodes of different ones are
   compared: as rows in buckets of ``SMALL`` nodes or fewer, in tiles in larger ones,
   which are cut into blocks, where each two blocks meet in a task of their own.

A pair of the wanted similarity shares no band with probability (1 - s^ROWS)^BANDS,
below 1e-10 at 0.85.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekeep.llm.common import map_rows
from placekeep.llm.simhash import BROADCAST_IDS, components, packed
from placekeep.session import checkpointed, ship_package

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 85
#: Band keys and the values in each.
BANDS, ROWS = 50, 6
#: Values of a signature, a byte each, and those compared at once.
VALUES, BATCH = 128, 16
#: Probability of being similar enough below which a pair is dropped.
MISS = 1e-6
#: Nodes of a bucket whose pairs may be rows, at most.
SMALL = 32
#: Nodes of a block of a tile, at most, and the shingles of all its nodes, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22

_RNG = np.random.default_rng(20240607)
_FLIPS, _FACTORS = (_RNG.integers(0, 1 << 32, BANDS * ROWS + VALUES, dtype=np.uint64).astype(np.uint32) for _ in range(2))
_FACTORS |= np.uint32(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles; of the whole sequence if there are fewer words, none without words."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    h = xxhash.xxh3_64_intdigest
    if n <= length:
        return np.array([h(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    del words
    out = []
    # Parts of a very long text, so that only its hashes are held whole.
    for at in range(0, n - length + 1, 65536):
        stops = (ends[length - 1 + at : length - 1 + at + 65536] - 1).tolist()
        starts = (ends[at - 1 : at - 1 + len(stops)] if at else np.append(0, ends[: len(stops) - 1])).tolist()
        out.append(np.fromiter((h(line[i:j]) for i, j in zip(starts, stops, strict=True)), np.uint64, len(stops)))
    return np.unique(np.concatenate(out))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        some = low[at : at + 512]
        np.minimum(least, ((some[None, :] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band, as signed integers; the band is part of its key."""
    rows = least[..., : BANDS * ROWS].reshape(*least.shape[:-1], BANDS, ROWS).astype(np.uint64)
    key = ((rows + np.uint64(1)) * _MIX).sum(-1, dtype=np.uint64)
    key ^= key >> np.uint64(31)
    return (key * _MIX[:, 0]).view(np.int64)


def fewest_equal(percent: int, miss: float = MISS, values: int = VALUES, batch: int = BATCH) -> list[int]:
    """For each batch, the fewest equal values so far with which a pair stays.

    A byte is equal with probability s + (1 - s) / 256. With a uniform prior,
    the probability of t or more after m of n equal values is that of at most m
    hits in n + 1 tries at t.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(batch, values + 1, batch):
        total, m = 0.0, -1
        while m < n and total < miss:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
        out.append(m)
    return out


def plausible(a: np.ndarray, b: np.ndarray, fewest: list[int], batch: int = BATCH) -> np.ndarray:
    """Which pairs of rows of signatures stay when their batches are compared one after the other."""
    left = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    for k, least in enumerate(fewest):
        part = slice(k * batch, (k + 1) * batch)
        equal[left] += (a[left, part] == b[left, part]).sum(1)
        left = left[equal[left] >= least]
    return left


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets reach the similarity."""
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = both - len(np.union1d(a, b))
    return 100 * shared >= percent * (both - shared)


NODE = "digest binary, n long, keys array<long>, signature binary"


def _kind(df: DataFrame, c: str) -> str:
    return dict(df.dtypes)[c]


def with_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n, keys, signature) for each row; equal digests are equal sets. Nothing but n = 0 without words."""

    def run(batch: pa.RecordBatch) -> list:
        digests, sizes, least = [], [], []
        for text in batch.column(1):
            hashes = shingle_hashes(text.as_py())
            sizes.append(len(hashes))
            digests.append(set_digest(hashes) if len(hashes) else None)
            if len(hashes):
                least.append(minima(hashes))
        least = np.array(least, np.uint32).reshape(-1, len(_FACTORS))
        keys = iter(band_keys(least))
        marks = iter(least[:, BANDS * ROWS :].astype(np.uint8))
        some = [d is not None for d in digests]
        return [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array([next(keys) if s else None for s in some], pa.list_(pa.int64())), pa.array([next(marks).tobytes() if s else None for s in some], pa.binary())]

    return map_rows(docs.select(F.col(id_col).alias("id"), text_col), run, f"id {_kind(docs, id_col)}, {NODE}")


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, hashed: Callable[[str | None], np.ndarray] = shingle_hashes) -> DataFrame:
    """(node, digest, n, shingles) of the texts of the wanted nodes, by ``hashed``; a checkpoint."""
    few = wanted.count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(wanted) if few else wanted, docs[id_col] == wanted["node"], "left_semi").select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> list:
        sets = [hashed(t.as_py()) for t in batch.column(1)]
        return [batch.column(0), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]

    rows = map_rows(found, run, f"node {_kind(docs, id_col)}, digest binary, n long, shingles binary")
    return checkpointed(rows.where("n > 0").dropDuplicates(["node", "digest"]))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the similarity."""
    side = lambda p: sets.select(F.col("node").alias(p), F.col("shingles").alias(f"{p}_set"))

    def run(batch: pa.RecordBatch) -> list:
        keep = [i for i in range(batch.num_rows) if alike(*(np.frombuffer(batch.column(c)[i].as_py(), "<u8") for c in (2, 3)), percent)]
        return [batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)]

    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_set", "b_set")
    return map_rows(rows, run, f"a {_kind(pairs, 'a')}, b {_kind(pairs, 'b')}").distinct()


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that their sizes and batches of signatures leave."""
    side = lambda p: nodes.select(F.col("node").alias(p), F.col("n").alias(f"{p}_n"), F.col("signature").alias(f"{p}_s"))
    fewest = fewest_equal(percent, miss)

    def run(batch: pa.RecordBatch) -> list:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, VALUES) for c in (2, 3))
        left = pa.array(plausible(a, b, fewest))
        return [batch.column(c).take(left) for c in (0, 1)]

    rows = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    return map_rows(rows.select("a", "b", "a_s", "b_s"), run, f"a {_kind(pairs, 'a')}, b {_kind(pairs, 'b')}").distinct()


def own_shingles(sets: DataFrame) -> DataFrame:
    """(node, digest, own): how many shingles no other set has; sets without any have no row."""
    spread = map_rows(sets.select("node", "digest", "shingles"), _explode, f"node {_kind(sets, 'node')}, digest binary, shingle long")
    alone = spread.groupBy("shingle").agg(F.min(F.struct("digest", "node")).alias("x"), F.max("digest").alias("y")).where("x.digest = y")
    return alone.groupBy(F.col("x.node").alias("node"), F.col("x.digest").alias("digest")).agg(F.count("*").alias("own"))


def with_labels(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(node, digest, n, own, label) of the sets that may reach the similarity with another one; labels (node, label)."""
    rows = sets.select("node", "digest", "n").join(own_shingles(sets), ["node", "digest"], "left").fillna(0, ["own"]).where((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent)
    return packed(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", F.col("node").cast("long"))))


def still_open(members: DataFrame) -> DataFrame:
    """Rows of ``members`` (key, label, n) whose key has several labels, with its size and the number of its blocks."""
    size = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"), F.sum("n").alias("all")).where("x <> y")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("int")
    return packed(members.join(size.select("key", "size", blocks.alias("blocks")), "key"))


def tile_links(members: DataFrame, wide: DataFrame, percent: int, likely: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Links (a, b) between different components of each key of ``members`` (key, node, digest, label, n, own, blocks).

    ``wide`` (node, digest, keys, signature, shingles) has the rest of a node;
    ``likely`` gives the indices of the rows of signatures that go on.
    """
    spark = members.sparkSession
    ship_package(spark)
    mine = members.withColumn("_mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    narrow = mine.withColumn("_x", F.least("_mine", "_other")).withColumn("_y", F.greatest("_mine", "_other")).drop("blocks", "_other")
    dealt = narrow.join(wide, ["node", "digest"]).drop("digest")

    def search(group: pa.Table) -> pa.Table:
        node, label = (group.column(c).to_numpy() for c in ("node", "label"))
        n, own, mine = (group.column(c).to_numpy() for c in ("n", "own", "_mine"))
        key = group.column("key")[0].as_py()
        keys = np.array(group.column("keys").to_pylist(), np.int64).reshape(len(node), -1)
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(node), -1)
        sets = group.column("shingles")
        shared = n - own
        twice = bool((mine != mine[0]).any())
        names, up = np.unique(label, return_inverse=True)
        held: dict[int, np.ndarray] = {}

        def full(i: int) -> np.ndarray:
            if i not in held:
                held[i] = np.frombuffer(sets[i].as_py(), "<u8")
            return held[i]

        a, b = [], []
        for i in range(len(node)):
            j = np.arange(i + 1, len(node))
            ok = (up[j] != up[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))
            # No more shingles can be common than either shares with any candidate.
            most = np.minimum(shared[j], shared[i])
            ok &= 100 * most >= percent * (n[j] + n[i] - most)
            if twice:
                ok &= mine[j] != mine[i]
            j = j[ok]
            if not len(j):
                continue
            # A pair belongs to the first band that it shares.
            same = keys[j] == keys[i]
            j = j[keys[i][same.argmax(1)] == key]
            j = j[likely(np.broadcast_to(signatures[i], signatures[j].shape), signatures[j])]
            for k in j.tolist():
                if up[k] != up[i] and alike(full(i), full(k), percent):
                    a.append(node[i])
                    b.append(node[k])
                    up[up == up[k]] = up[i]
        return pa.table({"a": pa.array(a, group.schema.field("node").type), "b": pa.array(b, group.schema.field("node").type)})

    kind = _kind(members, "node")
    return dealt.groupBy("key", "_x", "_y").applyInArrow(search, f"a {kind}, b {kind}")


def links_of(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """Links (a, b) between nodes, each named by the smallest id of its set, that connect all that the similarity connects."""
    kind = _kind(signed, "id")
    least = signed.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node"))
    least = packed(least)
    first = F.broadcast(least) if least.count() <= BROADCAST_IDS else least
    # Rows that repeat an id and its text meet themselves only, which pairs leave out.
    entries = signed.select(F.col("id").alias("node"), "digest", "keys").join(first, ["digest", "node"], "left_semi").select("node", F.explode("keys").alias("key"))
    buckets = packed(entries.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("_last")).where("pivot <> _last").select("key", "pivot"))
    # Of a band's entries only those of buckets with several nodes go on.
    met = packed(entries.join(buckets, "key"))
    wanted = packed(met.select("node").distinct())
    names = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    marks = signed.select(F.col("id").alias("node"), "digest", "n", "keys", "signature").where("n > 0").join(names, "node", "left_semi").dropDuplicates(["node", "digest"])
    marks = checkpointed(marks)
    stars = met.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    likely = _likely(stars, marks, percent, miss)
    sets = sets_of(docs, wanted, id_col, text_col)
    links = packed(confirm(likely, sets, percent))
    labels = components(links.select(F.col("a").cast("long"), F.col("b").cast("long")), packed).select(F.col("node").cast(kind).alias("node"), F.col("component").alias("label"))
    alive = with_labels(sets, labels, percent)
    # A node has several rows only where its id has several texts; it meets a bucket with each.
    open_ = still_open(packed(met.select("key", "node").distinct().join(alive, "node")))
    small = open_.where(F.col("size") <= SMALL)
    a, b = small.alias("a"), small.alias("b")
    most = F.least(F.col("a.n") - F.col("a.own"), F.col("b.n") - F.col("b.own"))
    fits = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & (most * 100 >= (F.col("a.n") + F.col("b.n") - most) * percent)
    few = _likely(a.join(b, fits).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), marks, percent, miss)
    wide = marks.select("node", "digest", "keys", "signature").join(sets.select("node", "digest", "shingles"), ["node", "digest"])
    fewest = fewest_equal(percent, miss)
    large = tile_links(open_.where(F.col("size") > SMALL).drop("size"), wide, percent, lambda x, y: plausible(x, y, fewest))
    return checkpointed(links.unionByName(confirm(few, sets, percent)).unionByName(large))


def _explode(batch: pa.RecordBatch) -> list:
    sets = [np.frombuffer(s.as_py(), "<u8").view(np.int64) for s in batch.column(2)]
    at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    return [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))]


def near_duplicate_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """``id_col`` (an integer), n_shingles, component_id, kept for each row.

    Texts link where 100 times their common shingles reach ``percent`` times all
    of theirs; ``component_id`` is the smallest id that links reach, ``kept``
    says whether it is the row's own. Null texts and those without words are
    linked with nothing. Rows of one id count as one document: what one of them
    links to, all do. Rows with a null id get the component of the documents
    with their set (null if there are none, then kept) and carry no links. Very
    long texts are hashed in parts. An empty table gives no rows. Other
    columns are ignored.
    """
    signed = checkpointed(with_signatures(docs, id_col, text_col))
    links = links_of(docs, signed, id_col, text_col, percent, miss).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    sets = signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("low"))
    # One id may have rows of several sets; those belong together as well.
    several = signed.where("id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id")
    again = signed.where("n > 0").join(several, "id", "left_semi").join(sets, "digest").where("id <> low").select(F.col("id").cast("long").alias("a"), F.col("low").cast("long").alias("b"))
    labels = components(links.unionByName(again), packed)
    named = sets.join(labels, sets["low"] == labels["node"], "left").select("digest", F.coalesce("component", "low").alias("_of_set"))
    out = signed.select("id", "n", "digest").join(named, "digest", "left")
    # A row without words shares its id's component, if other rows of that id have one.
    by_id = signed.where("n = 0").join(several, "id", "left_semi").select("id").distinct()
    other = signed.where("n > 0").join(by_id, "id", "left_semi").join(named, "digest").groupBy(F.col("id").alias("_id")).agg(F.min("_of_set").alias("_of_id"))
    out = out.join(other, (F.col("id") == F.col("_id")) & (F.col("n") == 0), "left")
    component = F.coalesce("_of_set", "_of_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
