"""Near-duplicates by SimHash and vantage-point trees.

Fingerprints of 64 bits link at a Hamming distance of ``RADIUS`` or less.
Links are found in four trees, one for each quarter of the bits: if two
fingerprints differ in at most four bits, they differ in at most one bit of
some quarter, so that tree's own distance (over its 16 bits, a metric as well)
needs a search radius of only one. This keeps the part of the fingerprints that
lies near a boundary small, where the distance over all 64 bits concentrates
around 32 and hardly prunes.

A tree's top is built on the driver from a bounded sample of fingerprints; its
leaves are shards. Each distinct fingerprint is at home in one shard and visits
those whose boundary lies within the radius (triangle bound). Inside a shard
the same recursion goes on, and what is left is compared over all 64 bits, so
links are exact. A shard returns its components as stars, never all
pairs. Components come from alternating star operations on the links.

``near_copies`` takes candidates from here: ``sketch`` is a wide fingerprint of the
distinct shingles, whose share of differing bits is the angle between two texts'
shingle sets divided by pi, and ``limit_for`` turns a Jaccard similarity into
bits. Its trees stand on the first bits, 16 each.
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
from placekeep.session import checkpointed, ship_package

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Bit groups, each with a tree; the search radius of each is RADIUS // SEGMENTS.
SEGMENTS = 4
#: Fingerprints that the tops of the trees are built from, at most about.
SAMPLE = 32_768
#: Fingerprints at home in a shard, about.
SHARD = 8_192
#: Points that are compared directly.
DIRECT = 384
#: Words of a shingle, similarity and 64-bit words of a sketch.
WIDE_SHINGLE, SIMILARITY, WIDE = 5, 0.8, 4
#: Deviations of the differing bits that candidates may have beyond those expected.
SPREAD = 2.5
#: Trees over a sketch's first bits, each over 16 of them with a search radius of 1.
WIDE_TREES = 12


def _hashes(text: str | None, length: int, hashed: Callable[[bytes], bytes], width: int) -> np.ndarray:
    """A row of ``width`` bytes for each shingle of ``length`` words; the whole sequence if there are fewer, none without words."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    line, out = b" ".join(words), bytearray()
    if 0 < n <= length:
        out += hashed(line)
    elif n:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        del words
        # Parts of a very long text, so that only its hashes are held whole.
        for at in range(0, n - length + 1, 65536):
            stops = (ends[length - 1 + at : length - 1 + at + 65536] - 1).tolist()
            starts = (ends[at - 1 : at - 1 + len(stops)] if at else np.append(0, ends[: len(stops) - 1])).tolist()
            out += b"".join([hashed(line[i:j]) for i, j in zip(starts, stops, strict=True)])
    return np.frombuffer(bytes(out), np.uint8).reshape(-1, width)


def _majority(hashes: np.ndarray) -> bytes:
    """Bits set in over half of the rows of bytes."""
    total = np.zeros(8 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 255):
        total += np.unpackbits(hashes[at : at + 255], axis=1).sum(0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes)).tobytes()


def simhash(text: str | None) -> int:
    """The fingerprint as unsigned integer; zero without words."""
    h = xxhash.xxh64_digest
    return int.from_bytes(_majority(_hashes(text, SHINGLE, lambda s: h(s, SEED), 8)), "big")


def sketch_and_set(text: str | None) -> tuple[bytes, np.ndarray]:
    """Wide fingerprint of the distinct shingles of ``WIDE_SHINGLE`` words (zeros without words), and their hashes in order.

    Shingles are told apart by 64 bits of their hash.
    """
    h = xxhash.xxh3_128_digest
    hashes = _hashes(text, WIDE_SHINGLE, lambda s: h(s, 0) + h(s, 1), 8 * WIDE)
    values, first = np.unique(np.ascontiguousarray(hashes[:, :8]).view(np.uint64)[:, 0], return_index=True)
    return _majority(hashes[first]), values


def sketch(text: str | None) -> bytes:
    return sketch_and_set(text)[0]


def sketch_set(text: str | None) -> np.ndarray:
    return sketch_and_set(text)[1]


def limit_for(similarity: float, bits: int = 64 * WIDE) -> int:
    """Differing bits that nearly all pairs of texts of this Jaccard similarity stay within: SPREAD deviations above what is expected."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return int(bits * share + SPREAD * math.sqrt(bits * share * (1 - share)))


def _masks(segments: int) -> list[np.uint64]:
    edges = [64 * i // segments for i in range(segments + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]


def _split(x: np.ndarray, mask: np.uint64, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """Vantage point and inner radius that leave the least pairs to compare; None if nothing divides ``x``."""
    best, most = None, 0.97 * float(len(x)) ** 2
    for v in x[rng.integers(0, len(x), 6)]:
        count = np.bincount(np.bitwise_count((x ^ v) & mask), minlength=65).astype(float)
        inside = np.cumsum(count)
        beyond = np.append(inside[radius:], np.full(radius, inside[-1])) - inside
        cost = inside**2 + (len(x) - inside) ** 2 + 2 * inside * beyond
        mu = int(cost.argmin())
        if cost[mu] < most and 0 < inside[mu] < len(x):
            best, most = (v, mu), cost[mu]
    return best


def build_top(sample: np.ndarray, total: int, mask: np.uint64, radius: int, shard: int, seed: int = 7) -> list[tuple]:
    """Nodes (vantage, inner radius, inner child, outer child), or ("leaf", number), root first."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    leaves = 0

    def grow(x: np.ndarray) -> int:
        nonlocal leaves
        me = len(nodes)
        nodes.append(())
        cut = _split(x, mask, radius, rng) if len(x) >= 2 and len(x) / len(sample) * total > shard else None
        if cut is None:
            nodes[me] = ("leaf", leaves)
            leaves += 1
            return me
        v, mu = cut
        d = np.bitwise_count((x ^ v) & mask)
        nodes[me] = (v, mu, grow(x[d <= mu]), grow(x[d > mu]))
        return me

    grow(sample)
    return nodes


def route(nodes: list[tuple], x: np.ndarray, mask: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point index, leaf, and whether the point is at home there."""
    index, leaf, home = [], [], []
    todo = [(0, np.arange(len(x)), np.ones(len(x), bool))]
    while todo:
        at, i, own = todo.pop()
        node = nodes[at]
        if node[0] == "leaf" if isinstance(node[0], str) else False:
            index.append(i)
            leaf.append(np.full(len(i), node[1]))
            home.append(own)
            continue
        v, mu, inner, outer = node
        d = np.bitwise_count((x[i] ^ v) & mask).astype(np.int64)
        into = d <= mu
        # Points at home outside visit the inside; inner ones needn't visit the outside as well.
        go = into | (d <= mu + radius)
        if go.any():
            todo.append((inner, i[go], own[go] & into[go]))
        go = ~into | (~own & (d > mu - radius))
        if go.any():
            todo.append((outer, i[go], own[go] & ~into[go]))
    return np.concatenate(index), np.concatenate(leaf), np.concatenate(home)


class Forest:
    """Spanning forest of the links seen so far."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits over the last axis, a fingerprint's words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.uint16)


def _near(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether each of ``a`` and each of ``b`` are within ``limit``; the first half of wide ones rules most pairs out."""
    width = a.shape[1]
    total = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, max(1, width // 2)):
        total = total + np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    near = total <= limit
    if width > 1:
        i, j = np.nonzero(near)
        near[i, j] = _apart(a[i], b[j]) <= limit
    return near


def _direct(x: np.ndarray, homes: np.ndarray, others: np.ndarray, limit: int, forest: Forest) -> None:
    both = np.concatenate([homes, others])
    near = _near(x[homes], x[both], limit)
    near[np.arange(len(homes)), np.arange(len(homes))] = False
    for a, b in zip(*np.nonzero(near)):
        forest.link(int(homes[a]), int(both[b]))


def _stars(x: np.ndarray, points: np.ndarray, limit: int, forest: Forest) -> None:
    """Links of a group that no vantage point divides.

    All within ``limit`` of a pivot hang together through it; by the triangle
    bound only points up to twice as far can link to them.
    """
    left = points
    while len(left):
        pivot = left[0]
        d = _apart(x[left], x[pivot])
        near, ring = left[d <= limit], left[(d > limit) & (d <= 2 * limit)]
        for i in near[1:]:
            forest.link(int(pivot), int(i))
        step = max(1, (1 << 22) // max(1, len(near)))
        for at in range(0, len(ring), step):
            some = ring[at : at + step]
            hit = _near(x[some], x[near], limit)
            for j in np.flatnonzero(hit.any(1)):
                forest.link(int(some[j]), int(near[hit[j].argmax()]))
        left = left[d > limit]


def links_within(x: np.ndarray, home: np.ndarray, mask: np.uint64, radius: int, limit: int, whole: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links that concern at least one point at home.

    The tree stands on ``mask`` of the words ``x``; links are compared over
    ``whole``, a row of words for each point (``x`` alone if None).
    """
    whole = x[:, None] if whole is None else whole
    forest = Forest(len(x))
    rng = np.random.default_rng(11)
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        homes, others = todo.pop()
        if not len(homes) or len(homes) + len(others) < 2:
            continue
        if len(homes) * (len(homes) + len(others)) <= DIRECT * DIRECT:
            _direct(whole, homes, others, limit, forest)
            continue
        cut = _split(x[homes], mask, radius, rng) if len(homes) > 8 else None
        if cut is None:
            if len(homes) <= DIRECT:
                for at in range(0, len(others) or 1, DIRECT * 4):
                    _direct(whole, homes, others[at : at + DIRECT * 4], limit, forest)
            else:
                _stars(whole, np.concatenate([homes, others]), limit, forest)
            continue
        v, mu = cut
        dh = np.bitwise_count((x[homes] ^ v) & mask).astype(np.int64)
        do = np.bitwise_count((x[others] ^ v) & mask).astype(np.int64)
        todo.append((homes[dh <= mu], np.concatenate([others[do <= mu + radius], homes[(dh > mu) & (dh <= mu + radius)]])))
        todo.append((homes[dh > mu], others[do > mu - radius]))
    return forest.edges


def stars_of(links: list[tuple[int, int]], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links' components as stars: each linked point's name and the smallest name of its component."""
    names = np.unique(np.array(links, dtype=np.int64).reshape(-1))
    forest = Forest(len(names))
    order = names[np.argsort(low[names], kind="stable")]
    rank = dict(zip(order.tolist(), range(len(order))))
    for i, j in links:
        forest.link(rank[i], rank[j])
    least = np.array([forest.root(i) for i in range(len(order))], dtype=np.int64)
    inner = np.arange(len(order)) != least
    return low[order][inner], low[order[least]][inner]


#: Neighbours from which a node's rows are joined by broadcast, at least, and nodes that are broadcast, at most.
HUB, HUBS = 64, 200_000


#: Rows of ids in a partition, at most, where small tables are put together.
PACKED = 200_000


def packed(df: DataFrame) -> DataFrame:
    """A checkpoint of narrow rows in no more partitions than they need, so that small tables don't leave a file for each pair of tasks."""
    df = checkpointed(df)
    return df.coalesce(max(1, -(-df.count() // PACKED)))


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its smallest node.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join, with a checkpoint after each round. The rows of a node with many
    neighbours don't meet in one task: the minima of such hubs are broadcast.
    ``cut`` makes the checkpoints. There are at most HUBS of them, as a hub has at least so many rows that
    HUBS of them would be all.
    """

    def star(pairs: DataFrame, large: bool, hub: int) -> DataFrame:
        """pairs (u, v): neighbours v of u."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        hubs, others = F.broadcast(least.where(F.col("n") > hub).select("u", "m")), least.where(F.col("n") <= hub).select("u", "m")
        joined = pairs.join(hubs, "u").unionByName(pairs.join(hubs.select("u"), "u", "left_anti").join(others, "u"))
        if large:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = cut(tidy(edges.select("a", "b")))
    state = None
    while True:
        mark, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == mark:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hub = max(HUB, -(-2 * state[0] // HUBS))
        now = cut(star(both, large=True, hub=hub).where("a <> b"))
        hub = max(HUB, -(-now.count() // HUBS))
        now = cut(tidy(star(now.select(F.col("a").alias("u"), F.col("b").alias("v")), large=False, hub=hub)))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fp): the signed 64-bit form of each fingerprint."""

    def run(batch: pa.RecordBatch) -> list:
        fp = np.fromiter((simhash(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        return [batch.column(0), pa.array(fp.view(np.int64))]

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp long")


def _words(fp: list | pa.Array | pa.ChunkedArray, wide: bool) -> np.ndarray:
    """A row of unsigned 64-bit words for each fingerprint."""
    if wide:
        values = fp if isinstance(fp, list) else fp.to_pylist()
        return np.frombuffer(b"".join(values), ">u8").astype(np.uint64).reshape(-1, WIDE)
    return np.array(fp, dtype=np.int64).view(np.uint64).reshape(-1, 1)


def link_edges(nodes: DataFrame, limit: int = RADIUS, segments: int = SEGMENTS, shard: int = SHARD) -> DataFrame:
    """Pairs (a, b) of names of ``nodes`` (fp, low) that connect what links connect: each shard's components as stars.

    Fingerprints of 64 bits have ``segments`` trees over all bits and lose no
    link. Sketches (bytes) have ``WIDE_TREES`` trees; a pair at the limit that
    differs in two bits or more of each tree's 16 is lost.
    """
    spark = nodes.sparkSession
    ship_package(spark)
    total = nodes.count()
    wide = dict(nodes.dtypes)["fp"] == "binary"
    part = min(1_000_000, SAMPLE * 1_000_000 // max(1, total) + 1)
    sample = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < part).select("fp").collect()
    x = _words([r.fp for r in sample], wide) if sample else np.zeros((1, WIDE if wide else 1), np.uint64)
    radius = 1 if wide else limit // segments
    # Each tree's word of the fingerprint and its bits there.
    trees = [(k // 4, _masks(4)[k % 4]) for k in range(WIDE_TREES)] if wide else [(0, m) for m in _masks(segments)]
    tops = [build_top(np.sort(x[:, word]), total, mask, radius, shard) for word, mask in trees]
    first = np.cumsum([0, *(sum(n[0] == "leaf" for n in t if isinstance(n[0], str)) for t in tops)])

    def deal(batch: pa.RecordBatch) -> list:
        fp, low = _words(batch.column(0), wide), batch.column(1).to_numpy()
        index, leaves, homes = [], [], []
        for top, (word, mask), base in zip(tops, trees, first):
            i, leaf, home = route(top, fp[:, word], mask, radius)
            index.append(i)
            leaves.append(leaf + base)
            homes.append(home)
        index = np.concatenate(index)
        return [pa.array(np.concatenate(leaves)), batch.column(0).take(pa.array(index)), pa.array(low[index]), pa.array(np.concatenate(homes))]

    def search(group: pa.Table) -> pa.Table:
        number = group.column("shard")[0].as_py()
        word, mask = trees[int(np.searchsorted(first, number, "right")) - 1]
        low, fp = group.column("low").to_numpy(), _words(group.column("fp"), wide)
        found = links_within(np.ascontiguousarray(fp[:, word]), group.column("home").to_numpy().astype(bool), mask, radius, limit, fp)
        a, b = stars_of(found, low)
        return pa.table({"a": a, "b": b})

    kind = "binary" if wide else "long"
    dealt = map_rows(nodes.select("fp", F.col("low").cast("long").alias("low")), deal, f"shard long, fp {kind}, low long, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = RADIUS) -> DataFrame:
    """``id_col``, fingerprint (16 lowercase hex digits), component_id for each row.

    ``component_id`` is the smallest id that links reach, the row's own
    included. Null texts count as empty; texts without words have fingerprint
    zero and link like any other. Rows of one id count as one document. Rows
    with a null id get the component of the documents with their fingerprint
    (null if there are none) and carry no links. Other columns are ignored.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col))
    return label_components(fps, id_col, limit)


def label_components(fps: DataFrame, id_col: str = "doc_id", limit: int = RADIUS) -> DataFrame:
    """Components of checkpointed fingerprints."""
    nodes = checkpointed(fps.groupBy("fp").agg(F.min(id_col).alias("low")))
    edges = checkpointed(link_edges(nodes.where("low IS NOT NULL"), limit))
    # One id may have rows of several fingerprints; those belong together as well.
    again = fps.join(nodes, "fp").where(F.col(id_col) != F.col("low")).select(F.col(id_col).cast("long").alias("a"), F.col("low").cast("long").alias("b"))
    several = fps.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select(F.col(id_col).cast("long").alias("again"))
    bridges = again.join(several, F.col("a") == F.col("again"), "left_semi")
    labels = components(edges.unionByName(bridges))
    named = nodes.join(labels, nodes["low"] == labels["node"], "left").select("fp", F.coalesce("component", "low").alias("component_id"))
    return fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
