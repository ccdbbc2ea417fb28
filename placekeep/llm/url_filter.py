"""URL filters on a sorted digest array.

Every rule and every listed host becomes one key string (host followed by
path). The 64-bit xxhash digests of the keys are kept as one sorted array in a
file that is memory-mapped, probed for the candidate keys of a whole batch with
one vectorised binary search, and confirmed against the stored full strings, so
that a digest collision can't give a verdict. A list of bounded size is one file
that Spark distributes. A longer one stays distributed: digest ranges of it
become a file each, within the task that holds the range, which is probed for
the distinct hosts of the pages whose digests lie there.
"""

from __future__ import annotations

import hashlib
import os
import string
import struct
import tempfile
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekeep.llm.common import map_rows
from placekeep.session import checkpointed


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


#: The stated rules.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

#: Listed hosts that go into one distributed file; of a longer list each range of digests holds about as many.
MAPPED = 1_000_000
#: Hosts that are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 500_000

_MAGIC = b"DIGESTS1"
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty if ``url`` is null or has no ``://``."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    if slash < 0:
        return rest.translate(_UPPER), ""
    return rest[:slash].translate(_UPPER), rest[slash:]


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


def write_digest_file(entries: dict[str, str], path: str) -> None:
    """Sorted digests, then offsets, then the full strings ``verdict<TAB>key`` in the same order.

    Two keys of equal digest stand next to each other; a probe walks over all
    of them.
    """
    rows = sorted((digest(k), k, v) for k, v in entries.items())
    blobs = [f"{v}\t{k}".encode("utf-8", "surrogatepass") for _, k, v in rows]
    offsets = np.zeros(len(rows) + 1, np.uint64)
    offsets[1:] = np.cumsum([len(b) for b in blobs], dtype=np.uint64) if blobs else []
    with open(path, "wb") as f:
        f.write(_MAGIC + struct.pack("<Q", len(rows)))
        f.write(np.array([d for d, _, _ in rows], np.uint64).tobytes())
        f.write(offsets.tobytes())
        f.write(b"".join(blobs))


class DigestSet:
    """A digest file, memory-mapped."""

    def __init__(self, path: str) -> None:
        self.map = np.memmap(path, np.uint8, "r")
        n = int(self.map[8:16].view("<u8")[0])
        self.digests = self.map[16 : 16 + 8 * n].view("<u8")
        self.offsets = self.map[16 + 8 * n : 24 + 16 * n].view("<u8")
        self.blob = self.map[24 + 16 * n :]

    def stored(self, i: int) -> tuple[str, str]:
        raw = self.blob[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes().decode("utf-8", "surrogatepass")
        verdict, _, key = raw.partition("\t")
        return verdict, key

    def probe(self, keys: list[str]) -> list[str | None]:
        """The verdict stored for each key, or None."""
        out: list[str | None] = [None] * len(keys)
        if not len(self.digests) or not keys:
            return out
        wanted = np.fromiter((digest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        near = np.minimum(at, len(self.digests) - 1)
        for j in np.flatnonzero(self.digests[near] == wanted):
            i = int(at[j])
            while i < len(self.digests) and self.digests[i] == wanted[j]:
                verdict, key = self.stored(i)
                if key == keys[j]:
                    out[j] = verdict
                    break
                i += 1
        return out


@lru_cache(maxsize=8)
def _opened(name: str) -> DigestSet:
    return DigestSet(SparkFiles.get(name))


def _suffixes(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def _key_rows(df: DataFrame, parts_log: int) -> DataFrame:
    """Adds the digest range ``part`` of column ``key``, as the last of two."""
    shift = np.uint64(64 - parts_log)

    def run(batch: pa.RecordBatch) -> list:
        wanted = np.fromiter((digest("h" + k) for k in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
        return [batch.column(0), pa.array((wanted >> shift).astype(np.int64))]

    return map_rows(df, run, "key string, part long")


def listed_hosts(seen: DataFrame, hosts: DataFrame, keys: int) -> DataFrame:
    """The hosts of ``seen`` (host) of which they or a parent domain are among the ``keys`` distinct ones of ``hosts`` (key)."""
    parts_log = max(1, (-(-keys // MAPPED) - 1).bit_length())
    labels = "split(host, '\\\\.')"
    suffixes = F.expr(f"transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels})), '.'))")
    tried = checkpointed(seen.where("host <> ''").distinct().select("host", F.explode(suffixes).alias("key")).where("key <> ''"))

    def probe(asked: pa.Table, known: pa.Table) -> pa.Table:
        wanted = asked.column("key").to_pylist()
        with tempfile.TemporaryDirectory() as folder:
            write_digest_file({"h" + k: "block" for k in known.column("key").to_pylist()}, f"{folder}/d")
            found = DigestSet(f"{folder}/d").probe(["h" + k for k in wanted])
        return pa.table({"key": pa.array([k for k, v in zip(wanted, found) if v], pa.string())})

    # A range of digests belongs to this task alone: its file needs no other machine.
    asked = _key_rows(tried.select("key").distinct(), parts_log).groupBy("part")
    hits = checkpointed(asked.cogroup(_key_rows(hosts.select("key"), parts_log).groupBy("part")).applyInArrow(probe, "key string"))
    small = F.broadcast(hits) if hits.count() <= BROADCAST_HOSTS else hits
    return tried.join(small, "key", "left_semi").select("host").distinct()


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, hosts: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", host_col: str = "host") -> DataFrame:
    """``id_col``, host, path, rule, verdict for each row of ``pages``.

    The longest fitting rule decides; without one, a host (or a parent domain)
    in the list ``hosts`` (column ``host_col``; A-Z are lower-cased, nulls and
    empty ones ignored, repeated ones counted once) is blocked and all else is
    allowed. Null urls and those without ``://`` have empty host and path, no
    rule, and are allowed. Repeated rows give repeated results; an empty table
    gives an empty one; other columns of both tables are ignored.
    """
    spark = pages.sparkSession
    listed, keys = None, 0
    if hosts is not None:
        lower = F.translate(F.trim(F.col(host_col)), string.ascii_uppercase, string.ascii_lowercase)
        listed = checkpointed(hosts.select(lower.alias("key")).where("key <> ''").distinct())
        keys = listed.count()
    mapped = [] if listed is None or keys > MAPPED else listed.toArrow()["key"].to_pylist()
    entries = {f"r{r.host}{r.path}": r.verdict for r in rules} | {f"h{h}": "block" for h in mapped}
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    name = "digests-" + hashlib.sha256("\n".join(f"{k}\t{v}" for k, v in sorted(entries.items())).encode("utf-8", "surrogatepass")).hexdigest()[:16] + ".bin"
    sc = spark.sparkContext
    shipped = sc.__dict__.setdefault("_placekeep_digests", set())
    if name not in shipped:
        local = os.path.join(tempfile.mkdtemp(), name)
        write_digest_file(entries, local)
        sc.addFile(local)
        shipped.add(name)

    def run(batch: pa.RecordBatch) -> list:
        digests = _opened(name)
        parts = [split_url(u) for u in batch.column(1).to_pylist()]
        asked: list[str] = []
        spans = []
        for host, path in parts:
            begin = len(asked)
            fitting = [s + path[:n] for s in _suffixes(host) for n in lengths if len(path) >= n]
            asked += ["r" + k for k in sorted(set(fitting), key=lambda k: (-len(k), k))]
            middle = len(asked)
            asked += ["h" + s for s in _suffixes(host)]
            spans.append((begin, middle, len(asked)))
        found = digests.probe(asked)
        rule, verdict = [], []
        for begin, middle, end in spans:
            hit = next((i for i in range(begin, middle) if found[i]), None)
            rule.append(None if hit is None else asked[hit][1:])
            verdict.append(found[hit] if hit is not None else "block" if any(found[middle:end]) else "allow")
        return [batch.column(0), [h for h, _ in parts], [p for _, p in parts], rule, verdict]

    kind = dict(pages.dtypes)[id_col]
    judged = map_rows(pages.select(id_col, url_col), run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
    if listed is None or keys <= MAPPED:
        return judged
    blocked = checkpointed(listed_hosts(judged.where("rule IS NULL").select("host"), listed, keys)).withColumn("_listed", F.lit(True))
    blocked = F.broadcast(blocked) if blocked.count() <= BROADCAST_HOSTS else blocked
    verdict = F.when(F.col("rule").isNull() & F.col("_listed").isNotNull(), "block").otherwise(F.col("verdict"))
    return judged.join(blocked, "host", "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"))
