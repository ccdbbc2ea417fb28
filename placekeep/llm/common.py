"""What several text operators share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekeep.session import ship_package


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns a batch or a list of columns in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(df.sparkSession)
    # What an operator before has freed on the driver.
    give_back()
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _asked[0]
        for batch in batches:
            out = fn(batch)
            if _asked[0] == asked:
                # Another operator's state; this one needs none.
                _held[:] = [None, None]
            if not isinstance(out, pa.RecordBatch):
                out = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
            yield out
        give_back()

    return df.mapInArrow(run, struct)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers stay between tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def held_out_id(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def fold_table(*kept: tuple[int, int]) -> bytes:
    """For ``bytes.translate``: ASCII characters outside of the ranges ``kept`` become blanks, A-Z lower case, others stay."""
    inside = lambda c: c >= 0x80 or any(a <= c <= b for a, b in kept)
    return bytes((c + 32 if 65 <= c <= 90 else c) if inside(c) else 32 for c in range(256))


#: Bytes of a text that are split into words at once.
PART = 1 << 22


def word_parts(text: str | None, table: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text that ``table`` leaves, in lists of some ``PART`` bytes, so that a very long text isn't held as words."""
    line, at = (text or "").encode("utf-8").translate(table), 0
    while at < len(line):
        end = line.find(b" ", at + PART)
        end = len(line) if end < 0 else end
        yield line[at:end].split()
        at = end


_held: list = [None, None]
#: How often state was asked for.
_asked = [0]


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this Python worker for ``key`` until another key is asked for.

    Workers outlive tasks and serve many operators; one state at a time, and
    none while an operator without one runs, bounds what they hold.
    """
    _asked[0] += 1
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, make()]
    return _held[1]
