"""Predicates and computed projections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that count as active, and those that count as gone.
ACTIVE = ("active", "unverified", "uncertain", "matched", "needs_review")
GONE = ("closed", "replaced")
#: Id ranges of the two other sources.
A_RANGE = (-1_999_999_999, -1_000_000_000)
B_RANGE = (-2_999_999_999, -2_000_000_000)
#: The order of statuses in reports.
STATUS_ORDER = ("replaced", "closed", "possible_replaced", "not_found", "needs_review")


def is_active(status: Column) -> Column:
    """Allow-list: no status counts as active."""
    return F.coalesce(status, F.lit("active")).isin(*ACTIVE)


def is_gone(status: Column) -> Column:
    """Deny-list; differs from not ``is_active`` for statuses on neither list."""
    return F.coalesce(status, F.lit("active")).isin(*GONE)


def in_scope(state: Column, scope: Sequence[str] | None) -> Column:
    """Null states are never in scope; no scope takes all."""
    return F.lit(True) if scope is None else F.upper(state).isin(*[s.upper() for s in scope])


def in_source_a(key: Column) -> Column:
    return key.between(*A_RANGE)


def in_source_b(key: Column) -> Column:
    return key.between(*B_RANGE)


def contains_text(columns: Iterable[Column], query: str) -> Column:
    """Case-insensitive substring in any column; ``%`` and ``_`` of the query stay wildcards, a backslash is itself."""
    pattern = f"%{query}%".replace("\\", "\\\\")
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).like(pattern.lower()) for c in columns])


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def differs(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)


def status_rank(status: Column) -> Column:
    """Place in reports: gone first, all else last."""
    ranked = F.when(status == STATUS_ORDER[0], 0)
    for i, s in enumerate(STATUS_ORDER[1:], 1):
        ranked = ranked.when(status == s, i)
    return ranked.otherwise(len(STATUS_ORDER))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Within (min lat, max lat, min lon, max lon); plain ranges that reach the Parquet scan."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def is_stale(checked_at: Column, cutoff: str) -> Column:
    """Never checked, not a time, or before ``cutoff``."""
    at = F.try_to_timestamp(checked_at)
    return at.isNull() | (at < F.lit(cutoff).cast("timestamp"))


def optional(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """The column if ``df`` has it, else the default (null)."""
    return F.col(name) if name in df.columns else (F.lit(None).cast("string") if default is None else default)


def joined_text(*parts: Column, sep: str = ", ") -> Column:
    """Parts that aren't null or empty, joined."""
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), sep)
