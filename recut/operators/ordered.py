"""Ordered scans (previous row, running totals, numbering) that never put a whole key in one task.

A plain window ``PARTITION BY key ORDER BY time`` sends every row of a key to one task, so a single
long media file, or one hot project, decides the run time of the job.  ``scan`` cuts each key into
slices of the leading order column.  The window runs inside a slice; one summary row per slice
(a partial aggregate, so it combines before the shuffle) is scanned over the slices of the key, and
its carry is joined back.  The big table is shuffled once, by (key, slice).

Most keys are short (the clips of an item): where all rows lie in the first slice nothing is carried, and
the windows run by key alone.  Scans, aggregates and joins by the same key then share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recut.session import WRITTEN, settled

TIME_SLICE_MS = 600_000
ORDINAL_SLICE = 10_000
FRAME_SLICE = 50_000

_SLICE = "__slice"


@dataclass(frozen=True)
class Scan:
    """One output column of an ordered scan; all but ``total`` and ``most`` look at other rows only, never the row itself."""

    out: str
    kind: str
    value: Column | None = None


def lag(out: str, value: Column | str) -> Scan:
    return Scan(out, "lag", _col(value))


def lead(out: str, value: Column | str) -> Scan:
    return Scan(out, "lead", _col(value))


def sum_before(out: str, value: Column | str) -> Scan:
    return Scan(out, "sum", _col(value))


def max_before(out: str, value: Column | str) -> Scan:
    return Scan(out, "max", _col(value))


def last_before(out: str, value: Column | str) -> Scan:
    """Latest non-null value among earlier rows."""
    return Scan(out, "last", _col(value))


def first_after(out: str, value: Column | str) -> Scan:
    """Earliest non-null value among later rows."""
    return Scan(out, "first", _col(value))


def position(out: str) -> Scan:
    """One-based row number."""
    return Scan(out, "position")


def total(out: str, value: Column | str) -> Scan:
    """Sum over all rows of the key, the row itself included."""
    return Scan(out, "total", _col(value))


def most(out: str, value: Column | str) -> Scan:
    """Largest value of all rows of the key, the row itself included."""
    return Scan(out, "most", _col(value))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


_FIRST_SLICE = "_recut_first_slice"


def told(new: DataFrame, old: DataFrame) -> DataFrame:
    """Say of ``new`` what is known of ``old``: it has its rows or some of them, each computed from one row, with its order columns."""
    for known in (_FIRST_SLICE, WRITTEN):
        if hasattr(old, known):
            setattr(new, known, getattr(old, known))
    return new


def told_slices(new: DataFrame, old: DataFrame) -> DataFrame:
    """``told`` where ``new`` is joined to other rows: it may lie in one slice as ``old`` does, but is not written."""
    if hasattr(old, _FIRST_SLICE):
        setattr(new, _FIRST_SLICE, getattr(old, _FIRST_SLICE))
    return new


def first_slice_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float) -> bool:
    """Whether every row with a key lies in the first slice: known from an earlier scan, or asked of the rows."""
    if _is_told(df, order, width):
        return True
    at = F.col(order[0])
    only = df.dropna(subset=keys).where(at.isNull() | (at < 0) | (at >= F.lit(float(width)))).isEmpty()
    if only:
        setattr(df, _FIRST_SLICE, getattr(df, _FIRST_SLICE, frozenset()) | {(order[0], float(width))})
    return only


def _is_told(df: DataFrame, order: Sequence[str], width: float) -> bool:
    return (order[0], float(width)) in getattr(df, _FIRST_SLICE, frozenset())


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Scan],
    *,
    width: float,
) -> DataFrame:
    """Add ``specs`` to ``df``.

    Keys must not be null; ``order`` must be total, and its first column numeric and not null.  The rows are
    written first unless they are, or are known to lie in one slice: they are read more than once.
    """
    keys, order = list(keys), list(order)
    if not _is_told(df, order, width):
        df = settled(df)
    if first_slice_only(df, keys, order, width):
        return told(_scan_keys(df, keys, order, specs), df)
    sliced = df.withColumn(_SLICE, F.floor(F.col(order[0]) / F.lit(float(width))).cast("bigint"))
    # A single number keeps the summary in a hash aggregate; a struct would make it sort.
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    # Looking ahead is looking back in the opposite order: a frame open to the end costs a rescan per row.
    later = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(*[F.col(c).desc() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = Window.partitionBy(*keys).orderBy(_SLICE)
    slices_before = across.rowsBetween(Window.unboundedPreceding, -1)
    slices_after = (
        Window.partitionBy(*keys).orderBy(F.col(_SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    )

    local: list[Column] = []
    summary: list[Column] = []
    carry: list[Column] = []
    final: list[tuple[str, Column]] = []
    edges: set[str] = set()
    for i, spec in enumerate(specs):
        here, total, carried = f"__l{i}", f"__s{i}", f"__c{i}"
        value = spec.value
        if spec.kind == "lag":
            edges.add("first")
            local.append(F.lag(value, 1).over(inside).alias(here))
            summary.append(F.max_by(value, rank).alias(total))
            carry.append(F.lag(total, 1).over(across).alias(carried))
            final.append((spec.out, F.when(F.col("__first"), F.col(carried)).otherwise(F.col(here))))
        elif spec.kind == "lead":
            edges.add("last")
            local.append(F.lead(value, 1).over(inside).alias(here))
            summary.append(F.min_by(value, rank).alias(total))
            carry.append(F.lead(total, 1).over(across).alias(carried))
            final.append((spec.out, F.when(F.col("__last"), F.col(carried)).otherwise(F.col(here))))
        elif spec.kind == "sum":
            local.append(F.sum(value).over(earlier).alias(here))
            summary.append(F.sum(value).alias(total))
            carry.append(F.sum(total).over(slices_before).alias(carried))
            zero = F.lit(0)
            final.append((spec.out, F.coalesce(F.col(here), zero) + F.coalesce(F.col(carried), zero)))
        elif spec.kind == "total":
            summary.append(F.sum(value).alias(total))
            carry.append(F.sum(total).over(Window.partitionBy(*keys)).alias(carried))
            final.append((spec.out, F.col(carried)))
        elif spec.kind == "most":
            summary.append(F.max(value).alias(total))
            carry.append(F.max(total).over(Window.partitionBy(*keys)).alias(carried))
            final.append((spec.out, F.col(carried)))
        elif spec.kind == "max":
            local.append(F.max(value).over(earlier).alias(here))
            summary.append(F.max(value).alias(total))
            carry.append(F.max(total).over(slices_before).alias(carried))
            final.append((spec.out, F.greatest(F.col(here), F.col(carried))))
        elif spec.kind == "last":
            local.append(F.last(value, ignorenulls=True).over(earlier).alias(here))
            summary.append(F.max_by(value, F.when(value.isNotNull(), rank)).alias(total))
            carry.append(F.last(total, ignorenulls=True).over(slices_before).alias(carried))
            final.append((spec.out, F.coalesce(F.col(here), F.col(carried))))
        elif spec.kind == "first":
            local.append(F.last(value, ignorenulls=True).over(later).alias(here))
            summary.append(F.min_by(value, F.when(value.isNotNull(), rank)).alias(total))
            carry.append(F.last(total, ignorenulls=True).over(slices_after).alias(carried))
            final.append((spec.out, F.coalesce(F.col(here), F.col(carried))))
        elif spec.kind == "position":
            local.append(F.row_number().over(inside).cast("bigint").alias(here))
            summary.append(F.count(F.lit(1)).alias(total))
            carry.append(F.sum(total).over(slices_before).alias(carried))
            final.append((spec.out, F.col(here) + F.coalesce(F.col(carried), F.lit(0))))
        else:
            raise ValueError(f"unknown scan kind {spec.kind}")
    if "first" in edges:
        local.append((F.row_number().over(inside) == 1).alias("__first"))
    if "last" in edges:
        local.append(F.lead(F.lit(1), 1).over(inside).isNull().alias("__last"))

    carried = sliced.groupBy(*keys, _SLICE).agg(*summary).select(*keys, _SLICE, *carry)
    joined = sliced.select("*", *local).join(carried, [*keys, _SLICE])
    kept = [c for c in df.columns if c not in {name for name, _ in final}]
    return joined.select(*kept, *[value.alias(name) for name, value in final])


def _scan_keys(df: DataFrame, keys: list[str], order: list[str], specs: Sequence[Scan]) -> DataFrame:
    """``scan`` where no key has rows in two slices; rows with a null in a key go, as there."""
    present = df.dropna(subset=keys)
    whole = Window.partitionBy(*keys)
    inside = whole.orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    kinds = {
        "lag": lambda v: F.lag(v, 1).over(inside),
        "lead": lambda v: F.lead(v, 1).over(inside),
        "sum": lambda v: F.coalesce(F.sum(v).over(earlier), F.lit(0)),
        "total": lambda v: F.sum(v).over(whole),
        "most": lambda v: F.max(v).over(whole),
        "max": lambda v: F.max(v).over(earlier),
        "last": lambda v: F.last(v, ignorenulls=True).over(earlier),
        "first": lambda v: F.last(v, ignorenulls=True).over(later),
        "position": lambda _: F.row_number().over(inside).cast("bigint"),
    }
    for spec in specs:
        if spec.kind not in kinds:
            raise ValueError(f"unknown scan kind {spec.kind}")
    outs = {spec.out for spec in specs}
    kept = [c for c in df.columns if c not in outs]
    return present.select(*kept, *[kinds[spec.kind](spec.value).alias(spec.out) for spec in specs])


def group_ids(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, out: str, *, width: float
) -> DataFrame:
    """Number the groups opened by rows where ``starts`` is true; the first row of a key opens one too.

    Whether a row opens a group usually comes out of a scan itself.  ``scan`` writes the flagged rows once, rather than
    computing them for every reader, unless they are known to lie in one slice and follow from the same shuffle.
    """
    flagged = told(df.withColumn("__open", F.coalesce(starts, F.lit(True)).cast("bigint")), df)
    counted = scan(flagged, keys, order, [sum_before("__opened", "__open")], width=width)
    return told(counted.withColumn(out, F.col("__opened") + F.col("__open")).drop("__opened", "__open"), counted)
