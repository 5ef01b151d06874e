"""Generic run, rank and set operators over ordered groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recut.operators.ordered import ORDINAL_SLICE, group_ids, lag, position, scan, sum_before, told


def run_ids(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "run_no", *, width: float
) -> DataFrame:
    """Number runs of consecutive rows with equal ``value``."""
    with_prev = scan(df, keys, order, [lag("__run_prev", value), position("__run_pos")], width=width)
    opens = (F.col("__run_pos") == 1) | ~F.col(value).eqNullSafe(F.col("__run_prev"))
    numbered = group_ids(with_prev, keys, order, opens, out, width=width)
    return told(numbered.drop("__run_prev", "__run_pos"), numbered)


def top_k(
    df: DataFrame, keys: Sequence[str], value: str, index: str, k: int, out: str = "rank"
) -> DataFrame:
    """Best ``k`` rows per key by value; the larger index first on ties.

    The rank filter is pushed below the shuffle, so each task forwards at most ``k`` rows per key.
    """
    best = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(index).desc())
    return df.withColumn(out, F.row_number().over(best).cast("bigint")).where(F.col(out) <= max(1, k))


def head_ratio(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ratio: float, *, width: float = ORDINAL_SLICE
) -> DataFrame:
    """The first ``ceil(n * ratio)`` rows of every key, at least one."""
    ratio = min(1.0, max(0.0, ratio))
    numbered = scan(df, keys, order, [position("__pos")], width=width)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    quota = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(ratio)))
    return numbered.join(sizes, list(keys)).where(F.col("__pos") <= quota).drop("__pos", "__n")


def even_subsample(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, *, width: float = ORDINAL_SLICE
) -> DataFrame:
    """``limit`` evenly spaced rows per key, first and last included; all rows where there are fewer.

    Row ``p`` of ``n`` is kept when some ``j < limit`` has ``floor(j * (n - 1) / (limit - 1)) = p``;
    the only candidate is the smallest ``j`` reaching ``p``.
    """
    numbered = scan(df, keys, order, [position("__pos")], width=width)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    p, span, steps = F.col("__pos") - 1, F.col("__n") - 1, F.lit(max(1, limit - 1))
    j = F.floor((p * steps + span - 1) / F.greatest(span, F.lit(1)))
    picked = (j < limit) & (F.floor(j * span / steps) == p)
    return (
        numbered.join(sizes, list(keys))
        .where((F.col("__n") <= limit) | picked)
        .drop("__pos", "__n")
    )


def first_middle_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, width: float = ORDINAL_SLICE) -> DataFrame:
    """The first, the middle (rounded up) and the last row of each key; fewer where they coincide."""
    numbered = scan(df, keys, order, [position("__pos")], width=width)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    middle = F.floor(F.col("__n") / 2) + 1
    picked = (F.col("__pos") == 1) | (F.col("__pos") == middle) | (F.col("__pos") == F.col("__n"))
    return numbered.join(sizes, list(keys)).where(picked).drop("__pos", "__n")


def candidate_ranks(
    df: DataFrame, keys: Sequence[str], score: str, selected: Column, tie: str
) -> DataFrame:
    """Rank candidates by score and add the gap between the selected one and the best other one.

    Scores are clamped to [0, 1] first; alone, the selected score itself is the gap.
    """
    clamped = df.withColumn("final_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))))
    flagged = clamped.withColumn("selected", selected)
    gaps = flagged.groupBy(*keys).agg(
        F.max(F.when(F.col("selected"), F.col("final_score"))).alias("__own"),
        F.max(F.when(~F.col("selected"), F.col("final_score"))).alias("__other"),
    )
    best = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    gap = F.coalesce(F.col("__own"), F.lit(0.0)) - F.coalesce(F.col("__other"), F.lit(0.0))
    return (
        flagged.withColumn("final_rank", F.row_number().over(best).cast("bigint"))
        .join(gaps, list(keys))
        .withColumn("score_gap", gap)
        .drop("__own", "__other")
    )


def pivot_top(df: DataFrame, keys: Sequence[str], rank: str, columns: Sequence[str], n: int = 3) -> DataFrame:
    """Top-n candidates side by side: one row per key with topI_column columns."""
    picks = [
        F.max(F.when(F.col(rank) == i, F.col(c))).alias(f"top{i}_{c}") for i in range(1, n + 1) for c in columns
    ]
    return df.where(F.col(rank) <= n).groupBy(*keys).agg(*picks)


def last_per_key(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Dictionary semantics: the last row of each key wins, blank keys are dropped.

    An aggregate rather than a window, so duplicates of a hot key combine before the shuffle.
    """
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    rest = [c for c in df.columns if c not in keys]
    picked = present.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("__row"))
    return picked.select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest])


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    *,
    width: float,
) -> DataFrame:
    """Exact interpolated quantiles per key.

    Equal values are counted before the shuffle and the counts are scanned in value order, so a key
    with any number of rows is spread over tasks; only the two rows next to each rank are kept.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = scan(counts, keys, [value], [sum_before("__below", "__c")], width=width)
    sizes = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    ranked = ranked.join(sizes, list(keys))
    picks: list[Column] = []
    finish: list[Column] = []
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        holds = lambda r: (F.col("__below") <= r) & (r < F.col("__below") + F.col("__c"))
        picks += [
            F.max(F.when(holds(low), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when(holds(high), F.col(value))).alias(f"__hi_{name}"),
            F.max(rank - low).alias(f"__fr_{name}"),
        ]
        lo, hi, fr = (F.col(f"__{part}_{name}") for part in ("lo", "hi", "fr"))
        finish.append((lo + (hi - lo) * fr).cast("double").alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *finish)
