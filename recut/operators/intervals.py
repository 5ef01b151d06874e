"""Interval operators over (media, start, end) tables in integer milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recut.operators.ordered import TIME_SLICE_MS, group_ids, lag, max_before, scan, told
from recut.session import cut_lineage

BUCKET_MS = 60_000


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def _in_buckets(df: DataFrame, start: str, end: str, bucket: int, out: str) -> DataFrame:
    first = F.floor(F.col(start) / bucket)
    last = F.floor((F.col(end) - 1) / bucket)
    return df.where(F.col(end) > F.col(start)).withColumn(out, F.explode(F.sequence(first, last)))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    bucket: int = BUCKET_MS,
    how: str = "inner",
    bucket_out: str | None = None,
) -> DataFrame:
    """Pairs of rows whose spans share more than a point; ``bucket_out`` names a column for the bucket they met in.

    The time bucket is part of the join key, so it is a hash or merge join and one long media file is
    spread over many tasks.  A pair meeting in several buckets is kept in the first common one only.
    """
    l0, l1 = left_span
    r0, r1 = right_span
    lhs = _in_buckets(left, l0, l1, bucket, "__b")
    rhs = _in_buckets(right, r0, r1, bucket, "__rb")
    for key in keys:
        rhs = rhs.withColumnRenamed(key, f"__r_{key}")
    condition = F.col("__b") == F.col("__rb")
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"__r_{key}"))
    condition = (
        condition
        & (F.col(l0) < F.col(r1))
        & (F.col(r0) < F.col(l1))
        & (F.col("__b") == F.floor(F.greatest(F.col(l0), F.col(r0)) / bucket))
    )
    joined = lhs.join(rhs, condition, how)
    if bucket_out is not None:
        joined = joined.withColumn(bucket_out, F.col("__b"))
    return joined.drop("__b", "__rb", *[f"__r_{key}" for key in keys])


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    *,
    start: str = "start_ms",
    end: str = "end_ms",
    padding: int = 0,
    max_gap: int = 0,
    width: float = TIME_SLICE_MS,
) -> DataFrame:
    """Union of padded intervals; intervals that touch, or lie within ``max_gap``, become one."""
    # Equal intervals combine first: fewer rows to shuffle, and (start, end) becomes a total order.
    padded = (
        df.where(F.col(end) > F.col(start))
        .select(
            *keys,
            F.greatest(F.col(start) - padding, F.lit(0)).cast("bigint").alias(start),
            (F.col(end) + padding).cast("bigint").alias(end),
        )
        .groupBy(*keys, start, end)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    reach = scan(padded, keys, [start, end], [max_before("__reach", end)], width=width)
    grouped = group_ids(
        reach, keys, [start, end], F.col(start) > F.col("__reach") + max_gap, "__group", width=width
    )
    return grouped.groupBy(*keys, "__group").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.sum("__n").alias("members")
    ).drop("__group")


def gap_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    gap: int,
    start: str = "start_ms",
    end: str = "end_ms",
    out: str = "group_no",
    width: float = TIME_SLICE_MS,
) -> DataFrame:
    """Group rows while each starts within ``gap`` of the end of the row just before it."""
    with_prev = scan(df, keys, order, [lag("__prev_end", end)], width=width)
    opens = F.col(start) > F.col("__prev_end") + gap
    grouped = group_ids(with_prev, keys, order, opens, out, width=width)
    return told(grouped.drop("__prev_end"), grouped)


def subtitles_for_ranges(
    ranges: DataFrame,
    subtitles: DataFrame,
    media_keys: Sequence[str],
    range_keys: Sequence[str],
    *,
    bucket: int = BUCKET_MS,
) -> DataFrame:
    """Every range with its overlapping subtitles, in subtitle order, as ``movie_subtitles``.

    Ranges carry start_ms and end_ms; subtitles carry sub_no, sub_start_ms, sub_end_ms and text.
    """
    spoken = subtitles.withColumn("text", F.trim("text")).where(F.col("text") != "")
    nested = (
        overlap_join(
            ranges.select(*media_keys, *[k for k in range_keys if k not in media_keys], "start_ms", "end_ms"),
            spoken.select(*media_keys, "sub_no", "sub_start_ms", "sub_end_ms", "text"),
            media_keys,
            ("start_ms", "end_ms"),
            ("sub_start_ms", "sub_end_ms"),
            bucket=bucket,
        )
        .groupBy(*range_keys)
        .agg(
            F.array_sort(F.collect_list(F.struct("sub_no", "sub_start_ms", "sub_end_ms", "text"))).alias(
                "movie_subtitles"
            )
        )
    )
    empty = F.array().cast("array<struct<sub_no:bigint,sub_start_ms:bigint,sub_end_ms:bigint,text:string>>")
    return ranges.join(nested, list(range_keys), "left").withColumn(
        "movie_subtitles", F.coalesce("movie_subtitles", empty)
    )


def filter_to_windows(
    subtitles: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    *,
    order: str = "sub_no",
    bucket: int = BUCKET_MS,
) -> DataFrame:
    """Subtitles that meet any window of their media, exact repeats dropped, first one kept.

    A media without any window keeps all of its subtitles, repeats included.
    """
    spoken = subtitles.withColumn("text", F.trim("text")).where(F.col("text") != "")
    has_windows = windows.select(*keys).distinct()
    unrestricted = spoken.join(has_windows, list(keys), "left_anti")
    spans = windows.select(
        *keys, F.col("start_ms").alias("win_start_ms"), F.col("end_ms").alias("win_end_ms")
    )
    met = overlap_join(
        spoken, spans, keys, ("start_ms", "end_ms"), ("win_start_ms", "win_end_ms"), bucket=bucket
    )
    # Keep the earliest of each exact repeat: an aggregate, so repeats combine before the shuffle and
    # the several windows one subtitle may meet collapse in the same step.
    rest = [c for c in spoken.columns if c not in {*keys, "start_ms", "end_ms", "text", order}]
    identity = [*keys, "start_ms", "end_ms", "text"]
    kept = met.groupBy(*identity).agg(
        F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest]
    )
    return kept.select(*spoken.columns).unionByName(unrestricted)


def interval_coverage(
    ranges: DataFrame,
    subtitles: DataFrame,
    media_keys: Sequence[str],
    range_keys: Sequence[str],
    *,
    bucket: int = BUCKET_MS,
    width: float = TIME_SLICE_MS,
) -> DataFrame:
    """Per range: subtitles met, milliseconds covered by their union, share of the range covered."""
    pairs = overlap_join(
        ranges.select(*dict.fromkeys([*media_keys, *range_keys]), "start_ms", "end_ms"),
        subtitles.select(*media_keys, "sub_start_ms", "sub_end_ms"),
        media_keys,
        ("start_ms", "end_ms"),
        ("sub_start_ms", "sub_end_ms"),
        bucket=bucket,
    ).select(
        *range_keys,
        F.greatest("start_ms", "sub_start_ms").alias("start_ms"),
        F.least("end_ms", "sub_end_ms").alias("end_ms"),
    )
    merged = merge_intervals(pairs, range_keys, width=width)
    covered = merged.groupBy(*range_keys).agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"),
        F.sum("members").alias("subtitle_count"),
    )
    length = F.col("end_ms") - F.col("start_ms")
    return (
        ranges.join(covered, list(range_keys), "left")
        .withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0)))
        .withColumn("subtitle_count", F.coalesce("subtitle_count", F.lit(0)))
        .withColumn("coverage", F.when(length > 0, F.col("covered_ms") / length).otherwise(F.lit(0.0)))
    )


def best_overlap(
    clips: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    clip_keys: Sequence[str],
    *,
    bucket: int = BUCKET_MS,
    facts: Sequence[str] = (),
) -> DataFrame:
    """Per clip the range of the same segment sharing most time with it; the earlier range on ties.

    Ranges carry range_pos, range_start_ms and range_end_ms.  The winner is an aggregate, so clips
    meeting many ranges combine before the shuffle.  ``facts`` are columns of the winner; only the keys of a clip travel to them.
    """
    shared = overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("range_start_ms"), F.col("range_end_ms"))
    pairs = overlap_join(
        clips, ranges, keys, ("start_ms", "end_ms"), ("range_start_ms", "range_end_ms"), bucket=bucket
    ).withColumn("shared_ms", shared)
    by = list(dict.fromkeys([*clip_keys, *(keys if facts else [])]))
    best = pairs.groupBy(*by).agg(
        F.max_by(
            F.struct("range_pos", "shared_ms"), F.struct(F.col("shared_ms"), -F.col("range_pos"))
        ).alias("best")
    )
    if facts:
        winners = ranges.select(*keys, F.col("range_pos").alias("__pos"), *facts)
        named = best.withColumn("__pos", F.col("best.range_pos"))
        # Written, so that the shuffles of the pairs go before all columns of the clips are shuffled.
        best = cut_lineage(named.join(winners, [*keys, "__pos"], "left").drop("__pos"))
    return clips.join(best, by, "left").select(
        *clips.columns,
        F.col("best.range_pos").alias("range_pos"),
        F.coalesce("best.shared_ms", F.lit(0)).alias("shared_ms"),
        *facts,
    )


def adjacent_overlaps(
    clips: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    limit: int = 5_000,
    width: float,
) -> DataFrame:
    """Clips whose end runs past the start of the next one by at most ``limit``; fallback clips set aside."""
    from recut.operators.ordered import lead

    usable = clips.where(~F.coalesce(F.col("is_fallback"), F.lit(False)))
    paired = scan(usable, keys, order, [lead("next_start_ms", "start_ms")], width=width)
    over = F.col("end_ms") - F.col("next_start_ms")
    return paired.where((over > 0) & (over <= limit)).withColumn("overlap_ms", over)


def adjacent_duplicates(
    clips: DataFrame, keys: Sequence[str], order: Sequence[str], *, width: float
) -> DataFrame:
    """Neighbours showing the same reference shot, or sharing a source shot."""
    from recut.operators.ordered import lead

    paired = scan(
        clips,
        keys,
        order,
        [lead("next_ref_shot_id", "source_ref_shot_id"), lead("next_shot_ids", "movie_shot_ids")],
        width=width,
    )
    shared = F.array_sort(F.array_intersect("movie_shot_ids", "next_shot_ids"))
    same_ref = (F.col("source_ref_shot_id") != "") & (F.col("source_ref_shot_id") == F.col("next_ref_shot_id"))
    return (
        paired.withColumn("shared_shot_ids", F.coalesce(shared, F.array().cast("array<string>")))
        .withColumn("same_ref_shot", F.coalesce(same_ref, F.lit(False)))
        .where(F.col("same_ref_shot") | (F.size("shared_shot_ids") > 0))
    )
