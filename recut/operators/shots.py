"""Shot boundaries from per-frame scores, and the frame positions sampled from shots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recut.operators.ordered import FRAME_SLICE, first_after, group_ids, lag, last_before, lead, position, scan
from recut.operators.paths import reached
from recut.operators.runs import exact_quantiles, run_ids
from recut.session import cut_lineage

# Fixed values of the detector.
SCORE_WEIGHTS = {"gray": 0.50, "hist": 0.40, "edge": 0.10}
THRESHOLD_FLOOR = 0.045
SPREAD_FLOOR = 0.002
DEFAULT_POSITIONS = (0.2, 0.4, 0.6, 0.8)


def cut_score(gray: Column, hist: Column, edge: Column) -> Column:
    weights = SCORE_WEIGHTS
    return gray * weights["gray"] + hist * weights["hist"] + edge * weights["edge"]


def adaptive_cut_threshold(
    scores: DataFrame, keys: Sequence[str], value: str, threshold: float, *, width: float = 0.05
) -> DataFrame:
    """Per media: floor, robust spread over the median, or a high percentile, whichever is largest."""
    high = max(90.0, min(99.7, 99.3 - (1.0 - threshold) * 5.0)) / 100.0
    base = exact_quantiles(scores, keys, value, {"median": 0.5, "high": high}, width=width)
    spread = scores.join(base.select(*keys, "median"), list(keys)).select(
        *keys, F.abs(F.col(value) - F.col("median")).alias("__dev")
    )
    mad = exact_quantiles(spread, keys, "__dev", {"mad": 0.5}, width=width)
    cutoff = F.greatest(
        F.lit(THRESHOLD_FLOOR),
        F.col("median") + F.lit(max(2.2, threshold * 5.0)) * F.greatest(F.col("mad"), F.lit(SPREAD_FLOOR)),
        F.col("high"),
    )
    return base.join(mad, list(keys)).withColumn("cutoff", cutoff)


def select_cuts(
    scores: DataFrame,
    cutoffs: DataFrame,
    keys: Sequence[str],
    *,
    frame: str = "frame_no",
    value: str = "score",
    fps: float = 25.0,
    width: float = FRAME_SLICE,
) -> DataFrame:
    """Local maxima at or above the cutoff, greedily spaced from the left, starting at frame 0."""
    keys = list(keys)
    min_gap = max(8, int(round(fps * 0.35)))
    peaks = (
        scan(scores, keys, [frame], [lag("__left", value), lead("__right", value)], width=width)
        .join(cutoffs.select(*keys, "cutoff"), list(keys))
        .where(
            (F.col(value) >= F.col("cutoff"))
            & (F.col(value) >= F.coalesce(F.col("__left"), F.lit(-1.0)))
            & (F.col(value) >= F.coalesce(F.col("__right"), F.lit(-1.0)))
        )
        .select(*keys, F.col(frame).cast("bigint").alias(frame))
    )

    # The last cut is never after the peak before, so a peak that far behind it is always kept.
    numbered = scan(peaks.where(F.col(frame) >= min_gap), keys, [frame], [lag("__before", frame)], width=width)
    heads = F.coalesce(F.col(frame) - F.col("__before") >= min_gap, F.lit(True))
    peaks = cut_lineage(numbered.select(*keys, F.col(frame).alias("__at"), heads.alias("__head")))
    return cut_lineage(reached(peaks, _next_beyond(peaks, keys, min_gap, width), keys)).select(*keys, F.col("__at").alias(frame))


def _next_beyond(peaks: DataFrame, keys: list[str], gap: int, width: float) -> DataFrame:
    """(keys, __at, __to): from each peak to the first one at least ``gap`` later; a head is reached anyway."""
    none = F.lit(None).cast("bigint")
    landing = peaks.select(*keys, F.col("__at").alias("__where"), F.lit(1).alias("__kind"), none.alias("__from"), F.struct("__at", "__head").alias("__peak"))
    asked = peaks.select(*keys, (F.col("__at") + gap).alias("__where"), F.lit(0).alias("__kind"), F.col("__at").alias("__from"), F.lit(None).cast(landing.schema["__peak"].dataType).alias("__peak"))
    ahead = scan(landing.unionByName(asked), keys, ["__where", "__kind"], [first_after("__next", "__peak")], width=width)
    return ahead.where("__kind = 0 and not __next.__head").select(*keys, F.col("__from").alias("__at"), F.col("__next.__at").alias("__to"))


def cuts_to_scenes(
    cuts: DataFrame, frame_counts: DataFrame, keys: Sequence[str], *, frame: str = "frame_no", width: float = FRAME_SLICE
) -> DataFrame:
    """Frame 0 and every cut open a scene that runs to the frame before the next cut."""
    opens = cuts.select(*keys, F.col(frame).alias("start_frame")).unionByName(
        frame_counts.select(*keys, F.lit(0).cast("bigint").alias("start_frame"))
    )
    bounded = scan(opens, keys, ["start_frame"], [lead("__next", "start_frame")], width=width)
    return bounded.join(frame_counts.select(*keys, "frame_count"), list(keys)).select(
        *keys, "start_frame", (F.coalesce("__next", "frame_count") - 1).alias("end_frame")
    )


def probs_to_scenes(
    probs: DataFrame,
    keys: Sequence[str],
    *,
    frame: str = "frame_idx",
    above: Column,
    width: float = FRAME_SLICE,
) -> DataFrame:
    """Runs of frames not above the threshold; a scene ends on the first frame above it."""
    marked = scan(probs.withColumn("__above", above), keys, [frame], [lead("__next", frame)], width=width)
    runs = run_ids(marked, keys, [frame], "__above", "__run", width=width)
    scenes = (
        runs.where(~F.col("__above"))
        .groupBy(*keys, "__run")
        .agg(
            F.min(frame).alias("start_frame"),
            F.max(F.coalesce("__next", frame)).alias("end_frame"),
        )
        .drop("__run")
    )
    whole = (
        marked.groupBy(*keys)
        .agg(F.bool_and("__above").alias("__all"), F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"))
        .where("__all")
        .drop("__all")
    )
    return scenes.unionByName(whole)


def normalize_scenes(
    scenes: DataFrame,
    keys: Sequence[str],
    *,
    frame_count: str = "frame_count",
    min_frames: int = 2,
    width: float = FRAME_SLICE,
) -> DataFrame:
    """Clamp scenes to the media; an overlapping scene replaces the end of the one before it.

    Short scenes are dropped, unless first.  A media left without scenes gets one over its whole length.
    """
    clamped = scenes.select(
        *keys,
        F.col("start_frame").alias("__order"),
        F.greatest(F.lit(0), "start_frame").cast("bigint").alias("start_frame"),
        F.least(F.greatest(F.lit(0), F.col(frame_count) - 1), "end_frame").cast("bigint").alias("end_frame"),
        F.col("end_frame").alias("__order2"),
    ).where("end_frame >= start_frame")

    # A long scene always stays.  A short one stays while each scene since the last long one starts before the end of
    # the one before it; the first that does not is dropped, and with it all short ones up to the next long one.
    order = ["__order", "__order2"]
    numbered = cut_lineage(scan(clamped, keys, order, [position("__at"), lag("__end_before", "end_frame")], width=width))
    head = (F.col("__at") == 1) | (F.col("end_frame") - F.col("start_frame") + 1 >= min_frames)
    breaks = ~head & (F.col("start_frame") > F.col("__end_before"))
    marked = [last_before("__head_at", F.when(head, F.col("__at"))), last_before("__break_at", F.when(breaks, F.col("__at")))]
    walked = scan(numbered, keys, order, marked, width=width)
    stays = head | (~breaks & (F.col("__head_at") > F.coalesce(F.col("__break_at"), F.lit(0))))
    kept_rows = cut_lineage(walked.where(stays).select(*clamped.columns))
    linked = scan(kept_rows, keys, order, [lag("__end_kept", "end_frame")], width=width)
    placed = linked.withColumn("placed", F.when(F.col("start_frame") <= F.col("__end_kept"), "extend").otherwise("open")).drop("__end_kept")
    grouped = group_ids(
        placed, keys, ["__order", "__order2"], F.col("placed") == "open", "__scene", width=width
    )
    kept = grouped.groupBy(*keys, "__scene").agg(
        F.min_by("start_frame", F.struct("__order", "__order2")).alias("start_frame"),
        F.max_by("end_frame", F.struct("__order", "__order2")).alias("end_frame"),
    )
    whole = (
        scenes.select(*keys, frame_count)
        .distinct()
        .join(kept.select(*keys).distinct(), list(keys), "left_anti")
        .select(
            *keys,
            F.lit(0).cast("bigint").alias("start_frame"),
            F.greatest(F.lit(0), F.col(frame_count) - 1).cast("bigint").alias("end_frame"),
        )
    )
    return kept.drop("__scene").unionByName(whole)


def shots_from_scenes(scenes: DataFrame, media: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scene frames to seconds: clamped to the media duration, never shorter than one frame."""
    start = F.greatest(F.lit(0.0), F.col("start_frame") / F.col("fps"))
    natural = (F.col("end_frame") + 1) / F.col("fps")
    end = F.when(F.col("duration") > 0, F.least("duration", natural)).otherwise(natural)
    return (
        scenes.join(media.select(*keys, "fps", "duration"), list(keys))
        .withColumn("start", start)
        .withColumn("end", end)
        .withColumn("end", F.when(F.col("end") <= F.col("start"), F.col("start") + 1 / F.col("fps")).otherwise(F.col("end")))
    )


def clean_positions(positions: Sequence[float] | str | None) -> list[float]:
    """Sampling fractions: parsed, clamped into the shot, distinct and sorted."""
    if isinstance(positions, str):
        positions = [float(p) for p in positions.split(",") if p.strip()]
    cleaned = sorted({min(0.95, max(0.05, float(p))) for p in positions or ()})
    return cleaned or list(DEFAULT_POSITIONS)


def position_array(spec: Column) -> Column:
    """Column form of ``clean_positions`` for a comma-separated text column."""
    parsed = F.filter(
        F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: p.try_cast("double")),
        lambda p: p.isNotNull(),
    )
    clamped = F.transform(parsed, lambda p: F.least(F.lit(0.95), F.greatest(F.lit(0.05), p)))
    cleaned = F.array_sort(F.array_distinct(clamped))
    return F.when(F.size(cleaned) > 0, cleaned).otherwise(F.array(*[F.lit(p) for p in DEFAULT_POSITIONS]))


def keyframe_times(shots: DataFrame, positions: Column, fps: float) -> DataFrame:
    """One row per sampled position of a shot; ``start_ms``/``end_ms`` in, time and frame out."""
    length = F.greatest(F.lit(0.001), F.col("end_ms") - F.col("start_ms"))
    out = shots.select("*", F.posexplode(positions).alias("__i", "position"))
    at = F.floor(F.col("start_ms") + length * F.col("position") + 0.5).cast("bigint")
    return out.select(
        *shots.columns,
        "position",
        F.concat(F.lit("fifth_"), (F.col("__i") + 1).cast("string")).alias("role"),
        at.alias("time_ms"),
        F.floor((F.col("start_ms") + length * F.col("position")) * fps / 1_000 + 0.5).cast("bigint").alias("frame"),
    )


def sample_times(shots: DataFrame, sample_fps: float, max_frames: int) -> DataFrame:
    """Evenly spaced sample times inside a margin of each shot; the midpoint when only one is wanted."""
    length = (F.col("end_ms") - F.col("start_ms")).cast("double")
    wanted = F.least(F.lit(max_frames), F.greatest(F.lit(1), F.floor(length * sample_fps / 1_000 + 0.5)))
    margin = F.least(length * 0.08, F.lit(250.0))
    step = (length - 2 * margin) / (F.col("__n") - 1)
    spread = F.col("start_ms") + margin + step * F.col("sample_no")
    return (
        shots.where(F.col("end_ms") > F.col("start_ms"))
        .where(F.lit(sample_fps > 0 and max_frames > 0))
        .withColumn("__n", wanted)
        .withColumn("sample_no", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))))
        .withColumn(
            "time_ms",
            F.floor(
                F.when(F.col("__n") == 1, (F.col("start_ms") + F.col("end_ms")) / 2).otherwise(spread) + 0.5
            ).cast("bigint"),
        )
        .drop("__n")
    )


def interior_positions(count: Column) -> Column:
    """Fractions i/(n+1) for i in 1..n; never the first or last frame."""
    n = F.greatest(F.lit(1), count)
    return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: i / (n + 1))


def select_keyframes(frames: Column, max_frames: int) -> Column:
    """At most ``max_frames`` interior frames of an array, first and last avoided, order kept."""
    wanted = max(1, max_frames)
    size = F.size(frames)
    raw = F.transform(
        F.sequence(F.lit(1), F.lit(wanted)), lambda i: F.rint(i / F.lit(wanted + 1) * (size - 1)).cast("int")
    )
    inside = F.array_distinct(F.transform(raw, lambda i: F.greatest(F.lit(1), F.least(size - 2, i))))
    picked = F.transform(inside, lambda i: F.element_at(frames, i + 1))
    return F.array_distinct(F.when((size <= 2) | (size == wanted), frames).otherwise(picked))


def overlapped_windows(frames: DataFrame, keys: Sequence[str], *, frame: str, size: int = 100, step: int = 50) -> DataFrame:
    """Each frame's places in the overlapped windows fed to a batch model.

    Edge frames are repeated to fill the first margin and the last window.  Every frame emits its own
    places, so a long media file needs no expansion in one task.
    """
    margin = (size - step) // 2
    counts = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    n, f = F.col("__n"), F.col(frame)
    rest = F.when(n % step != 0, n % step).otherwise(step)
    padded = margin + n + margin + step - rest
    last_window = F.floor((padded - size) / step)
    first_place = F.when(f == 0, 0).otherwise(f + margin)
    last_place = F.when(f == n - 1, padded - 1).otherwise(f + margin)
    placed = frames.join(counts, list(keys)).withColumn(
        "__place", F.explode(F.sequence(first_place.cast("bigint"), last_place.cast("bigint")))
    )
    lowest = F.greatest(F.lit(0), F.ceil((F.col("__place") - size + 1) / step))
    highest = F.least(last_window, F.floor(F.col("__place") / step))
    return (
        placed.withColumn("window_no", F.explode(F.sequence(lowest.cast("bigint"), highest.cast("bigint"))))
        .withColumn("slot", F.col("__place") - F.col("window_no") * step)
        .drop("__n", "__place")
    )


def stitch_windows(predictions: DataFrame, keys: Sequence[str], counts: DataFrame, *, size: int = 100, step: int = 50) -> DataFrame:
    """Centre slots of every window back to frame numbers, cut to the media length."""
    margin = (size - step) // 2
    return (
        predictions.where(F.col("slot").between(margin, margin + step - 1))
        .withColumn("frame_idx", F.col("window_no") * step + F.col("slot") - margin)
        .join(counts, list(keys))
        .where(F.col("frame_idx") < F.col("frame_count"))
        .drop("slot", "window_no", "frame_count")
    )
