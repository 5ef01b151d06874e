"""Timeline, audio and matching expressions, all JVM side.  Times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed vocabularies.
ACCEPTED = ("matched", "matched_low_confidence", "inferred_by_neighbors")
PATTERNS = ("all_narration", "all_original_audio", "narration_then_original_audio", "original_audio_then_narration")
ORIGINAL_ITEM_MODES = ("original", "ost", "keep_original")
ORIGINAL_ACTIONS = ("keep_original_audio", "play_original", "keep_original")
ORIGINAL_ROLES = ("original_dialogue", "original_audio", "movie_dialogue")
# Fixed values, milliseconds.
FIT_TOLERANCE_MS = 30
MIN_CLIP_MS = 30


def round_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds, half up."""
    return F.floor(seconds * 1_000 + 0.5).cast("bigint")


def sec_to_us(seconds: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), seconds) * 1_000_000 + 0.5).cast("bigint")


def span(start: Column, end: Column) -> Column:
    """Length of a span; reversed or unreadable ends count as nothing."""
    return F.coalesce(F.greatest(F.lit(0), end - start), F.lit(0))


def confidence(score: Column, inliers: Column, gap: Column) -> Column:
    return (
        F.when((score >= 0.72) & (inliers >= 20) & (gap >= 0.03), "high")
        .when((score >= 0.55) | (inliers >= 8), "medium")
        .otherwise("low")
    )


def match_status(
    reason: Column, override: Column, score: Column, level: Column, inliers: Column, *, min_score: float, min_inliers: int
) -> Column:
    return (
        F.when(reason.isNotNull(), reason)
        .when(override, "matched")
        .when(score < min_score, "needs_review")
        .when((level == "low") | (inliers < min_inliers), "matched_low_confidence")
        .otherwise("matched")
    )


def is_accepted(status: Column) -> Column:
    return F.coalesce(status.isin(*ACCEPTED), F.lit(False))


def clip_fit(start: Column, target: Column, available_end: Column) -> Column:
    """Fit a clip to a target length: struct<end_ms, fit_mode, warnings>."""
    room = F.greatest(F.lit(0), available_end - start)
    too_long = room > target + FIT_TOLERANCE_MS
    too_short = room < target - FIT_TOLERANCE_MS
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(available_end.isNull() | too_long | too_short, start + target).otherwise(available_end).alias("end_ms"),
        F.when(too_long, "cut_to_ref_duration").when(too_short, "extend_movie_end").otherwise("same_duration").alias("fit_mode"),
        F.when(too_short, F.array(F.lit("movie_clip_short"))).otherwise(none).alias("warnings"),
    )


def clamp_to_media(start: Column, end: Column, video: Column, audio: Column) -> Column:
    """Clamp a span to both streams of its media: struct<end_ms, skipped, warnings>."""
    limit = F.least(end, video, audio)
    nothing = start >= limit - MIN_CLIP_MS
    warnings = F.array_compact(
        F.array(
            F.when(limit < end, "clamped_past_ref_media_end"),
            F.when(nothing, "skipped_no_ref_media"),
        )
    )
    return F.struct(F.when(nothing, start).otherwise(limit).alias("end_ms"), nothing.alias("skipped"), warnings.alias("warnings"))


def audio_mode(action: Column, *, strict: bool = False) -> Column:
    """Audio mode of an action.  Unless strict, the alias for keeping the original sound is understood too."""
    originals = ["play_original_audio"] if strict else ["play_original_audio", "keep_original_audio"]
    return (
        F.when(action.isin(*originals), "original").when(action == "play_original_audio_low_volume", "mixed").otherwise("voiceover")
    )


def unit_audio_mode(keep_original: Column, actions: Column, *, strict: bool = False) -> Column:
    """Mode of a text unit: its own flag, then any original range, then any low-volume range."""
    modes = F.transform(actions, lambda a: audio_mode(a, strict=strict))
    return (
        F.when(F.coalesce(keep_original, F.lit(False)), "original")
        .when(F.array_contains(modes, "original"), "original")
        .when(F.array_contains(modes, "mixed"), "mixed")
        .otherwise("voiceover")
    )


def is_original_play(clip_keeps: Column, item_mode: Column, ost: Column, range_action: Column, range_role: Column) -> Column:
    """The clip's own flag decides; then the item, then the range it shows."""
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(clip_keeps.isNotNull(), clip_keeps)
        .when(lower(item_mode).isin(*ORIGINAL_ITEM_MODES), True)
        .when(F.coalesce(ost, F.lit(0)) == 1, True)
        .when(lower(range_action).isin(*ORIGINAL_ACTIONS), True)
        .otherwise(lower(range_role).isin(*ORIGINAL_ROLES))
    )


def item_audio_kind(audio_type: Column, keep_original: Column, has_external: Column) -> Column:
    kind = F.lower(F.coalesce(audio_type, F.lit("")))
    return (
        F.when((kind == "original_audio") | F.coalesce(keep_original, F.lit(False)), "original")
        .when((kind == "reference_audio") | F.coalesce(has_external, F.lit(False)), "reference")
        .otherwise("narration")
    )


def needs_tts(kind: Column, narration: Column) -> Column:
    return (kind == "narration") & (F.trim(F.coalesce(narration, F.lit(""))) != "")


def text_role(explicit: Column, position: Column, total: Column) -> Column:
    """Hook first, ending last, narration between; a role already given stays."""
    derived = F.when(position == 1, "hook").when((total > 1) & (position == total), "ending").otherwise("narration")
    return F.when(F.coalesce(explicit, F.lit("")) != "", explicit).otherwise(derived)


def is_narration_unit(role: Column, action: Column) -> Column:
    role = F.coalesce(F.nullif(role, F.lit("")), F.lit("narration"))
    action = F.coalesce(F.nullif(action, F.lit("")), F.lit("rewrite"))
    return (role == "narration") & ~action.isin("play_original_audio", "manual_review")


def is_original_unit(role: Column, action: Column) -> Column:
    return F.coalesce(role == "original_dialogue", F.lit(False)) | F.coalesce(action == "play_original_audio", F.lit(False))


def item_confidence(clip_count: Column, status: Column, any_low: Column, rewrite_status: Column) -> Column:
    return (
        F.when((clip_count == 0) | status.isin("missing_visual_ranges", "extended_last_clip"), "low")
        .when(any_low | (F.coalesce(rewrite_status, F.lit("")) != "ai_rewritten"), "medium")
        .otherwise("high")
    )


def visual_keys(shot_ids: Column, start: Column, end: Column) -> Column:
    """Keys under which a picture counts as already shown: its shots, else its exact span."""
    named = F.filter(shot_ids, lambda s: s.isNotNull() & (s != ""))
    clock = lambda ms: F.format_string("%.3f", ms / 1_000)
    return F.when(F.size(named) > 0, F.array_distinct(F.transform(named, lambda s: F.concat(F.lit("shot:"), s)))).otherwise(
        F.array(F.concat(F.lit("time:"), clock(start), F.lit("-"), clock(end)))
    )
