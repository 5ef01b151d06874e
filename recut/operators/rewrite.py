"""Rewriting of narration: pass-through, request batches, and merging of answers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recut.functions.media import is_narration_unit, is_original_unit
from recut.functions.text import char_len
from recut.operators.ordered import ORDINAL_SLICE, position, scan


def _skips(pattern: Column) -> Column:
    return F.coalesce(pattern == "all_original_audio", F.lit(False))


def rewritten_units(units: DataFrame, answers: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Unit rows with their new text: the old one when nothing is asked, the answer, or blank for originals."""
    keys = list(keys)
    original, narrated = is_original_unit(F.col("role"), F.col("action")), is_narration_unit(F.col("role"), F.col("action"))
    rows = units
    new_text: Column = F.col("old_text")
    if answers is not None:
        rows = units.join(answers.select(*keys, "unit_id", F.col("new_text").alias("__answer")), [*keys, "unit_id"], "left")
        new_text = F.coalesce("__answer", F.lit(""))
    return rows.select(
        *keys, "seg_no", "unit_pos", "unit_id", F.coalesce(F.nullif("role", F.lit("")), F.lit("narration")).alias("role"),
        F.coalesce(F.nullif("action", F.lit("")), F.when(original, "play_original_audio").otherwise("rewrite")).alias("action"), "old_text",
        F.when(~original & narrated, new_text).otherwise("").alias("new_text"), original.alias("keep_original_audio"),
    )


def _unit_texts(rewritten: DataFrame, seg: list[str]) -> DataFrame:
    spoken = F.when(~F.col("keep_original_audio"), F.trim("new_text")).otherwise("")
    rows = F.array_sort(F.collect_list(F.struct("unit_pos", spoken.alias("t"))))
    return rewritten.groupBy(*seg).agg(F.array_join(F.transform(rows, lambda r: r.t), "").alias("__units"))


def passthrough_rewrite(segments: DataFrame, units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments with their own text as new text; fully original ones stay silent."""
    seg = [*keys, "seg_no"]
    joined = segments.join(_unit_texts(rewritten_units(units, None, keys), seg), seg, "left")
    skips = _skips(F.col("audio_pattern"))
    new_text = F.when(skips, "").otherwise(F.coalesce("__units", "old_text", F.lit("")))
    return joined.withColumn("new_text", new_text).select(
        *segments.columns, "new_text", char_len(F.col("old_text")).alias("old_char_count"), char_len(F.col("new_text")).alias("new_char_count"),
        F.when(skips, "original_audio_skip").otherwise("original").alias("rewrite_status"),
    )


def request_batches(segments: DataFrame, units: DataFrame, keys: Sequence[str], size: int, *, width: float = ORDINAL_SLICE) -> DataFrame:
    """Numbered request payloads of at most ``size`` segments, holding narration units only."""
    keys = list(keys)
    seg = [*keys, "seg_no"]
    asked = segments.where(~_skips(F.col("audio_pattern")))
    numbered = scan(asked, keys, ["seg_no"], [position("__pos")], width=width)
    narrated = units.where(is_narration_unit(F.col("role"), F.col("action")))
    unit = F.struct("unit_id", "old_text", F.coalesce("role", F.lit("narration")).alias("role"), F.coalesce("action", F.lit("rewrite")).alias("action"))
    nested = narrated.groupBy(*seg).agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_pos", unit.alias("u")))), lambda r: r.u).alias("text_units"))
    rows = numbered.join(nested, seg, "left").withColumn("batch_no", F.floor((F.col("__pos") - 1) / max(1, size)) + 1)
    item = F.struct("seg_no", "old_text", F.coalesce("text_role", F.lit("narration")).alias("text_role"), "text_units")
    packed = rows.groupBy(*keys, "batch_no").agg(F.array_sort(F.collect_list(item)).alias("input"), F.count(F.lit(1)).alias("segment_count"))
    payload = F.to_json(F.struct(F.lit("rewrite_narration_segments").alias("task"), F.col("input")))
    return packed.select(*keys, "batch_no", "segment_count", payload.alias("payload"))


def audio_selection_payloads(segments: DataFrame, clips: DataFrame, limits: DataFrame, keys: Sequence[str], size: int, *, width: float = ORDINAL_SLICE) -> DataFrame:
    """Request payloads that ask which clips keep their sound, with the budget and timing signals."""
    keys = list(keys)
    seg = [*keys, "seg_no"]
    clip = F.struct("clip_index", "start_ms", "end_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "coverage_e4", "subtitle_count", "score", "audio_role")
    nested = clips.groupBy(*seg).agg(F.array_sort(F.collect_list(clip)).alias("clips"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("segment_ms"))
    numbered = scan(segments, keys, ["seg_no"], [position("__pos")], width=width).join(nested, seg, "left")
    rows = numbered.withColumn("batch_no", F.floor((F.col("__pos") - 1) / max(1, size)) + 1)
    packed = rows.groupBy(*keys, "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("seg_no", "text_role", "old_text", "segment_ms", "clips"))).alias("segments"), F.count(F.lit(1)).alias("segment_count")
    )
    # The request states the clip budget rounded down, while the budget itself is applied rounded up.
    stated = F.struct(
        "total_ms", "total_clips", F.floor(F.col("total_ms") * 30 / 100).alias("max_original_ms"), F.floor(F.col("total_clips") * 30 / 100).alias("max_original_clips")
    )
    return packed.join(limits.select(*keys, stated.alias("global_budget")), keys).select(
        *keys, "batch_no", "segment_count", F.to_json(F.struct(F.lit("select_original_audio_under_budget").alias("task"), "global_budget", "segments")).alias("payload")
    )


class Rewritten(NamedTuple):
    segments: DataFrame
    units: DataFrame
    missing: DataFrame


def merge_rewrites(segments: DataFrame, units: DataFrame, unit_answers: DataFrame, segment_answers: DataFrame, keys: Sequence[str]) -> Rewritten:
    """Answers joined by id; ids asked for but not answered are reported, not guessed."""
    keys = list(keys)
    seg = [*keys, "seg_no"]
    filled = rewritten_units(units, unit_answers, keys)
    skipped = segments.where(_skips(F.col("audio_pattern"))).select(*seg)
    asked_units = units.where(is_narration_unit(F.col("role"), F.col("action"))).join(skipped, seg, "left_anti")
    has_units = units.select(*seg).distinct().withColumn("__has_units", F.lit(True))
    answered = unit_answers.where(F.trim("new_text") != "")
    missing_units = asked_units.join(answered, [*keys, "unit_id"], "left_anti").select(*seg, F.col("unit_id").alias("missing_id"))
    asked_segments = segments.join(skipped, seg, "left_anti").join(has_units, seg, "left_anti")
    said = segment_answers.where(F.trim("new_text") != "").select(*seg, F.trim("new_text").alias("__said"))
    missing_segments = asked_segments.join(said, seg, "left_anti").select(*seg, F.concat(F.lit("seg_"), F.col("seg_no").cast("string")).alias("missing_id"))
    joined = segments.join(_unit_texts(filled, seg), seg, "left").join(said, seg, "left").join(has_units, seg, "left")
    skips = _skips(F.col("audio_pattern"))
    new_text = F.when(skips, "").when(F.coalesce("__has_units", F.lit(False)), F.col("__units")).otherwise(F.coalesce("__said", F.lit("")))
    rows = joined.withColumn("new_text", new_text).select(
        *segments.columns, "new_text", char_len(F.col("old_text")).alias("old_char_count"), char_len(F.col("new_text")).alias("new_char_count"),
        F.when(skips, "original_audio_skip").otherwise("ai_rewritten").alias("rewrite_status"),
    )
    return Rewritten(rows, filled, missing_units.unionByName(missing_segments))
