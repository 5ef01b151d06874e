"""Text rules: does a clip carry dialogue the reference kept, judged by subtitle similarity."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recut.functions.text import keep_alnum
from recut.functions.udfs import nfkc, sequence_ratio
from recut.operators.audio import segment_audio_role
from recut.operators.intervals import BUCKET_MS, overlap_join
from recut.session import cut_lineage

# Fixed thresholds of the rules.
ORIGINAL_SIMILARITY, REVIEW_SIMILARITY, MIN_DIALOGUE_CHARS = 0.82, 0.65, 3


class Related(NamedTuple):
    by_range: DataFrame
    by_unit: DataFrame


def units_to_ranges(units: DataFrame, ranges: DataFrame, shots: DataFrame, keys: Sequence[str], *, bucket: int = BUCKET_MS) -> Related:
    """Units and ranges of a segment related through the range's reference shot.

    A range meeting no unit relates to all units of its segment, and a unit meeting no range to all
    ranges; the two directions therefore differ.
    """
    keys = list(keys)
    seg = [*keys, "seg_no"]
    shot = shots.select(*keys, F.col("shot_no").alias("source_ref_shot"), F.col("start_ms").alias("__s0"), F.col("end_ms").alias("__s1"))
    placed = ranges.select(*seg, "range_pos", "source_ref_shot").join(shot, [*keys, "source_ref_shot"])
    met = overlap_join(
        units.select(*seg, "unit_pos", "unit_start_ms", "unit_end_ms"), placed.drop("source_ref_shot"), seg,
        ("unit_start_ms", "unit_end_ms"), ("__s0", "__s1"), bucket=bucket,
    ).select(*seg, "range_pos", "unit_pos").distinct()
    lone_ranges = ranges.select(*seg, "range_pos").join(met, [*seg, "range_pos"], "left_anti")
    lone_units = units.select(*seg, "unit_pos").join(met, [*seg, "unit_pos"], "left_anti")
    by_range = met.unionByName(lone_ranges.join(units.select(*seg, "unit_pos"), seg))
    by_unit = met.unionByName(lone_units.join(ranges.select(*seg, "range_pos"), seg))
    return Related(by_range, by_unit)


def normalised(text) -> object:
    return keep_alnum(nfkc(F.coalesce(text, F.lit(""))))


def best_text_match(related: DataFrame, units: DataFrame, subtitles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per range the closest pair of a unit text and a source subtitle, or all its subtitles in one.

    The earliest unit, then the earliest subtitle win ties; the joined text comes last.  Each distinct
    pair of texts is compared once.
    """
    keys = list(keys)
    rng = [*keys, "seg_no", "range_pos"]
    single = subtitles.select(*rng, F.col("sub_no").alias("cand_no"), F.trim("text").alias("cand"))
    rows = F.array_sort(F.collect_list(F.struct("cand_no", "cand")))
    joined = (
        single.groupBy(*rng)
        .agg(rows.alias("__rows"))
        .where(F.size("__rows") > 1)
        .select(*rng, F.lit(9_223_372_036_854_775_807).alias("cand_no"), F.array_join(F.transform("__rows", lambda r: r.cand), "").alias("cand"))
    )
    candidates = single.unionByName(joined).withColumn("__b", normalised(F.col("cand")))
    asked = related.join(units.select(*keys, "seg_no", "unit_pos", "text"), [*keys, "seg_no", "unit_pos"]).where(F.trim("text") != "")
    pairs = cut_lineage(
        asked.withColumn("__a", normalised(F.col("text"))).join(candidates, rng).select(*rng, "unit_pos", "cand_no", "__a", "__b")
    )
    scored = pairs.select("__a", "__b").distinct().withColumn("similarity", sequence_ratio("__a", "__b"))
    best = F.max_by(F.struct("similarity", "unit_pos", "cand_no"), F.struct(F.col("similarity"), -F.col("unit_pos"), -F.col("cand_no")))
    return pairs.join(scored, ["__a", "__b"]).groupBy(*rng).agg(best.alias("__best")).select(*rng, "__best.*")


class TextRules(NamedTuple):
    ranges: DataFrame
    units: DataFrame
    segments: DataFrame


def classify_by_text(units: DataFrame, ranges: DataFrame, subtitles: DataFrame, shots: DataFrame, keys: Sequence[str], *, bucket: int = BUCKET_MS) -> TextRules:
    """Role, action and confidence of every range, then of every unit, then of the segments.

    units: seg_no, unit_pos, unit_start_ms, unit_end_ms, text; ranges: seg_no, range_pos,
    source_ref_shot; subtitles: seg_no, range_pos, sub_no, text; shots: shot_no, start_ms, end_ms.
    """
    keys = list(keys)
    seg = [*keys, "seg_no"]
    rng = [*seg, "range_pos"]
    related = units_to_ranges(units, ranges, shots, keys, bucket=bucket)
    texts = F.array_sort(F.collect_list(F.struct("sub_no", F.trim("text").alias("t"))))
    spoken = subtitles.groupBy(*rng).agg(F.array_join(F.transform(texts, lambda r: r.t), "").alias("__all"))
    asked = related.by_range.join(units.where(F.trim("text") != "").select(*seg, "unit_pos"), [*seg, "unit_pos"], "left_semi")
    asked = asked.select(*rng).distinct().withColumn("__asked", F.lit(True))
    best = best_text_match(related.by_range, units, subtitles, keys)
    joined = ranges.join(spoken, rng, "left").join(asked, rng, "left").join(best.select(*rng, "similarity"), rng, "left")
    score = F.coalesce("similarity", F.lit(0.0))
    enough = F.char_length(normalised(F.col("__all"))) >= MIN_DIALOGUE_CHARS
    quiet, silent = F.col("__all").isNull(), F.col("__asked").isNull()
    original = enough & (score >= ORIGINAL_SIMILARITY)
    review = score >= REVIEW_SIMILARITY
    e3 = lambda x: F.floor(x * 1_000 + 0.5) / 1_000
    decided = joined.select(
        *ranges.columns,
        F.when(quiet | silent, "narration_overlay").when(original, "original_dialogue").when(review, "unknown").otherwise("narration_overlay").alias("audio_role"),
        F.when(quiet | silent, "rewrite_and_voiceover").when(original, "play_original_audio").when(review, "manual_review").otherwise("rewrite_and_voiceover").alias("audio_action"),
        F.when(quiet, 0.9).when(silent, 0.75).when(original, e3(F.least(F.lit(0.99), F.greatest(F.lit(0.82), score)))).when(review, e3(score)).otherwise(e3(F.greatest(F.lit(0.7), 1.0 - score))).alias("audio_confidence"),
    )
    decided = cut_lineage(decided)
    facts = related.by_unit.join(decided.select(*rng, "audio_action", "audio_confidence"), rng)
    per_unit = facts.groupBy(*seg, "unit_pos").agg(
        F.max(F.when(F.col("audio_action") == "play_original_audio", F.col("audio_confidence"))).alias("__o"),
        F.max(F.when(F.col("audio_action") == "manual_review", F.col("audio_confidence"))).alias("__r"),
        F.array_sort(F.collect_list("range_pos")).alias("related_ranges"),
    )
    o, r = F.col("__o"), F.col("__r")
    matched = unit_matches(facts.where("audio_action = 'play_original_audio'"), units, subtitles, keys)
    judged = units.join(per_unit, [*seg, "unit_pos"], "left").join(matched, [*seg, "unit_pos"], "left").select(
        *units.columns,
        F.when(o.isNotNull(), "original_dialogue").when(r.isNotNull(), "unknown").otherwise("narration").alias("role"),
        F.when(o.isNotNull(), "play_original_audio").when(r.isNotNull(), "manual_review").otherwise("rewrite").alias("action"),
        F.coalesce(o, r, F.lit(0.9)).alias("confidence"),
        F.coalesce("related_ranges", F.array().cast("array<bigint>")).alias("related_ranges"),
        F.coalesce("matched_movie_subtitles", F.array().cast("array<struct<range_pos:bigint,sub_no:bigint,similarity:double>>")).alias("matched_movie_subtitles"),
    )
    return TextRules(decided, judged, segment_audio_role(decided, seg))


def unit_matches(facts: DataFrame, units: DataFrame, subtitles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source subtitles a unit repeats, among those of its original ranges."""
    seg = [*keys, "seg_no"]
    a = units.select(*seg, "unit_pos", normalised(F.col("text")).alias("__a"))
    b = subtitles.select(*seg, "range_pos", "sub_no", normalised(F.col("text")).alias("__b"))
    pairs = cut_lineage(facts.select(*seg, "unit_pos", "range_pos").join(a, [*seg, "unit_pos"]).join(b, [*seg, "range_pos"]))
    scored = pairs.select("__a", "__b").distinct().withColumn("similarity", sequence_ratio("__a", "__b")).where(F.col("similarity") >= REVIEW_SIMILARITY)
    found = F.array_sort(F.collect_list(F.struct("range_pos", "sub_no", F.round("similarity", 3).alias("similarity"))))
    return pairs.join(scored, ["__a", "__b"]).groupBy(*seg, "unit_pos").agg(found.alias("matched_movie_subtitles"))
