"""Hand-checked examples: rebuild, absorption, budget, allocation, audio modes, alignment, retiming."""

from __future__ import annotations

from pyspark.sql import functions as F

from recut.operators import audio as au
from recut.operators import breakdown as bd
from recut.operators import rewrite as rw
from recut.operators import shots as sh
from recut.operators import similarity as sim
from recut.operators import timeline as tl
from recut.plans import alignment as al
from recut.plans import timeline as plans

P = ["project_id"]


def _rebuild(spark, shots, matches):
    s = spark.createDataFrame([(1, *r) for r in shots], "project_id bigint, shot_no bigint, start_ms bigint, end_ms bigint")
    m = spark.createDataFrame(
        [(1, *r, ["x"], i) for i, r in enumerate(matches)],
        "project_id bigint, shot_no bigint, movie_start_ms bigint, movie_end_ms bigint, status string, confidence string, movie_shot_ids array<string>, pos bigint",
    )
    media = spark.createDataFrame([(1, 9_500, 9_000)], "project_id bigint, video_ms bigint, audio_ms bigint")
    return plans.compose_rebuild(s, m, media, P, match_pos="pos", width=2)


def test_rebuild_merges_falls_back_and_extends(spark):
    built = _rebuild(
        spark,
        [(1, 0, 2_000), (2, 2_100, 3_100), (3, 5_000, 6_000), (4, 7_000, 9_000)],
        [(1, 10_000, 13_000, "matched", "high"), (2, 12_100, 13_100, "matched", "high"), (3, None, None, "needs_review", "low"), (4, 20_000, 21_000, "matched_low_confidence", "low")],
    )
    items = built.items.orderBy("item_no").collect()
    assert [(r.status, r.ref_start_ms, r.ref_end_ms) for r in items] == [("ready", 0, 3_100), ("fallback", 5_000, 6_000), ("ready", 7_000, 9_000)]
    clips = [(r.item_no, r.movie_start_ms, r.movie_end_ms, r.fit_mode) for r in built.clips.orderBy("item_no", "clip_no").collect()]
    assert clips[0] == (1, 10_000, 12_000, "cut_to_ref_duration")
    assert clips[2][3] == "fallback_use_ref_video"
    assert clips[3] == (3, 20_000, 22_000, "extend_movie_end")
    assert "movie_clip_short" in items[2].warnings
    assert built.quality.first().fallback_ref_shots == 1
    starts = [(r.timeline_start_ms, r.timeline_end_ms) for r in items]
    assert all(a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))


def test_short_item_joins_its_predecessor(spark):
    matches = [(1, 10_000, 12_500, "matched", "medium"), (2, 100_000, 100_400, "matched", "medium"), (3, 20_000, 21_600, "matched", "medium")]
    built = _rebuild(spark, [(1, 0, 2_500), (2, 2_500, 2_900), (3, 2_900, 5_000)], matches)
    items = built.items.orderBy("item_no").collect()
    assert len(items) == 2 and items[0].ref_end_ms == 2_900 and list(items[0].ref_shots) == [1, 2]
    clip = built.clips.where("item_no = 1").collect()
    assert [(r.movie_start_ms, r.movie_end_ms, r.fit_mode) for r in clip] == [(10_000, 12_900, "extend_previous_for_short_ref")]
    assert built.quality.first().absorbed_short_ref_count == 1


def test_half_second_is_not_short(spark):
    matches = [(1, 10_000, 12_500, "matched", "medium"), (2, 100_000, 100_500, "matched", "medium")]
    assert _rebuild(spark, [(1, 0, 2_500), (2, 2_500, 3_000)], matches).items.count() == 2


def _budget(spark, rows):
    """rows: segment, length in seconds, pattern, priority."""
    clips = spark.createDataFrame([(1, s, 0, 0, n * 1_000) for s, n, _, _ in rows], "project_id bigint, seg_no bigint, clip_index bigint, start_ms bigint, end_ms bigint")
    decisions = spark.createDataFrame(
        [(1, s, p, None, float(q), "model") for s, _, p, q in rows],
        "project_id bigint, seg_no bigint, audio_pattern string, split_clip_index bigint, priority double, source string",
    )
    roles = au.clip_roles(clips, decisions, ["project_id", "seg_no"])
    blocks = au.original_blocks(roles, ["project_id", "seg_no"])
    limits = au.budget_totals(clips, P)
    return {r.seg_no: r for r in au.apply_budget(decisions, blocks, limits, P).collect()}


def test_short_block_is_rejected(spark):
    out = _budget(spark, [(1, 2, "all_original_audio", 99), (2, 60, "all_narration", 0)])
    assert out[1].source == "budget_min_original_block"


def test_budget_keeps_the_higher_priority(spark):
    out = _budget(spark, [(1, 4, "all_original_audio", 40), (2, 4, "all_original_audio", 95), (3, 12, "all_narration", 0)])
    assert out[2].kept and out[1].source == "budget_over_limit"


def test_all_original_project_is_bounded(spark):
    out = _budget(spark, [(i, 10, "all_original_audio", i) for i in range(1, 11)])
    assert sum(r.kept for r in out.values()) == 3


def test_range_extends_to_speech(spark):
    rows = spark.createDataFrame([(1, 1, 10_000, 11_000, 3_000)], "item_no bigint, range_pos bigint, start_ms bigint, end_ms bigint, t bigint")
    (clip,) = tl.allocate_clips(rows, ["item_no"], "t").collect()
    assert (clip.start_ms, clip.end_ms, clip.allocation, clip.allocation_status) == (10_000, 13_000, "synthetic_extension", "extended_last_clip")


SEG = "project_id bigint, seg_no bigint, text string, audio_pattern string, rewrite_status string"
RNG = (
    "project_id bigint, seg_no bigint, range_pos bigint, range_id string, start_ms bigint, end_ms bigint, shot_ids array<string>, source_ref_shot string,"
    " audio_action string, confidence string, is_original boolean"
)
UNIT = "project_id bigint, seg_no bigint, unit_pos bigint, new_text string, old_text string, keep_original_audio boolean, related_range_ids array<string>"


def test_audio_aware_items(spark):
    segments = spark.createDataFrame([(1, 1, "old", None, "ai_rewritten")], SEG)
    ranges = spark.createDataFrame(
        [(1, 1, 1, "a", 10_000, 14_000, ["m1"], "r1", "rewrite_and_voiceover", "high", False), (1, 1, 2, "b", 20_000, 23_000, ["m2"], "r2", "play_original_audio", "high", True)], RNG
    )
    units = spark.createDataFrame([(1, 1, 1, "fresh words", "old words", False, ["a"]), (1, 1, 2, "", "kept", True, ["b"])], UNIT)
    timeline = plans.compose_timeline(segments, ranges, units, P)
    items = timeline.items.orderBy("timeline_no").collect()
    assert [(r.audio_mode, r.narration) for r in items] == [("voiceover", "fresh words"), ("original", "")]
    assert items[1].tts_ms == 3_000
    original = timeline.clips.where("keep_original_audio").collect()
    assert [(r.start_ms, r.end_ms) for r in original] == [(20_000, 23_000)]


def test_review_unit_speaks_its_old_text(spark):
    segments = spark.createDataFrame([(1, 1, "old", None, "original")], SEG)
    ranges = spark.createDataFrame([(1, 1, 1, "a", 0, 4_000, ["m1"], "r1", "manual_review", "high", False)], RNG)
    units = spark.createDataFrame([(1, 1, 1, "", "spoken before", False, ["a"])], UNIT)
    (item,) = plans.compose_timeline(segments, ranges, units, P).items.collect()
    assert (item.audio_mode, item.narration) == ("voiceover", "spoken before")


def test_alias_of_keeping_sound_is_understood_unless_strict(spark):
    segments = spark.createDataFrame([(1, 1, "text", None, "original")], SEG)
    ranges = spark.createDataFrame([(1, 1, 1, "a", 0, 4_000, ["m1"], "r1", "keep_original_audio", "high", True)], RNG)
    none = spark.createDataFrame([], UNIT)
    modes = [plans.compose_timeline(segments, ranges, none, P, strict=s).items.first().audio_mode for s in (False, True)]
    assert modes == ["original", "voiceover"]


def test_repeated_picture_appears_once_and_earlier_positions_stay(spark):
    segments = spark.createDataFrame([(1, i, "abcdefghij", "all_narration", "original") for i in (1, 2, 3)], SEG)
    rows = [(1, 100_000, 103_000, "m1"), (2, 100_000, 103_000, "m1"), (3, 10_000, 13_000, "m2")]
    ranges = spark.createDataFrame([(1, s, 1, f"x{s}", a, b, [m], "r", None, "high", False) for s, a, b, m in rows], RNG)
    none = spark.createDataFrame([], UNIT)
    timeline = plans.compose_timeline(segments, ranges, none, P, chars_per_second=10, min_ms=1_000)
    items = {r.seg_no: r for r in timeline.items.collect()}
    assert items[1].allocation_status == items[3].allocation_status == "trimmed_to_tts"
    assert items[2].allocation_status == "missing_visual_ranges" and items[2].clip_count == 0
    clips = sorted((r.start_ms, r.end_ms) for r in timeline.clips.collect())
    assert clips == [(10_000, 11_000), (100_000, 101_000)]


def test_passthrough_keeps_narration_units_only(spark):
    segments = spark.createDataFrame([(1, 1, "whole", "all_narration")], "project_id bigint, seg_no bigint, old_text string, audio_pattern string")
    units = spark.createDataFrame(
        [(1, 1, 1, "u1", " said ", "narration", "rewrite"), (1, 1, 2, "u2", "dialogue", "original_dialogue", "play_original_audio")],
        "project_id bigint, seg_no bigint, unit_pos bigint, unit_id string, old_text string, role string, action string",
    )
    row = rw.passthrough_rewrite(segments, units, P).first()
    assert (row.new_text, row.new_char_count, row.rewrite_status) == ("said", 4, "original")
    payload = rw.request_batches(segments.withColumn("text_role", F.lit("hook")), units, P, 5).first().payload
    assert "u1" in payload and "u2" not in payload


def test_identical_picture_wins(spark):
    def shot(no, vecs):
        return (1, no, vecs)

    frames = spark.createDataFrame(
        [(1, n, i, v) for n, vs in ((0, [[1.0, 0.0], [0.8, 0.6]]), (1, [[0.0, 1.0], [0.0, 1.0]]), (2, [[1.0, 0.0], [0.8, 0.6]]), (3, [[-1.0, 0.0], [0.0, -1.0]])) for i, v in enumerate(vs)],
        "project_id bigint, shot_no bigint, frame_pos bigint, vec array<float>",
    )
    keys = ["project_id", "shot_no"]
    shots = sim.mean_pool(frames, keys, "frame_pos", "vec").join(sim.pack_vectors(frames, P), keys).withColumn("dur_ms", F.lit(1_500))
    refs = shots.where("shot_no = 0").withColumnRenamed("shot_no", "ref_no")
    movies = shots.where("shot_no > 0").withColumn("movie_no", F.col("shot_no") - 1).drop("shot_no")
    empty = spark.createDataFrame([], "project_id bigint, shot_no bigint, frame_pos bigint, kp_no bigint, desc_no bigint, x bigint, y bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
    ranked = al.localize(refs, movies, empty, empty, P).orderBy("rank").collect()
    assert ranked[0].movie_no == 1 and ranked[0].score > ranked[1].score


def test_match_becomes_a_timeline_row(spark):
    refs = spark.createDataFrame([(1, 0, "r0", 0, 1_500, True), (1, 1, "r1", 1_500, 2_000, True), (1, 2, "r2", 2_000, 2_500, False)], "project_id bigint, ref_no bigint, ref_shot_id string, start_ms bigint, end_ms bigint, has_features boolean")
    movies = spark.createDataFrame([(1, 1, "movie_shot_000002", 20_000, 21_500)], "project_id bigint, movie_no bigint, movie_shot_id string, start_ms bigint, end_ms bigint")
    cand = spark.createDataFrame(
        [(1, 0, 1, 1, 0.82, 0.6, 24, 40, 0.5, 0.5, 0.5, 0.0, False)],
        "project_id bigint, ref_no bigint, movie_no bigint, rank bigint, score double, geometry double, inliers bigint, good_matches bigint, local_score double, global_score double, fine_score double, support double, manual_override boolean",
    )
    rows = {r.ref_no: r for r in al.alignment_timeline(refs, movies, cand, P).collect()}
    assert (list(rows[0].movie_shot_ids), rows[0].movie_start_ms, rows[0].movie_end_ms, rows[0].status, rows[0].confidence) == (["movie_shot_000002"], 20_000, 21_500, "matched", "high")
    assert (rows[1].status, rows[2].status) == ("localization_failed", "missing_reference_clip")


def test_real_audio_lengths_reflow_the_tracks(spark):
    items = spark.createDataFrame([(1, 1, 5_000, False, "a"), (1, 2, 2_000, False, "b")], "project_id bigint, item_no bigint, audio_ms bigint, is_original boolean, audio_path string")
    clips = spark.createDataFrame([(1, 1, 1, "film", 0, 10_000), (1, 2, 1, "film", 10_000, 12_000)], "project_id bigint, item_no bigint, clip_no bigint, source string, start_ms bigint, end_ms bigint")
    media = spark.createDataFrame([(1, "film", 60_000)], "project_id bigint, source string, duration_ms bigint")
    video = bd.edit_tracks(items, clips, media, P).video.orderBy("item_no").collect()
    assert [r.target_start_us for r in video] == [0, 5_000_000]
    assert sum(r.duration_us for r in video) == 7_000_000


def test_positions_and_samples(spark):
    shots = spark.createDataFrame([(1, 0, 3_000)], "shot_no bigint, start_ms bigint, end_ms bigint")
    assert sh.clean_positions(".12,.5,.88") == [0.12, 0.5, 0.88]
    assert [r.frame for r in sh.keyframe_times(shots, sh.position_array(F.lit(".12,.5,.88")), 10.0).orderBy("time_ms").collect()] == [4, 15, 26]
    assert sh.sample_times(shots, 2.0, 4).count() == 4
    assert sh.position_array is not None and sh.clean_positions("") == [0.2, 0.4, 0.6, 0.8]


def test_scenes_of_all_above_and_single_frame_media(spark):
    rows = [(1, 0, 0.9), (1, 1, 0.9), (2, 0, 0.1)]
    probs = spark.createDataFrame(rows, "m bigint, frame_idx bigint, p double")
    scenes = sh.probs_to_scenes(probs, ["m"], above=F.col("p") > 0.5, width=1)
    assert sorted((r.m, r.start_frame, r.end_frame) for r in scenes.collect()) == [(1, 0, 1), (2, 0, 0)]
