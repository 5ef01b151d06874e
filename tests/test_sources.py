"""Subtitle files, GBK bytes, JSON repair, images and text similarity on awkward inputs."""

from __future__ import annotations

import struct
import zlib
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from recut.functions import text as tx
from recut.functions.udfs import nfkc, sequence_ratio
from recut.operators import dialogue as dg
from recut.operators import transcripts as tr
from recut.sinks import subtitles as out
from recut.sources import documents as docs
from recut.sources import subtitles as src
from recut.sources.frames import frame_features, read_frames


def test_srt_edges(spark):
    content = "﻿1\r\n00:00:01.500 --> 00:00:02,000 align:left\r\nHello\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n \r\n\r\nno timing here\r\n\r\n00:00:05,000 --> 00:00:06,250\r\nlast"
    rows = src.parse_srt(spark.createDataFrame([("a.srt", content)], "path string, content string")).orderBy("idx").collect()
    assert [(r.idx, r.start_ms, r.end_ms, r.text) for r in rows] == [(1, 1_500, 2_000, "Hello there"), (4, 5_000, 6_250, "last")]


def test_compressed_lines_win_over_blocks(spark):
    content = "1\n00:00:01,000 --> 00:00:02,000\nblock\n\n[00:00:03,000 - 00:00:04,000]  line "
    rows = src.parse_srt(spark.createDataFrame([("a.srt", content)], "path string, content string")).collect()
    assert [(r.idx, r.start_ms, r.text) for r in rows] == [(4, 3_000, "line")]


def test_gbk_files_are_read(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\n你好".encode("gbk"))
    (tmp_path / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\n再见", encoding="utf-8")
    assert sorted(r.text for r in src.read_subtitle_files(spark, str(tmp_path)).collect()) == sorted(["你好", "再见"])
    assert src.read_srt(spark, str(tmp_path)).count() == 2


def test_numbering_gaps_and_layouts(spark):
    rows = spark.createDataFrame([(1, 1, 0, 1_000, "a\nb"), (1, 2, 1_000, 2_000, " "), (1, 3, 2_000, 3_000, "c")], "m bigint, n bigint, start_ms bigint, end_ms bigint, text string")
    assert [r.block_no for r in out.srt_blocks(rows, ["m"], ["n"], width=1).orderBy("block_no").collect()] == [1, 3]
    counts = [out.ass_blocks(rows.where("n <> 2"), ["m"], ["n"], layout).count() for layout in out.LAYOUTS]
    assert counts == [3, 3, 2, 2]


def test_blocks_written_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(m, n, n * 1_000, n * 1_000 + 500, f"t{n}") for m in (1, 2) for n in range(20)], "m bigint, n bigint, start_ms bigint, end_ms bigint, text string")
    out.write_blocks(out.srt_blocks(rows, ["m"], ["n"], width=3), ["m"], str(tmp_path / "out"))
    assert src.read_srt(spark, str(tmp_path / "out" / "m=1")).count() == 20


def test_lone_backslashes(spark):
    text = r'{"overrides": [{"ref_shot_id": "a\q\\n", "movie_shot_id": "C:\movie"}]}'
    row = docs.parse_overrides(spark.createDataFrame([("p", text)], "project_id string, content string")).first()
    assert (row.ref_shot_id, row.movie_shot_id) == ("a\\q\\n", "C:\\movie")


def test_sequence_ratio_is_the_matching_block_ratio(spark):
    pairs = [("abcdef", "abxdef"), ("", "a"), ("tide", "diet"), ("diet", "tide"), ("a" * 250 + "b", "b" + "a" * 250)]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("r", sequence_ratio("a", "b")).collect()
    assert all(r.r == (SequenceMatcher(None, r.a, r.b).ratio() if r.a and r.b else 0.0) for r in rows)


def test_text_of_punctuation_only(spark):
    row = spark.createDataFrame([("，。 ！",)], "t string").select(
        tx.text_units(F.col("t")).alias("u"), tx.tts_ms(F.col("t"), 4.2, 1_200).alias("s"), tx.keep_alnum(nfkc(F.lit("ＡＢ①"))).alias("n")
    ).first()
    assert (row.u, row.s, row.n) == (1, 1_200, "ab1")


def test_echo_in_the_next_chunk_is_dropped(spark):
    rows = [(1, i, i * 2_000, i * 2_000 + 1_500, t) for i, t in enumerate(["good morning all", "where are you", "Where are you?", "elsewhere", "where are you"])]
    df = spark.createDataFrame(rows, "media_id bigint, utt_no bigint, start_ms bigint, end_ms bigint, text string")
    for width in (1_000, 10_000_000):
        kept = [r.utt_no for r in tr.dedupe_utterances(df, ["media_id"], width=width).orderBy("utt_no").collect()]
        assert kept == [0, 1, 3, 4]


def test_text_rules(spark):
    units = spark.createDataFrame([(1, 1, 1, 0, 1_000, "To be or not to be"), (1, 1, 2, 1_000, 2_000, "Here he walks in")], "project_id bigint, seg_no bigint, unit_pos bigint, unit_start_ms bigint, unit_end_ms bigint, text string")
    ranges = spark.createDataFrame([(1, 1, 1, 11), (1, 1, 2, 12), (1, 1, 3, 13)], "project_id bigint, seg_no bigint, range_pos bigint, source_ref_shot bigint")
    subs = spark.createDataFrame([(1, 1, 1, 1, "to be, or NOT to be!"), (1, 1, 2, 1, "zzz qqq")], "project_id bigint, seg_no bigint, range_pos bigint, sub_no bigint, text string")
    shots = spark.createDataFrame([(1, 11, 0, 1_000), (1, 12, 1_000, 2_000), (1, 13, 5_000, 6_000)], "project_id bigint, shot_no bigint, start_ms bigint, end_ms bigint")
    rules = dg.classify_by_text(units, ranges, subs, shots, ["project_id"])
    by_range = {r.range_pos: (r.audio_role, r.audio_confidence) for r in rules.ranges.collect()}
    assert by_range[1] == ("original_dialogue", 0.99) and by_range[2][0] == "narration_overlay" and by_range[3] == ("narration_overlay", 0.9)
    by_unit = {r.unit_pos: (r.role, len(r.matched_movie_subtitles)) for r in rules.units.collect()}
    assert by_unit == {1: ("original_dialogue", 1), 2: ("narration", 0)}
    assert rules.segments.first().segment_audio_role == "mixed"


def _png(width: int, height: int, rgb: tuple[int, int, int]) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(c * (x + 1) // width for x in range(width) for c in rgb) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_features(spark, tmp_path):
    for name, rgb in (("a", (200, 40, 40)), ("b", (200, 40, 40)), ("c", (10, 10, 220))):
        (tmp_path / f"{name}.png").write_bytes(_png(64, 36, rgb))
    rows = {r.origin[-5]: r for r in frame_features(read_frames(spark, str(tmp_path))).collect()}
    assert all(len(r.descriptor) == 2_176 for r in rows.values())
    dot = lambda x, y: sum(p * q for p, q in zip(rows[x].descriptor, rows[y].descriptor, strict=True))
    assert dot("a", "b") > 0.999 and rows["a"].dhash == rows["b"].dhash == -1
    assert abs(dot("a", "a") - 1.0) < 1e-3
