"""Files in and out: subtitles, stage documents, probes, overrides, transcripts, model answers.

The files are rendered from the given tables by the sinks and read back by the sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recut.functions.text import format_srt_time
from recut.operators.ordered import TIME_SLICE_MS, position, scan
from recut.queries.domain import INTERVALS_SQL, REF_SHOTS_SQL, SUBTITLES_SQL
from recut.queries.registry import ctes, query
from recut.sinks import subtitles as out
from recut.sources import documents as docs
from recut.sources import subtitles as src
from recut.sources.frames import frame_features

MEDIA = ctes(INTERVALS_SQL, REF_SHOTS_SQL, SUBTITLES_SQL)
ORDER = ["start_ms", "sub_no"]
NUMBERED = """,
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, sub_no) AS idx FROM subtitles)
"""


def _path(suffix):
    return F.concat(F.lit("/catalogue/"), F.col("media_id").cast("string"), F.lit(suffix)).alias("path")


def _srt_files(t, suffix=".srt"):
    """Every ninth text is blank: the writer skips it but its number stays used."""
    spoken = t.subtitles.withColumn("text", F.when(F.col("sub_no") % 9 == 0, " ").otherwise(F.col("text")))
    files = out.join_blocks(out.srt_blocks(spoken, ["media_id"], ORDER), ["media_id"])
    crlf = F.when(F.col("media_id") % 2 == 0, F.concat(F.lit("﻿"), F.replace("content", F.lit("\n"), F.lit("\r\n")))).otherwise(F.col("content"))
    return files.select(_path(suffix), crlf.alias("content"))


@query(
    "srt_blocks",
    "B2",
    MEDIA
    + """,
n AS (SELECT media_id, text, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, sub_no) AS block_no, start_ms AS a, end_ms AS b FROM subtitles WHERE sub_no % 9 <> 0)
SELECT media_id, block_no, block_no || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10) AS block FROM n
""",
)
def _(t):
    spoken = t.subtitles.withColumn("text", F.when(F.col("sub_no") % 9 == 0, " ").otherwise(F.col("text")))
    return out.srt_blocks(spoken, ["media_id"], ORDER, gaps=False)


@query(
    "srt_round_trip",
    "A3 B2",
    MEDIA
    + """,
n AS (SELECT * FROM subtitles WHERE sub_no % 9 <> 0)
SELECT '/catalogue/' || media_id || '.srt' AS path, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, sub_no) AS idx, start_ms, end_ms, text FROM n
""",
)
def _(t):
    return src.parse_srt(_srt_files(t))


@query(
    "compressed_round_trip",
    "A4 B5",
    MEDIA
    + """,
n AS (SELECT * FROM subtitles WHERE sub_no % 9 <> 0)
SELECT '/catalogue/' || media_id || '.srt' AS path, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, sub_no) AS idx, start_ms, end_ms, text FROM n
""",
)
def _(t):
    lines = out.compress_srt(_srt_files(t))
    files = out.join_blocks(lines, ["path"])
    return src.parse_compressed(files)


@query(
    "mixed_compressed_lines",
    "A4",
    MEDIA
    + """,
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, sub_no) AS rn FROM subtitles)
SELECT '/catalogue/' || media_id || '.srt' AS path, rn * 2 AS idx, start_ms, end_ms, text FROM n
""",
)
def _(t):
    numbered = scan(t.subtitles, ["media_id"], ORDER, [position("block_no")], width=TIME_SLICE_MS)
    dash = F.concat_ws(" - ", format_srt_time(F.col("start_ms")), format_srt_time(F.col("end_ms")))
    lines = numbered.select("media_id", "block_no", F.concat(F.lit("a stray line\n  ["), dash, F.lit("]  "), "text", F.lit(" ")).alias("block"))
    return src.parse_srt(out.join_blocks(lines, ["media_id"]).select(_path(".srt"), "content"))


@query(
    "strict_srt_round_trip",
    "A5",
    MEDIA
    + """
SELECT '/catalogue/' || media_id || '.srt' AS path, start_ms, end_ms, text || chr(10) || 'second line' AS text FROM subtitles
""",
)
def _(t):
    doubled = t.subtitles.withColumn("text", F.concat("text", F.lit("\nsecond line")))
    files = out.join_blocks(out.srt_blocks(doubled, ["media_id"], ORDER), ["media_id"]).select(_path(".srt"), "content")
    return src.parse_srt_strict(files).drop("idx")


def _vtt_stamp(c):
    return F.replace(format_srt_time(F.col(c)), F.lit(","), F.lit("."))


def _vtt_files(t):
    numbered = scan(t.subtitles, ["media_id"], ORDER, [position("block_no")], width=TIME_SLICE_MS)
    times = F.concat(_vtt_stamp("start_ms"), F.lit(" --> "), _vtt_stamp("end_ms"), F.lit(" align:start"))
    text = F.concat(F.lit("<"), _vtt_stamp("start_ms"), F.lit(">"), F.split("text", "-")[0], F.lit("-"), F.split("text", "-")[1], F.lit("\nshadow"))
    blocks = numbered.select("media_id", "block_no", F.concat(times, F.lit("\n"), text).alias("block"))
    return out.join_blocks(blocks, ["media_id"], "\n\n").select(_path(".vtt"), F.concat(F.lit("WEBVTT\n\nNOTE made here\n\n"), "content").alias("content"))


@query("vtt_round_trip", "A6", MEDIA + NUMBERED + "SELECT '/catalogue/' || media_id || '.vtt' AS path, idx, start_ms, end_ms, text FROM n")
def _(t):
    return src.parse_vtt(_vtt_files(t))


@query(
    "word_vtt_round_trip",
    "A7",
    MEDIA
    + NUMBERED
    + """,
m AS (SELECT *, (start_ms + end_ms) // 2 AS mid, split_part(text, '-', 1) AS w1, split_part(text, '-', 2) AS w2 FROM n)
SELECT '/catalogue/' || media_id || '.vtt' AS path, idx AS block_no, 0 AS idx, start_ms, mid AS end_ms, w1 AS text FROM m
UNION ALL SELECT '/catalogue/' || media_id || '.vtt', idx, 1, mid, end_ms, w2 FROM m
""",
)
def _(t):
    numbered = scan(t.subtitles, ["media_id"], ORDER, [position("block_no")], width=TIME_SLICE_MS)
    middle = numbered.withColumn("mid", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    times = F.concat(_vtt_stamp("start_ms"), F.lit(" --> "), _vtt_stamp("end_ms"))
    words = F.concat(F.split("text", "-")[0], F.lit("<"), _vtt_stamp("mid"), F.lit("><c> "), F.split("text", "-")[1], F.lit("</c>"))
    blocks = middle.select("media_id", "block_no", F.concat(times, F.lit("\nplain\n"), words).alias("block"))
    files = out.join_blocks(blocks, ["media_id"], "\n\n").select(_path(".vtt"), F.concat(F.lit("WEBVTT\n\n"), "content").alias("content"))
    return src.parse_word_vtt(files)


def _bilingual(t):
    return t.subtitles.withColumn("text", F.when(F.col("sub_no") % 3 == 0, F.concat("text", F.lit("\ntranslated"))).otherwise(F.col("text")))


@query(
    "ass_round_trip",
    "A8 B4 P2",
    MEDIA
    + """
SELECT media_id, start_ms // 10 * 10 AS start_ms, end_ms // 10 * 10 AS end_ms, CASE WHEN sub_no % 3 = 0 THEN 'translated' ELSE text END AS text FROM subtitles
UNION ALL SELECT media_id, start_ms // 10 * 10, end_ms // 10 * 10, text FROM subtitles WHERE sub_no % 3 = 0
""",
)
def _(t):
    files = out.ass_documents(out.ass_blocks(_bilingual(t), ["media_id"], ORDER, out.LAYOUTS[1]), ["media_id"])
    parsed = src.parse_ass(files.select(F.col("media_id").cast("string").alias("path"), "content"))
    return parsed.select(F.col("path").cast("bigint").alias("media_id"), "start_ms", "end_ms", "text")


@query(
    "ass_layouts_round_trip",
    "A8 B4",
    MEDIA
    + """
, l AS (SELECT *, sub_no % 3 = 0 AS two FROM subtitles)
SELECT media_id, 0 AS layout, start_ms // 10 * 10 AS start_ms, 'translated' AS text FROM l WHERE two
UNION ALL SELECT media_id, 0, start_ms // 10 * 10, text FROM l
UNION ALL SELECT media_id, 2, start_ms // 10 * 10, text FROM l
UNION ALL SELECT media_id, 3, start_ms // 10 * 10, CASE WHEN two THEN 'translated' ELSE text END FROM l
""",
)
def _(t):
    parts = []
    for layout in (0, 2, 3):
        files = out.ass_documents(out.ass_blocks(_bilingual(t), ["media_id"], ORDER, out.LAYOUTS[layout]), ["media_id"])
        parsed = src.parse_ass(files.select(F.col("media_id").cast("string").alias("path"), "content"))
        parts.append(parsed.select(F.col("path").cast("bigint").alias("media_id"), F.lit(layout).alias("layout"), "start_ms", "text"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "bilingual_json_round_trip",
    "A9 B3",
    MEDIA
    + NUMBERED
    + "SELECT media_id, idx, start_ms, end_ms, CASE WHEN sub_no % 3 = 0 THEN text || chr(10) || 'translated' ELSE text END AS text FROM n",
)
def _(t):
    files = out.bilingual_documents(out.bilingual_rows(_bilingual(t), ["media_id"], ORDER), ["media_id"])
    parsed = src.parse_bilingual_json(files.select(F.col("media_id").cast("string").alias("path"), "content"))
    return parsed.select(F.col("path").cast("bigint").alias("media_id"), "idx", "start_ms", "end_ms", "text")


@query(
    "lrc_and_txt_lines",
    "B3 P2",
    MEDIA
    + NUMBERED
    + """,
h AS (SELECT *, CAST(floor((start_ms % 60000) / 10.0::DOUBLE + 0.5) AS BIGINT) AS hs FROM n)
SELECT media_id, idx AS block_no, printf('[%02d:%d.%02d]', start_ms // 60000, hs // 100, hs % 100) || text AS lrc, text AS txt FROM h
""",
)
def _(t):
    lrc = out.lrc_blocks(t.subtitles, ["media_id"], ORDER).withColumnRenamed("block", "lrc")
    return lrc.join(out.txt_blocks(t.subtitles, ["media_id"], ORDER).withColumnRenamed("block", "txt"), ["media_id", "block_no"])


@query(
    "subtitle_file_dispatch",
    "A10",
    MEDIA
    + """
SELECT CASE media_id % 2 WHEN 0 THEN '.srt' ELSE '.vtt' END AS kind, media_id, count(*) AS entries, CAST(sum(start_ms) AS BIGINT) AS start_sum FROM subtitles WHERE media_id % 2 = 1 OR sub_no % 9 <> 0 GROUP BY ALL
""",
)
def _(t):
    media = F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("bigint")
    plain_srt = _srt_files(t, ".SRT").withColumn("content", src.plain(F.col("content")))
    files = plain_srt.where(media % 2 == 0).unionByName(_vtt_files(t).where(media % 2 == 1))
    parsed = src.parse_subtitle_files(files)
    kind = F.lower(F.regexp_extract("path", r"(\.\w+)$", 1)).alias("kind")
    return parsed.groupBy(kind, media.alias("media_id")).agg(F.count(F.lit(1)).alias("entries"), F.sum("start_ms").alias("start_sum"))


@query(
    "stage_document_round_trip",
    "A1 B1 P11",
    MEDIA
    + """
SELECT media_id, row_number() OVER w AS shot_no, CASE WHEN shot_no % 4 = 0 THEN printf('ref_shot_%03d', row_number() OVER w) ELSE 'shot-' || shot_no END AS shot_id, start_ms, end_ms,
  CASE WHEN shot_no % 3 = 0 THEN end_ms - start_ms ELSE 1500 END AS duration_ms FROM ref_shots WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, shot_no)
""",
)
def _(t):
    rows = t.ref_shots.select(
        F.col("media_id").cast("string").alias("project_id"), "shot_no",
        F.when(F.col("shot_no") % 4 == 1, F.concat(F.lit("shot-"), F.col("shot_no").cast("string"))).alias("ref_shot_id"),
        F.when(F.col("shot_no") % 4 != 0, F.concat(F.lit("shot-"), F.col("shot_no").cast("string"))).alias("shot_id"),
        (F.col("start_ms") / 1_000).alias("start"), (F.col("end_ms") / 1_000).alias("end"), F.when(F.col("shot_no") % 3 != 0, 1.5).alias("duration"),
    )
    documents = out.stage_documents(rows, ["project_id"], ["shot_no"], "ref_shots")
    shots = docs.stage_shots(docs.parse_stage(documents, "ref_shots"), "ref_shot_id", "ref_shot")
    return shots.select(F.col("project_id").cast("bigint").alias("media_id"), "shot_no", "shot_id", "start_ms", "end_ms", "duration_ms")


def _stage_rows(t, body):
    """Orders as the rows of a stage, a customer's orders as its project; line items as their nested parts."""
    part = F.struct(
        "l_linenumber",
        F.col("l_partkey").cast("string").alias("shot"),
        (F.col("l_quantity") / 8).alias("a"),
        (F.col("l_quantity") / 8 + F.col("l_linenumber")).alias("b"),
    )
    parts = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    rows = t.orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.col("o_orderkey").cast("string")
    return rows.select(F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderkey").alias("row_no"), *body(key))


def _stage_again(t, kind, body):
    """Rows written as one document to a project and read again."""
    written = out.stage_documents(_stage_rows(t, body), ["project_id"], ["row_no"], docs.STAGES[kind][0])
    return docs.parse_stage(written, kind)


def _each(make):
    return F.transform("parts", make)


def _clips(name):
    return _each(
        lambda p: F.struct(
            p["shot"].alias("clip_id"), p["a"].alias("movie_start"), p["b"].alias("movie_end"), F.array(p["shot"]).alias("movie_shot_ids")
        )
    ).alias(name)


STAGE_PARTS = """
WITH part AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_partkey AS VARCHAR) AS shot, l_quantity / 8 AS a, l_quantity / 8 + l_linenumber AS b,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), l_quantity) - 1 AS pos FROM lineitem),
o AS (SELECT CAST(o_custkey AS VARCHAR) AS project_id, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, o_orderpriority, o_totalprice FROM orders)
"""
STAGE_CLIPS = "pos, shot AS clip_id, a AS movie_start, b AS movie_end"
_CLIP_COLUMNS = ("clip_pos AS pos", "clip.clip_id", "clip.movie_start", "clip.movie_end")


def _exploded(rows, array, *columns):
    return rows.selectExpr("*", f"posexplode({array}) AS (clip_pos, clip)").selectExpr("project_id", *columns)


@query(
    "script_mapping_round_trip",
    "A1 B1",
    STAGE_PARTS
    + "SELECT project_id, id AS segment_id, o_orderpriority AS old_text, o_totalprice AS ref_end, pos, a AS range_start, shot AS ref_shot FROM o JOIN part ON k = o_orderkey",
)
def _(t):
    ranges = _each(lambda p: F.struct(p["a"].alias("start"), p["b"].alias("end"), p["shot"].alias("source_ref_shot_id")))
    whole = F.struct(F.lit(0.0).alias("start"), F.col("o_totalprice").alias("end"))
    rows = _stage_again(
        t, "script_mapping",
        lambda key: (key.alias("segment_id"), F.col("o_orderpriority").alias("old_text"), whole.alias("ref_time_range"), ranges.alias("movie_time_ranges")),
    )
    return _exploded(
        rows.withColumnRenamed("pos", "doc_pos"), "movie_time_ranges",
        "segment_id", "old_text", "ref_time_range.end AS ref_end", "clip_pos AS pos", "clip.start AS range_start", "clip.source_ref_shot_id AS ref_shot",
    )


@query(
    "rewritten_script_round_trip",
    "A1 B1",
    STAGE_PARTS
    + "SELECT project_id, id AS segment_id, 'new ' || o_orderpriority AS new_text, pos, shot AS unit_id, n % 2 = 0 AS keeps FROM o JOIN part ON k = o_orderkey",
)
def _(t):
    units = _each(lambda p: F.struct(p["shot"].alias("unit_id"), (p["l_linenumber"] % 2 == 0).alias("keep_original_audio")))
    rows = _stage_again(
        t, "rewritten_script", lambda key: (key.alias("segment_id"), F.concat(F.lit("new "), "o_orderpriority").alias("new_text"), units.alias("units"))
    )
    return _exploded(
        rows.withColumnRenamed("pos", "doc_pos"), "units", "segment_id", "new_text", "clip_pos AS pos", "clip.unit_id", "clip.keep_original_audio AS keeps"
    )


@query(
    "final_timeline_round_trip",
    "A1 B1",
    STAGE_PARTS + f"SELECT project_id, id AS item_id, o_orderpriority AS narration, o_totalprice AS timeline_end, {STAGE_CLIPS} FROM o JOIN part ON k = o_orderkey",
)
def _(t):
    rows = _stage_again(
        t, "final_timeline",
        lambda key: (key.alias("item_id"), F.col("o_orderpriority").alias("narration"), F.col("o_totalprice").alias("timeline_end"), _clips("video_clips")),
    )
    return _exploded(rows.withColumnRenamed("pos", "doc_pos"), "video_clips", "item_id", "narration", "timeline_end", *_CLIP_COLUMNS)


@query(
    "rebuild_timeline_round_trip",
    "A1 B1",
    STAGE_PARTS + f"SELECT project_id, id AS item_id, o_orderpriority AS warning, {STAGE_CLIPS} FROM o JOIN part ON k = o_orderkey",
)
def _(t):
    rows = _stage_again(
        t, "rebuild_timeline", lambda key: (key.alias("item_id"), F.array("o_orderpriority").alias("warnings"), _clips("video_clips"))
    )
    return _exploded(rows.withColumnRenamed("pos", "doc_pos"), "video_clips", "item_id", "warnings[0] AS warning", *_CLIP_COLUMNS)


@query(
    "breakdown_round_trip",
    "A1 B1",
    STAGE_PARTS
    + """SELECT project_id, id AS item_id, o_orderpriority AS narration, o_totalprice AS movie_end, o_orderkey % 2 = 0 AS is_original_play,
  (SELECT count(*) FROM part WHERE k = o_orderkey) AS shots, row_number() OVER (PARTITION BY project_id ORDER BY o_orderkey) - 1 AS pos FROM o
WHERE o_orderkey IN (SELECT k FROM part)""",
)
def _(t):
    rows = _stage_again(
        t, "shot_breakdown",
        lambda key: (
            key.alias("item_id"), F.col("o_orderpriority").alias("narration"), F.col("o_totalprice").alias("movie_end"),
            (F.col("o_orderkey") % 2 == 0).alias("is_original_play"), F.col("parts.shot").alias("movie_shot_ids"),
        ),
    )
    return rows.select("project_id", "item_id", "narration", "movie_end", "is_original_play", F.size("movie_shot_ids").alias("shots"), "pos")


@query(
    "tolerant_overrides",
    "A2 A14",
    """
WITH r AS (SELECT o_custkey AS project_id, o_orderkey % 3 AS ref, o_orderkey AS k FROM orders),
l AS (SELECT project_id, ref, max(k) FILTER (WHERE k % 5 <> 0) AS k FROM r GROUP BY ALL)
SELECT project_id, CASE WHEN project_id % 2 = 0 THEN 'C:\\movie' || ref ELSE 'ref' || ref END AS ref_shot_id, 'm' || k AS movie_shot_id FROM l WHERE k IS NOT NULL
""",
)
def _(t):
    name = F.when(F.col("o_custkey") % 2 == 0, F.lit("C:\\movie")).otherwise(F.lit("ref"))
    movie = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit(', "movie_shot_id": "m'), F.col("o_orderkey").cast("string"), F.lit('"'))).otherwise("")
    rows = t.orders.select(
        F.col("o_custkey").alias("project_id"), "o_orderkey",
        F.concat(F.lit('{"ref_shot_id": "'), name, (F.col("o_orderkey") % 3).cast("string"), F.lit('"'), movie, F.lit("}")).alias("j"),
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "j"))), lambda r: r.j), ", ")
    wrapped = F.when(F.col("project_id") % 3 == 0, F.concat(F.lit("﻿ ["), "l", F.lit("]"))).otherwise(F.concat(F.lit('{"overrides": ['), "l", F.lit("]}")))
    documents = rows.groupBy("project_id").agg(listed.alias("l")).select("project_id", wrapped.alias("content"))
    return docs.parse_overrides(documents)


@query(
    "media_probes",
    "A12",
    """
SELECT o_orderkey AS media_id, CAST(floor(CASE o_orderkey % 4 WHEN 0 THEN 24000.0::DOUBLE / 1001 WHEN 1 THEN 30 ELSE 25 END * 1000 + 0.5) AS BIGINT) AS fps_e3,
  CAST(floor(o_totalprice * 1000 + 0.5) AS BIGINT) AS duration_ms, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice * 1000 + 0.5) AS BIGINT) ELSE o_orderkey * 1000 + 500 END AS video_ms,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice * 1000 + 0.5) AS BIGINT) ELSE 12250 END AS audio_ms FROM orders
""",
)
def _(t):
    k = F.col("o_orderkey")
    rate = F.when(k % 4 == 0, "24000/1001").when(k % 4 == 1, "30").when(k % 4 == 2, "0/0").otherwise("25/1")
    video = F.when(k % 3 == 0, "N/A").otherwise(F.concat(k.cast("string"), F.lit(".5")))
    audio = F.when(k % 2 == 0, "").otherwise(', {"codec_type": "audio", "duration": "12.25"}, {"codec_type": "audio", "duration": "3"}')
    content = F.concat(
        F.lit('{"streams": [{"codec_type": "video", "duration": "'), video, F.lit('", "avg_frame_rate": "'), rate, F.lit('"}'), audio,
        F.lit('], "format": {"duration": "'), F.col("o_totalprice").cast("string"), F.lit('"}}'),
    )
    probed = docs.parse_media_probe(t.orders.select(k.alias("media_id"), content.alias("content")))
    return probed.select("media_id", F.floor(F.col("fps") * 1_000 + 0.5).cast("bigint").alias("fps_e3"), "duration_ms", "video_ms", "audio_ms")


@query(
    "model_answers",
    "A15",
    "SELECT o_orderkey AS seg_no, o_orderpriority AS new_text, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey END AS score FROM orders WHERE o_orderkey % 4 <> 3",
)
def _(t):
    body = F.to_json(F.struct(F.col("o_orderpriority").alias("new_text"), F.col("o_orderkey").alias("score")))
    k = F.col("o_orderkey")
    said = (
        F.when(k % 4 == 0, F.concat(F.lit("Sure!\n```json\n"), body, F.lit("\n```\nBye")))
        .when(k % 4 == 1, F.concat(F.lit("Answer: "), body, F.lit(" as asked")))
        .when(k % 4 == 2, F.concat(F.lit("  "), body)).otherwise("no answer")
    )
    parsed = docs.parse_model_answers(t.orders.select(k.alias("seg_no"), said.alias("content")), "struct<new_text:string,score:bigint>")
    return parsed.where("parsed.new_text is not null").select("seg_no", "parsed.*")


@query(
    "ingested_utterances",
    "A11",
    ctes(INTERVALS_SQL)
    + """
SELECT media_id, event_id, start_ms + (event_id % 5) * 300000 AS start_ms, end_ms + (event_id % 5) * 300000 AS end_ms, event_type AS text FROM intervals WHERE event_id % 7 <> 0 AND end_ms > start_ms
""",
)
def _(t):
    rows = t.intervals.select(
        "media_id", "event_id", (F.col("event_id") % 5).alias("chunk_id"), "start_ms", "end_ms",
        F.when(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 7 != 0, F.col("event_type")).otherwise(" ")).alias("text"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit(" "), "event_type")).alias("transcript"),
    )
    chunks = t.intervals.select("media_id", (F.col("event_id") % 5).alias("chunk_id")).distinct().withColumn("start_ms", F.col("chunk_id") * 300_000)
    return docs.ingest_utterances(rows, chunks).select("media_id", "event_id", "start_ms", "end_ms", "text")


@query("frame_descriptors", "J27 A13 P27")
def _(t):
    """Page bytes taken as small colour images, the last row filled up with black."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / 48)).cast("int")
    images = t.pages.select(
        F.col("page_id").cast("string").alias("origin"), rows.alias("height"), F.lit(16).alias("width"), F.lit(3).alias("nChannels"), raw.alias("bytes")
    ).select("origin", "height", "width", "nChannels", F.expr("rpad(bytes, height * 48, X'00')").alias("data"))
    found = frame_features(images)
    return found.select("origin", F.size("descriptor").alias("dims"), "dhash", F.aggregate("hist", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("pixels"))
