"""Text and time-code functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recut.functions import media as fx
from recut.functions import text as tx
from recut.functions.udfs import nfkc
from recut.queries.domain import CLIPS_SQL, INTERVALS_SQL
from recut.queries.registry import ctes, query


@query(
    "srt_times",
    "P1",
    ctes(INTERVALS_SQL)
    + """,
m AS (SELECT event_id, start_ms * 7 - 1000 AS ms FROM intervals), c AS (SELECT event_id, greatest(ms, 0) AS ms FROM m)
SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp, ms AS parsed_ms FROM c
""",
)
def _(t):
    stamped = t.intervals.select("event_id", tx.format_srt_time(F.col("start_ms") * 7 - 1_000).alias("stamp"))
    return stamped.withColumn("parsed_ms", tx.parse_srt_time(F.replace("stamp", F.lit(","), F.lit("."))))


@query(
    "lrc_and_ass_times",
    "P2",
    ctes(INTERVALS_SQL)
    + """,
h AS (SELECT event_id, start_ms AS ms, CAST(floor((start_ms % 60000) / 10.0::DOUBLE + 0.5) AS BIGINT) AS hs FROM intervals)
SELECT event_id, printf('[%02d:%d.%02d]', ms // 60000, hs // 100, hs % 100) AS lrc, printf('%d:%02d:%02d.%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000 // 10) AS ass, ms // 10 * 10 AS ass_ms FROM h
""",
)
def _(t):
    rows = t.intervals.select("event_id", tx.format_lrc_time(F.col("start_ms")).alias("lrc"), tx.format_ass_time(F.col("start_ms")).alias("ass"))
    return rows.withColumn("ass_ms", tx.parse_ass_time(F.col("ass")))


@query(
    "normalized_texts",
    "P3 P4",
    """
SELECT doc_id, md5(regexp_replace(lower(nfc_normalize(text)), '[^\\p{L}\\p{N}]', '', 'g')) AS alnum_md5, md5(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}_]+', '', 'g')) AS words_md5 FROM documents
""",
)
def _(t):
    return t.documents.select("doc_id", F.md5(tx.keep_alnum(nfkc("text"))).alias("alnum_md5"), F.md5(tx.norm_words(F.col("text"))).alias("words_md5"))


@query(
    "speech_estimates",
    "P5 P6 P7",
    """
WITH u AS (SELECT doc_id, text, greatest(1, length(regexp_replace(text, '[\\s，。！？、,.!?;；:："''“”‘’（）()\\[\\]【】]', '', 'g'))) AS units FROM documents)
SELECT doc_id, units AS text_units, greatest(1200, CAST(floor(units * 1000 / 4.2::DOUBLE + 0.5) AS BIGINT)) AS tts_ms, length(regexp_replace(text, '\\s+', '', 'g')) AS char_count FROM u
""",
)
def _(t):
    text = F.col("text")
    return t.documents.select("doc_id", tx.text_units(text).alias("text_units"), tx.tts_ms(text, 4.2, 1_200).alias("tts_ms"), tx.char_len(text).alias("char_count"))


@query(
    "audio_modes",
    "P20 P22 P24 P9",
    ctes(CLIPS_SQL)
    + """,
a AS (SELECT *, CASE part_no % 5 WHEN 0 THEN 'play_original_audio' WHEN 1 THEN 'play_original_audio_low_volume' WHEN 2 THEN 'keep_original_audio' WHEN 3 THEN 'manual_review' ELSE NULL END AS act,
   CASE part_no % 3 WHEN 0 THEN 'narration' WHEN 1 THEN 'original_dialogue' ELSE '' END AS role FROM clips),
k AS (SELECT *, CASE WHEN flag = 'A' THEN 'original' WHEN line_status = 'F' THEN 'reference' ELSE 'narration' END AS kind FROM a)
SELECT item_no, clip_no, CASE WHEN act IN ('play_original_audio', 'keep_original_audio') THEN 'original' WHEN act = 'play_original_audio_low_volume' THEN 'mixed' ELSE 'voiceover' END AS mode,
  CASE WHEN act = 'play_original_audio' THEN 'original' WHEN act = 'play_original_audio_low_volume' THEN 'mixed' ELSE 'voiceover' END AS strict_mode,
  kind, kind = 'narration' AND part_no % 7 <> 0 AS needs_tts, role IN ('narration', '') AND coalesce(act, 'rewrite') NOT IN ('play_original_audio', 'manual_review') AS narration_unit,
  role = 'original_dialogue' OR coalesce(act = 'play_original_audio', false) AS original_unit, CAST(floor(start_ms / 1000.0::DOUBLE * 1000000 + 0.5) AS BIGINT) AS start_us FROM k
""",
)
def _(t):
    k = F.col("part_no")
    action = F.when(k % 5 == 0, "play_original_audio").when(k % 5 == 1, "play_original_audio_low_volume").when(k % 5 == 2, "keep_original_audio").when(k % 5 == 3, "manual_review")
    role = F.when(k % 3 == 0, "narration").when(k % 3 == 1, "original_dialogue").otherwise("")
    audio_type = F.when((F.col("flag") != "A") & (F.col("line_status") == "F"), "Reference_Audio")
    kind = fx.item_audio_kind(audio_type, F.col("flag") == "A", F.lit(False))
    return t.clips.select(
        "item_no", "clip_no", fx.audio_mode(action).alias("mode"), fx.audio_mode(action, strict=True).alias("strict_mode"), kind.alias("kind"),
        fx.needs_tts(kind, F.when(k % 7 != 0, "words").otherwise(" ")).alias("needs_tts"), fx.is_narration_unit(role, action).alias("narration_unit"),
        fx.is_original_unit(role, action).alias("original_unit"), fx.sec_to_us(F.col("start_ms") / 1_000).alias("start_us"),
    )
