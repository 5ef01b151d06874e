"""Transcripts, rewriting and dialogue rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from recut.operators import audio as au
from recut.operators import dialogue as dg
from recut.operators import rewrite as rw
from recut.operators import transcripts as tr
from recut.operators.wordbags import similar_texts
from recut.queries.domain import AUDIO_RANGES_SQL, CLIPS_SQL, INTERVALS_SQL, REF_SHOTS_SQL, SUBTITLES_SQL
from recut.queries.registry import ctes, query
from recut.session import cut_lineage

MEDIA = ctes(INTERVALS_SQL, REF_SHOTS_SQL, SUBTITLES_SQL)


@query(
    "chunk_plans",
    "W18",
    """
WITH RECURSIVE m AS (SELECT o_orderkey AS media_id, CAST(floor(o_totalprice * 10 + 0.5) AS BIGINT) AS n FROM orders WHERE floor(o_totalprice * 10 + 0.5) > 0),
c AS (SELECT media_id, n, 1 AS i, 0::BIGINT AS s, CASE WHEN n <= 420000 THEN n ELSE 300000 END AS e FROM m
  UNION ALL SELECT media_id, n, i + 1, e, CASE WHEN n - e BETWEEN 120000 AND 420000 THEN n ELSE least(e + 300000, n) END FROM c WHERE e < n),
k AS (SELECT *, count(*) OVER (PARTITION BY media_id) AS cnt FROM c)
SELECT media_id, printf('chunk_%04d', i) AS chunk_id, s AS core_start_ms, e AS core_end_ms, greatest(0, s - CASE WHEN i > 1 THEN 30000 ELSE 0 END) AS start_ms, least(n, e + CASE WHEN i < cnt THEN 30000 ELSE 0 END) AS end_ms FROM k
""",
)
def _(t):
    media = t.orders.select(F.col("o_orderkey").alias("media_id"), F.floor(F.col("o_totalprice") * 10 + 0.5).cast("bigint").alias("duration_ms"))
    return tr.plan_chunks(media, ["media_id"])


def _utterances(t):
    """Conversation turns, each heard a second time a little later in an overlapping chunk."""
    turns = t.conversations.select(
        F.col("conv_id").alias("media_id"), (F.col("turn") * 2).alias("utt_no"), (F.col("turn") * 5_000).alias("start_ms"), (F.col("turn") * 5_000 + 4_000).alias("end_ms"), "text"
    )
    echo = turns.where("utt_no % 4 = 0").select("media_id", (F.col("utt_no") + 1).alias("utt_no"), (F.col("start_ms") + 600).alias("start_ms"), (F.col("end_ms") + 600).alias("end_ms"), F.upper("text").alias("text"))
    return turns.unionByName(echo)


@query("deduplicated_utterances", "F22 J22 P4")
def _(t):
    return tr.dedupe_utterances(_utterances(t), ["media_id"]).select("media_id", "utt_no", "start_ms", "end_ms")


@query("merged_chunk_transcripts", "F23 A11 W18")
def _(t):
    rows = _utterances(t).select(
        "media_id", "utt_no", F.floor(F.col("start_ms") / 10_000).alias("chunk_id"), (F.col("start_ms") % 10_000).alias("start_ms"),
        (F.col("end_ms") - F.floor(F.col("start_ms") / 10_000) * 10_000).alias("end_ms"), F.lit(None).cast("string").alias("text"), F.col("text").alias("transcript"),
    )
    chunks = rows.select("media_id", "chunk_id").distinct().withColumn("start_ms", F.col("chunk_id") * 10_000)
    return tr.merge_chunk_transcripts(rows, chunks, ["media_id"]).select("media_id", "utt_no", "start_ms", "end_ms")


NUMBERED = """,
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, sub_no) AS idx FROM subtitles)
"""


def _numbered(t):
    from recut.operators.ordered import TIME_SLICE_MS, position, scan

    return scan(t.subtitles, ["media_id"], ["start_ms", "sub_no"], [position("idx")], width=TIME_SLICE_MS)


@query(
    "merged_segments",
    "F24",
    MEDIA
    + NUMBERED
    + """,
h AS (SELECT *, CASE WHEN idx % 10 IN (3, 4, 5) THEN idx - idx % 10 + 3 ELSE idx END AS head FROM n)
SELECT media_id, head AS idx, min_by(start_ms, idx) AS start_ms, max_by(end_ms, idx) AS end_ms, string_agg(text, '' ORDER BY idx) AS text FROM h GROUP BY media_id, head
""",
)
def _(t):
    rows = _numbered(t)
    spans = rows.where("idx % 10 = 3").select("media_id", F.col("idx").alias("from_idx"), (F.col("idx") + 2).alias("to_idx"))
    return tr.merge_segments(rows, spans, ["media_id"])


@query(
    "merged_with_next",
    "F24",
    MEDIA
    + NUMBERED
    + """,
l AS (SELECT *, lead(text) OVER w AS nt, lead(end_ms) OVER w AS ne FROM n WINDOW w AS (PARTITION BY media_id ORDER BY idx))
SELECT media_id, idx, start_ms, CASE WHEN idx % 6 = 2 AND nt IS NOT NULL THEN ne ELSE end_ms END AS end_ms, CASE WHEN idx % 6 = 2 AND nt IS NOT NULL THEN text || ' ' || nt ELSE text END AS text FROM l WHERE idx % 6 <> 3
""",
)
def _(t):
    rows = _numbered(t)
    picks = rows.where("idx % 6 = 2").select("media_id", F.col("idx").alias("pick_idx"))
    return tr.merge_with_next(rows, picks, ["media_id"])


@query(
    "word_level_transcripts",
    "G13",
    """
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.,]\\s')) AS w FROM documents),
s AS (SELECT doc_id, regexp_replace(w, '^\\s+|\\s+$', '', 'g') AS w FROM w)
SELECT doc_id, count(*) FILTER (WHERE (regexp_matches(w, '^[\\x00-\\x7F]+$') AND NOT regexp_matches(w, '\\s') AND w <> '') OR length(w) <= 2) * 5 >= count(*) * 4 AS is_word_level FROM s GROUP BY 1
""",
)
def _(t):
    parts = t.documents.select("doc_id", F.explode(F.split("text", r"[.,]\s", -1)).alias("text"))
    return tr.is_word_level(parts, ["doc_id"])


def _segments(t):
    """Conversations as script segments, their turns as text units."""
    turns = t.conversations
    segments = turns.where("turn = 0").select(
        (F.col("conv_id") % 10).alias("project_id"), F.col("conv_id").alias("seg_no"), F.col("text").alias("old_text"), F.lit("narration").alias("text_role"),
        F.when(F.col("conv_id") % 6 == 0, "all_original_audio").otherwise("all_narration").alias("audio_pattern"),
    )
    units = turns.where("conv_id % 4 <> 0").select(
        (F.col("conv_id") % 10).alias("project_id"), F.col("conv_id").alias("seg_no"), F.col("turn").alias("unit_pos"),
        F.concat_ws("_", F.lit("unit"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("unit_id"), F.col("text").alias("old_text"),
        F.when(F.col("role") == "assistant", "original_dialogue").otherwise("narration").alias("role"),
        F.when(F.col("role") == "assistant", "play_original_audio").when(F.col("role") == "system", "manual_review").otherwise("rewrite").alias("action"),
    )
    return segments, units


SCRIPT_SQL = """
WITH s AS (SELECT conv_id % 10 AS project_id, conv_id AS seg_no, text AS old_text, CASE WHEN conv_id % 6 = 0 THEN 'all_original_audio' ELSE 'all_narration' END AS audio_pattern FROM conversations WHERE turn = 0),
u AS (SELECT conv_id % 10 AS project_id, conv_id AS seg_no, turn, 'unit_' || conv_id || '_' || turn AS unit_id, text, role FROM conversations WHERE conv_id % 4 <> 0),
"""
LEN_SQL = "length(regexp_replace({c}, '\\s+', '', 'g'))"


@query(
    "passthrough_script",
    "F25",
    SCRIPT_SQL
    + f"""
j AS (SELECT seg_no, string_agg(CASE WHEN role = 'user' THEN trim(text) ELSE '' END, '' ORDER BY turn) AS t FROM u GROUP BY 1),
x AS (SELECT s.*, CASE WHEN audio_pattern = 'all_original_audio' THEN '' ELSE coalesce(t, old_text) END AS nt FROM s LEFT JOIN j USING (seg_no))
SELECT seg_no, md5(nt) AS new_md5, {LEN_SQL.format(c="old_text")} AS old_char_count, {LEN_SQL.format(c="nt")} AS new_char_count, CASE WHEN audio_pattern = 'all_original_audio' THEN 'original_audio_skip' ELSE 'original' END AS rewrite_status FROM x
""",
)
def _(t):
    rows = rw.passthrough_rewrite(*_segments(t), ["project_id"])
    return rows.select("seg_no", F.md5("new_text").alias("new_md5"), "old_char_count", "new_char_count", "rewrite_status")


@query(
    "rewrite_request_batches",
    "F26",
    SCRIPT_SQL
    + """
a AS (SELECT project_id, seg_no, (row_number() OVER (PARTITION BY project_id ORDER BY seg_no) - 1) // 4 + 1 AS batch_no FROM s WHERE audio_pattern <> 'all_original_audio'),
k AS (SELECT seg_no, count(*) AS units FROM u WHERE role = 'user' GROUP BY 1)
SELECT project_id, batch_no, count(*) AS segment_count, CAST(coalesce(sum(units), 0) AS BIGINT) AS unit_count FROM a LEFT JOIN k USING (seg_no) GROUP BY ALL
""",
)
def _(t):
    batches = rw.request_batches(*_segments(t), ["project_id"], 4)
    parsed = F.from_json("payload", "struct<task:string,input:array<struct<seg_no:bigint,text_units:array<struct<unit_id:string>>>>>")
    units = F.aggregate(parsed["input"], F.lit(0).cast("bigint"), lambda n, i: n + F.coalesce(F.size(i.text_units), F.lit(0)))
    return batches.select("project_id", "batch_no", "segment_count", units.alias("unit_count"))


@query(
    "audio_request_batches",
    "F26 G8",
    ctes(CLIPS_SQL, AUDIO_RANGES_SQL)
    + """,
s AS (SELECT o_orderkey % 50 AS project_id, o_orderkey AS seg_no FROM orders),
b AS (SELECT project_id, seg_no, (row_number() OVER (PARTITION BY project_id ORDER BY seg_no) - 1) // 20 + 1 AS batch_no FROM s),
l AS (SELECT project_id, CAST(floor(sum(end_ms - start_ms) * 30 / 100) AS BIGINT) AS m, CAST(floor(count(*) * 30 / 100) AS BIGINT) AS c FROM audio_ranges GROUP BY 1),
k AS (SELECT seg_no, count(*) AS n FROM audio_ranges GROUP BY 1)
SELECT b.project_id, batch_no, count(*) AS segment_count, m AS max_original_ms, c AS max_original_clips, CAST(coalesce(sum(n), 0) AS BIGINT) AS clip_count FROM b JOIN l USING (project_id) LEFT JOIN k USING (seg_no) GROUP BY ALL
""",
)
def _(t):
    seg = ["project_id", "seg_no"]
    ranges = cut_lineage(t.audio_ranges)
    signals = au.smooth_roles(au.initial_signals(ranges, seg), seg)
    segments = t.orders.select((F.col("o_orderkey") % 50).alias("project_id"), F.col("o_orderkey").alias("seg_no"), F.lit("narration").alias("text_role"), F.col("o_orderpriority").alias("old_text"))
    batches = rw.audio_selection_payloads(segments, signals, au.budget_totals(ranges, ["project_id"]), ["project_id"], 20)
    parsed = F.from_json("payload", "struct<global_budget:struct<max_original_ms:bigint,max_original_clips:bigint>,segments:array<struct<clips:array<struct<clip_index:bigint>>>>>")
    clips = F.aggregate(F.col("p.segments"), F.lit(0).cast("bigint"), lambda n, s: n + F.coalesce(F.size(s.clips), F.lit(0)))
    return batches.withColumn("p", parsed).select("project_id", "batch_no", "segment_count", "p.global_budget.*", clips.alias("clip_count"))


def _answers(t):
    segments, units = _segments(t)
    said = units.where("unit_pos % 5 <> 4").select("project_id", "unit_id", F.concat(F.lit("new "), "unit_id").alias("new_text"))
    whole = segments.where("seg_no % 8 <> 0").select("project_id", "seg_no", F.concat(F.lit(" told "), F.col("seg_no").cast("string")).alias("new_text"))
    return rw.merge_rewrites(segments, units, said, whole, ["project_id"])


@query(
    "merged_rewrites",
    "F27",
    SCRIPT_SQL
    + """
j AS (SELECT seg_no, string_agg(CASE WHEN role = 'user' AND turn % 5 <> 4 THEN 'new ' || unit_id ELSE '' END, '' ORDER BY turn) AS t FROM u GROUP BY 1)
SELECT seg_no, CASE WHEN audio_pattern = 'all_original_audio' THEN '' WHEN seg_no % 4 <> 0 THEN t WHEN seg_no % 8 <> 0 THEN 'told ' || seg_no ELSE '' END AS new_text,
  CASE WHEN audio_pattern = 'all_original_audio' THEN 'original_audio_skip' ELSE 'ai_rewritten' END AS rewrite_status FROM s LEFT JOIN j USING (seg_no)
""",
)
def _(t):
    return _answers(t).segments.select("seg_no", "new_text", "rewrite_status")


@query(
    "missing_rewrites",
    "F27",
    SCRIPT_SQL
    + """
x AS (SELECT 1)
SELECT u.seg_no, unit_id AS missing_id FROM u JOIN s USING (seg_no) WHERE role = 'user' AND turn % 5 = 4 AND audio_pattern <> 'all_original_audio'
UNION ALL SELECT seg_no, 'seg_' || seg_no FROM s WHERE seg_no % 8 = 0 AND audio_pattern <> 'all_original_audio'
""",
)
def _(t):
    return _answers(t).missing.select("seg_no", "missing_id")


def _dialogue_inputs(t):
    """Conversations as segments: questions are reference units, answers are ranges with source subtitles."""
    turns = t.conversations.select(
        (F.col("conv_id") % 10).alias("project_id"), F.col("conv_id").alias("seg_no"), "turn", "role", "text", (F.col("conv_id") * 1_000 + F.col("turn")).alias("shot_no")
    )
    units = turns.where("turn % 2 = 0").select(
        "project_id", "seg_no", F.col("turn").alias("unit_pos"), (F.col("shot_no") * 1_000).alias("unit_start_ms"), (F.col("shot_no") * 1_000 + 1_200).alias("unit_end_ms"), "text"
    )
    ranges = turns.where("turn % 2 = 1").select("project_id", "seg_no", F.col("turn").alias("range_pos"), F.col("shot_no").alias("source_ref_shot"))
    shots = turns.select("project_id", "shot_no", (F.col("shot_no") * 1_000).alias("start_ms"), (F.col("shot_no") * 1_000 + F.when(F.col("turn") % 4 == 1, 900).otherwise(150)).alias("end_ms"))
    # Every third range repeats a question of its own conversation nearly word for word.
    asked = turns.where("turn % 2 = 0").select("project_id", "seg_no", (F.col("turn") + 1).alias("range_pos"), F.upper("text").alias("asked"))
    subtitles = turns.where("turn % 2 = 1").select("project_id", "seg_no", F.col("turn").alias("range_pos"), "text").join(asked, ["project_id", "seg_no", "range_pos"])
    subtitles = subtitles.select("project_id", "seg_no", "range_pos", F.lit(1).cast("bigint").alias("sub_no"), F.when(F.col("seg_no") % 3 == 0, F.col("asked")).otherwise(F.col("text")).alias("text"))
    return units, ranges, subtitles, shots


@query(
    "units_to_ranges",
    "J7",
    """
WITH t AS (SELECT conv_id AS seg_no, turn, conv_id * 1000 + turn AS k FROM conversations),
u AS (SELECT seg_no, turn AS unit_pos, k * 1000 AS a, k * 1000 + 1200 AS b FROM t WHERE turn % 2 = 0),
r AS (SELECT seg_no, turn AS range_pos, k * 1000 AS c, k * 1000 + CASE WHEN turn % 4 = 1 THEN 900 ELSE 150 END AS d FROM t WHERE turn % 2 = 1),
m AS (SELECT u.seg_no, range_pos, unit_pos FROM u JOIN r ON u.seg_no = r.seg_no AND a < d AND c < b)
SELECT * FROM m UNION ALL SELECT r.seg_no, r.range_pos, u.unit_pos FROM r JOIN u ON u.seg_no = r.seg_no WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.seg_no = r.seg_no AND m.range_pos = r.range_pos)
""",
)
def _(t):
    units, ranges, _, shots = _dialogue_inputs(t)
    return dg.units_to_ranges(units, ranges, shots, ["project_id"]).by_range.select("seg_no", "range_pos", "unit_pos")


@query("text_rule_ranges", "F19 J21 J22 P3")
def _(t):
    rules = dg.classify_by_text(*_dialogue_inputs(t), ["project_id"])
    return rules.ranges.select("seg_no", "range_pos", "audio_role", "audio_action", F.floor(F.col("audio_confidence") * 1_000 + 0.5).cast("bigint").alias("confidence_e3"))


@query("text_rule_units", "F20 F21")
def _(t):
    rules = dg.classify_by_text(*_dialogue_inputs(t), ["project_id"])
    return rules.units.select("seg_no", "unit_pos", "role", "action", F.size("matched_movie_subtitles").alias("matched"))


@query("text_rule_segments", "F21 G5")
def _(t):
    return dg.classify_by_text(*_dialogue_inputs(t), ["project_id"]).segments.select("seg_no", "segment_audio_role")


@query(
    "benchmark_text_similarity",
    "J22 J21",
    """
WITH x AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark),
y AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
a AS (SELECT item_id, w, count(*) AS c FROM x GROUP BY ALL), b AS (SELECT doc_id, w, count(*) AS c FROM y GROUP BY ALL),
an AS (SELECT item_id, count(*) AS left_words FROM x GROUP BY ALL), bn AS (SELECT doc_id, count(*) AS right_words FROM y GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(least(a.c, b.c)) AS BIGINT) AS shared FROM a JOIN b USING (w) GROUP BY ALL)
SELECT item_id, doc_id, shared, left_words, right_words, 2000 * shared // (left_words + right_words) AS ratio_e3
FROM s JOIN an USING (item_id) JOIN bn USING (doc_id) WHERE 2.0 * shared / (left_words + right_words) >= 0.25
""",
)
def _(t):
    """All pairs of a benchmark text and a whole document that share a quarter of their words."""
    found = similar_texts(t.benchmark, t.documents, "item_id", "doc_id", least=0.25)
    return found.withColumn("ratio_e3", F.expr("2000 * shared div (left_words + right_words)"))
