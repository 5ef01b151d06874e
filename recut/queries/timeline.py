"""Timelines: rebuild, allocation, retiming, de-duplication, composition, breakdown and edit tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from recut.operators import breakdown as bd
from recut.operators import timeline as tl
from recut.operators.ordered import told
from recut.plans import timeline as plans
from recut.queries.domain import AUDIO_RESULTS_SQL, CLIPS_SQL
from recut.queries.registry import ctes, query
from recut.session import cut_lineage, settled

P = ["project_id"]

REBUILD_SQL = ctes(CLIPS_SQL) + """,
sh AS (SELECT item_no AS project_id, clip_no AS shot_no, part_no, (clip_no - 1) * 3000 AS s, (clip_no - 1) * 3000 + least(3000, (end_ms - start_ms) // 10) AS e FROM clips),
mt AS (SELECT *, e - s AS len, CASE part_no % 10 WHEN 7 THEN 'needs_review' WHEN 8 THEN 'matched_low_confidence' ELSE 'matched' END AS st, part_no % 10 <> 9 AS has,
   s + 100000 + (part_no % 3) * 900 AS ms, CASE part_no % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS cf FROM sh WHERE e > s),
m2 AS (SELECT *, ms + len + (part_no % 5 - 2) * 100 AS me FROM mt),
m3 AS (SELECT *, has AND st <> 'needs_review' AND me > ms AS ready, least(e, 15000, 14000) AS lim FROM m2),
base AS (SELECT project_id, shot_no, CASE WHEN ready THEN 'ready' WHEN s >= lim - 30 THEN 'skipped' ELSE 'fallback' END AS status, s AS rs,
   CASE WHEN ready OR s >= lim - 30 THEN CASE WHEN ready THEN e ELSE s END ELSE lim END AS re, CASE WHEN ready THEN 'movie' ELSE 'ref' END AS source,
   CASE WHEN ready THEN ms ELSE s END AS ms,
   CASE WHEN ready THEN CASE WHEN greatest(0, me - ms) > len + 30 OR greatest(0, me - ms) < len - 30 THEN ms + len ELSE me END WHEN s >= lim - 30 THEN s ELSE lim END AS me,
   CASE WHEN ready THEN CASE WHEN greatest(0, me - ms) > len + 30 THEN 'cut_to_ref_duration' WHEN greatest(0, me - ms) < len - 30 THEN 'extend_movie_end' ELSE 'same_duration' END ELSE 'fallback_use_ref_video' END AS fit,
   CASE WHEN ready THEN cf ELSE 'low' END AS cf,
   CASE WHEN ready THEN CASE WHEN greatest(0, me - ms) < len - 30 THEN 1 ELSE 0 END ELSE (CASE WHEN lim < e THEN 1 ELSE 0 END) + (CASE WHEN s >= lim - 30 THEN 1 ELSE 0 END) END AS warns FROM m3)
"""

GROUP_SQL = """,
jn AS (SELECT *, coalesce(status = 'ready' AND lag(status) OVER w = 'ready' AND source = lag(source) OVER w AND rs - lag(re) OVER w <= 300
   AND ms - lag(me) OVER w BETWEEN -200 AND 1000, false) AS joins FROM base WHERE status <> 'skipped' WINDOW w AS (PARTITION BY project_id ORDER BY shot_no)),
gr AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY shot_no ROWS UNBOUNDED PRECEDING) AS g FROM jn),
mi AS (SELECT project_id, CAST(g AS BIGINT) AS g, min_by(status, shot_no) AS status, min_by(rs, shot_no) AS rs, max_by(re, shot_no) AS re,
   min(CASE cf WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS cr, max_by(ms, shot_no) AS ms, max_by(me, shot_no) AS me, max_by(fit, shot_no) AS fit, count(*) AS clips, CAST(sum(warns) AS BIGINT) AS warns FROM gr GROUP BY ALL)
"""

ABSORB_SQL = """,
ms AS (SELECT *, greatest(0, re - rs) AS d, row_number() OVER (PARTITION BY project_id ORDER BY g) AS rn FROM mi),
fold AS (
  SELECT project_id, rn, 1::BIGINT AS item_no, status, rs, re, cr, ms, me, fit, clips, warns, 0 AS absorbed FROM ms WHERE rn = 1
  UNION ALL
  SELECT m.project_id, m.rn, CASE WHEN a THEN f.item_no ELSE f.item_no + 1 END, CASE WHEN a THEN f.status ELSE m.status END, CASE WHEN a THEN f.rs ELSE m.rs END, m.re,
    CASE WHEN a THEN least(f.cr, m.cr) ELSE m.cr END, CASE WHEN a THEN f.ms ELSE m.ms END, CASE WHEN a THEN f.me + m.d ELSE m.me END,
    CASE WHEN a THEN CASE WHEN m.status = 'fallback' THEN 'extend_previous_for_short_fallback' ELSE 'extend_previous_for_short_ref' END ELSE m.fit END,
    CASE WHEN a THEN f.clips ELSE m.clips END, CASE WHEN a THEN f.warns + m.warns + 1 ELSE m.warns END, CASE WHEN a THEN 1 ELSE 0 END
  FROM (SELECT f.*, m2.d > 0 AND m2.d < 500 AND f.status = 'ready' AS a FROM fold f JOIN ms m2 ON m2.project_id = f.project_id AND m2.rn = f.rn + 1) f JOIN ms m ON m.project_id = f.project_id AND m.rn = f.rn + 1),
items AS (SELECT project_id, item_no, max_by(status, rn) AS status, max_by(rs, rn) AS rs, max_by(re, rn) AS re, max_by(cr, rn) AS cr, max_by(me, rn) AS me, max_by(fit, rn) AS fit, max_by(clips, rn) AS clips,
   max_by(warns, rn) AS warns FROM fold GROUP BY ALL)
"""


def _rebuild_inputs(t):
    rows = t.clips.select(
        F.col("item_no").alias("project_id"), F.col("clip_no").alias("shot_no"), "part_no", ((F.col("clip_no") - 1) * 3_000).alias("start_ms"),
        ((F.col("clip_no") - 1) * 3_000 + F.least(F.lit(3_000), F.floor((F.col("end_ms") - F.col("start_ms")) / 10))).alias("end_ms"),
    )
    rows = cut_lineage(rows)  # read three times
    k = F.col("part_no")
    status = F.when(k % 10 == 7, "needs_review").when(k % 10 == 8, "matched_low_confidence").otherwise("matched")
    begin = F.col("start_ms") + 100_000 + k % 3 * 900
    matches = rows.where("part_no % 10 <> 9").select(
        "project_id", "shot_no", begin.alias("movie_start_ms"), (begin + F.col("end_ms") - F.col("start_ms") + (k % 5 - 2) * 100).alias("movie_end_ms"),
        status.alias("status"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("confidence"),
        F.array(k.cast("string")).alias("movie_shot_ids"), F.lit(1).alias("pos"),
    )
    media = rows.select("project_id").distinct().select("project_id", F.lit(15_000).alias("video_ms"), F.lit(14_000).alias("audio_ms"))
    return rows.drop("part_no"), matches, media


def _base(t):
    return tl.rebuild_base_items(*_rebuild_inputs(t), P, match_pos="pos")


@query(
    "rebuild_base_items",
    "F2 P18 P19",
    REBUILD_SQL + "SELECT project_id, shot_no, status, rs AS ref_start_ms, re AS ref_end_ms, ms AS movie_start_ms, me AS movie_end_ms, fit AS fit_mode, cf AS confidence, warns AS warning_count FROM base",
)
def _(t):
    return _base(t).select(
        "project_id", "shot_no", "status", "ref_start_ms", "ref_end_ms", "movie_start_ms", "movie_end_ms", "fit_mode", "confidence",
        F.size("warnings").cast("bigint").alias("warning_count"),
    )


CONF_SQL = "CASE cr WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence"


def _merged(t):
    return tl.merged_items(tl.merge_adjacent(_base(t).where("status <> 'skipped'"), P), P)


@query(
    "merged_adjacent_items",
    "F3",
    REBUILD_SQL + GROUP_SQL + f"SELECT project_id, g AS group_no, status, rs AS ref_start_ms, re AS ref_end_ms, {CONF_SQL}, me AS last_end_ms, clips AS clip_count, warns AS warning_count FROM mi",
)
def _(t):
    return _merged(t).select(
        "project_id", "group_no", "status", "ref_start_ms", "ref_end_ms", "confidence", "last_end_ms", "clip_count", F.size("warnings").cast("bigint").alias("warning_count")
    )


@query(
    "absorbed_short_items",
    "F4",
    REBUILD_SQL + GROUP_SQL + ABSORB_SQL + f"SELECT project_id, item_no, status, rs AS ref_start_ms, re AS ref_end_ms, {CONF_SQL}, me AS last_end_ms, fit AS last_fit_mode, clips AS clip_count, warns AS warning_count FROM items",
)
def _(t):
    items = tl.absorb_short(_merged(t), P)
    return items.select(
        "project_id", "item_no", "status", "ref_start_ms", "ref_end_ms", "confidence", "last_end_ms", "last_fit_mode", "clip_count",
        F.size("warnings").cast("bigint").alias("warning_count"),
    )


@query(
    "rebuilt_timeline",
    "F5 W11",
    REBUILD_SQL
    + GROUP_SQL
    + ABSORB_SQL
    + """
SELECT project_id, printf('rebuild_item_%03d', item_no) AS item_id, CAST(coalesce(sum(greatest(0, re - rs)) OVER (PARTITION BY project_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS timeline_start_ms,
  CAST(sum(greatest(0, re - rs)) OVER (PARTITION BY project_id ORDER BY item_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS timeline_end_ms FROM items
""",
)
def _(t):
    return plans.compose_rebuild(*_rebuild_inputs(t), P, match_pos="pos").items.select("project_id", "item_id", "timeline_start_ms", "timeline_end_ms")


@query(
    "rebuild_clips",
    "F5",
    REBUILD_SQL
    + GROUP_SQL
    + ABSORB_SQL
    + """,
hd AS (SELECT project_id, item_no, me, fit, clips, min_by(g, rn) AS g FROM (SELECT f.project_id, f.item_no, f.rn, m.g FROM fold f JOIN ms m USING (project_id, rn)) JOIN items USING (project_id, item_no) GROUP BY ALL),
cl AS (SELECT gr.project_id, h.item_no, row_number() OVER (PARTITION BY gr.project_id, gr.g ORDER BY shot_no) AS clip_no, gr.source, gr.ms, gr.me, gr.fit, h.me AS hme, h.fit AS hfit, h.clips FROM gr JOIN hd h ON h.project_id = gr.project_id AND h.g = gr.g)
SELECT project_id, item_no, clip_no, source, ms AS movie_start_ms, CASE WHEN clip_no = clips THEN hme ELSE me END AS movie_end_ms, CASE WHEN clip_no = clips THEN hfit ELSE fit END AS fit_mode FROM cl
""",
)
def _(t):
    built = plans.compose_rebuild(*_rebuild_inputs(t), P, match_pos="pos")
    return built.clips.select("project_id", "item_no", "clip_no", "source", "movie_start_ms", "movie_end_ms", "fit_mode")


@query(
    "rebuild_quality",
    "G10",
    REBUILD_SQL
    + GROUP_SQL
    + ABSORB_SQL
    + """,
b AS (SELECT project_id, count(*) FILTER (WHERE status = 'ready') AS r, count(*) FILTER (WHERE status = 'fallback') AS f, count(*) FILTER (WHERE status = 'skipped') AS s, CAST(sum(CASE WHEN status <> 'skipped' THEN warns ELSE 0 END) AS BIGINT) AS w FROM base GROUP BY 1),
i AS (SELECT project_id, count(*) AS n FROM items GROUP BY 1),
x AS (SELECT f.project_id, count(*) FILTER (WHERE absorbed = 1 AND m.status <> 'fallback') AS a, count(*) FILTER (WHERE absorbed = 1 AND m.status = 'fallback') AS af FROM fold f JOIN ms m USING (project_id, rn) GROUP BY 1)
SELECT project_id, r AS ready_ref_shots, f AS fallback_ref_shots, s AS skipped_ref_shots, w AS duration_warning_count, coalesce(n, 0) AS rebuild_items, coalesce(a, 0) AS absorbed_short_ref_count,
  coalesce(af, 0) AS absorbed_short_fallback_count, greatest(0, r + f - coalesce(n, 0)) AS merged_items FROM b LEFT JOIN i USING (project_id) LEFT JOIN x USING (project_id)
""",
)
def _(t):
    return plans.compose_rebuild(*_rebuild_inputs(t), P, match_pos="pos").quality


FIT_SQL = """,
x AS (SELECT *, greatest(0, end_ms - start_ms) AS len, sum(greatest(0, end_ms - start_ms)) OVER (PARTITION BY item_no) AS av, max(clip_no) OVER (PARTITION BY item_no) AS lastno FROM src),
y AS (SELECT *, len * target AS tk, clip_no = lastno AS isl FROM x),
z AS (SELECT *, coalesce(sum(CASE WHEN isl OR tk <= 30 * av THEN 0 ELSE tk END) OVER (PARTITION BY item_no ORDER BY clip_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM y),
fit AS (SELECT *, CASE WHEN isl THEN greatest(0, target * av - used) ELSE tk END AS take FROM z)
"""


def _targets(t):
    return t.clips.join(t.audio_results.select("item_no", "project_id", F.floor(F.col("audio_ms") * 2).cast("bigint").alias("target")), "item_no")


TARGET_SQL = ctes(CLIPS_SQL, AUDIO_RESULTS_SQL) + ",\nsrc AS (SELECT clips.*, project_id, audio_ms * 2 AS target FROM clips JOIN audio_results USING (item_no))"


@query(
    "allocated_clips",
    "F6",
    TARGET_SQL
    + FIT_SQL
    + """,
k AS (SELECT *, CASE WHEN target <= av THEN CAST((2 * take + av) // (2 * av) AS BIGINT) ELSE CAST(len + CASE WHEN isl AND target - av > 30 THEN target - av ELSE 0 END AS BIGINT) END AS duration_ms FROM fit WHERE target > av OR take > 30 * av)
SELECT item_no, row_number() OVER (PARTITION BY item_no ORDER BY clip_no) AS clip_no, start_ms, start_ms + duration_ms AS end_ms, duration_ms,
  CASE WHEN target <= av AND target * 100 < av * 98 THEN 'trimmed' WHEN target > av AND target - av > 30 AND isl THEN 'synthetic_extension' ELSE 'original' END AS allocation,
  CASE WHEN target <= av AND target * 100 < av * 98 THEN 'trimmed_to_tts' WHEN target > av AND target - av > 30 THEN 'extended_last_clip' ELSE 'kept_original' END AS allocation_status FROM k
""",
)
def _(t):
    fitted = tl.allocate_clips(_targets(t).withColumnRenamed("clip_no", "range_pos"), ["item_no"], "target")
    return fitted.select("item_no", "clip_no", "start_ms", "end_ms", "duration_ms", "allocation", "allocation_status")


RETIME_END = "CASE WHEN av <= 0 OR target <= 0 THEN end_ms WHEN target <= av THEN start_ms + CAST((2 * take + av) // (2 * av) AS BIGINT) ELSE end_ms + CASE WHEN isl THEN CAST(target - av AS BIGINT) ELSE 0 END END"


@query(
    "retimed_clips",
    "F7 G11",
    TARGET_SQL + FIT_SQL + f"SELECT item_no, clip_no, start_ms, {RETIME_END} AS end_ms FROM fit WHERE av <= 0 OR target <= 0 OR target > av OR take > 30 * av",
)
def _(t):
    return tl.retime_clips(_targets(t), ["item_no"], "target").select("item_no", "clip_no", "start_ms", "end_ms")


@query(
    "clip_durations",
    "G11 G14",
    ctes(CLIPS_SQL) + "SELECT item_no, count(*) AS clip_count, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS total_ms FROM clips GROUP BY 1",
)
def _(t):
    return t.clips.groupBy("item_no").agg(F.count(F.lit(1)).alias("clip_count"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("total_ms"))


NEAR_SQL = ctes(CLIPS_SQL) + """,
r AS (SELECT item_no, clip_no, (clip_no - 1) * 1000 AS s, (clip_no - 1) * 1000 + (end_ms - start_ms) * 3 // 100 AS e, [part_no % 3, 10 + part_no % 4] AS ids FROM clips),
o AS (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY clip_no) AS rn FROM r WHERE e > s)
"""


def _near_rows(t):
    start = (F.col("clip_no") - 1) * 1_000
    ids = F.array((F.col("part_no") % 3).cast("string"), (10 + F.col("part_no") % 4).cast("string"))
    return t.clips.select(
        "item_no", F.col("clip_no").alias("range_pos"), start.alias("start_ms"), (start + F.floor((F.col("end_ms") - F.col("start_ms")) * 3 / 100)).alias("end_ms"), ids.alias("shot_ids")
    )


@query(
    "coalesced_nearby_rows",
    "F8",
    NEAR_SQL
    + """,
f AS (
  SELECT item_no, rn, clip_no, s, e, ids, 1 AS g FROM o WHERE rn = 1
  UNION ALL
  SELECT o.item_no, o.rn, o.clip_no, CASE WHEN j THEN f.s ELSE o.s END, CASE WHEN j THEN greatest(f.e, o.e) ELSE o.e END, CASE WHEN j THEN list_distinct(list_concat(f.ids, o.ids)) ELSE o.ids END, CASE WHEN j THEN f.g ELSE f.g + 1 END
  FROM (SELECT f.*, list_has_any(f.ids, o2.ids) AND o2.s <= f.e + 350 AS j FROM f JOIN o o2 ON o2.item_no = f.item_no AND o2.rn = f.rn + 1) f JOIN o ON o.item_no = f.item_no AND o.rn = f.rn + 1)
SELECT item_no, min(clip_no) AS range_pos, min(s) AS start_ms, max(e) AS end_ms, count(*) AS merged_rows, array_to_string(list_sort(list_transform(max_by(ids, rn), lambda x: CAST(x AS VARCHAR))), ',') AS shot_list FROM f GROUP BY item_no, g
""",
)
def _(t):
    merged = tl.coalesce_nearby(_near_rows(t), ["item_no"])
    return merged.select("item_no", "range_pos", "start_ms", "end_ms", "merged_rows", F.concat_ws(",", F.array_sort("shot_ids")).alias("shot_list"))


DEDUPE_SQL = ctes(CLIPS_SQL) + """,
r AS (SELECT item_no % 50 AS project_id, item_no, clip_no, (part_no % 90) * 1000 AS s, (part_no % 90) * 1000 + (end_ms - start_ms) // 5 AS e, part_no FROM clips),
o AS (SELECT *, CASE WHEN part_no % 6 <> 0 THEN 'shot:' || (part_no % 700) ELSE printf('time:%.3f-%.3f', s / 1000.0::DOUBLE, e / 1000.0::DOUBLE) END AS k,
        row_number() OVER (PARTITION BY project_id ORDER BY item_no, clip_no) AS rn FROM r),
f AS (
  SELECT project_id, 0::BIGINT AS rn, -1::BIGINT AS item_no, NULL::BIGINT AS cur, NULL::BIGINT AS s, false AS kept, []::VARCHAR[] AS used, 0::BIGINT AS clip_no, NULL::BIGINT AS e FROM (SELECT DISTINCT project_id FROM o)
  UNION ALL
  SELECT project_id, rn, item_no, CASE WHEN kept THEN greatest(coalesce(cur, e), e) ELSE cur END, ns, kept, CASE WHEN kept THEN list_append(used, k) ELSE used END, clip_no, e FROM (
    SELECT *, NOT list_contains(used, k) AND NOT (back AND e <= cur + 30) AND e - ns > 30 AS kept FROM (
      SELECT *, coalesce(s < cur - 50, false) AS back, CASE WHEN coalesce(s < cur - 50, false) THEN cur ELSE s END AS ns FROM (
        SELECT o.project_id, o.rn, o.item_no, o.clip_no, o.s, o.e, o.k, f.used, CASE WHEN o.item_no = f.item_no THEN f.cur END AS cur FROM f JOIN o ON o.project_id = f.project_id AND o.rn = f.rn + 1))))
SELECT project_id, item_no, clip_no AS range_pos, s AS start_ms, e AS end_ms FROM f WHERE kept
"""


@query("deduplicated_visuals", "F9 P26", DEDUPE_SQL)
def _(t):
    start = F.col("part_no") % 90 * 1_000
    ids = F.when(F.col("part_no") % 6 != 0, F.array((F.col("part_no") % 700).cast("string"))).otherwise(F.array().cast("array<string>"))
    rows = t.clips.select(
        (F.col("item_no") % 50).alias("project_id"), "item_no", F.col("clip_no").alias("range_pos"), start.alias("start_ms"),
        (start + F.floor((F.col("end_ms") - F.col("start_ms")) / 5)).alias("end_ms"), ids.alias("shot_ids"),
    )
    return tl.dedupe_visuals(rows, P).drop("shot_ids")


def _script(t, held=lambda df: df):
    """Orders as script segments: a third with text units, a third with actions, a third by pattern."""
    numbered = t.orders.select((F.col("o_orderkey") % 50).alias("project_id"), F.col("o_orderkey").alias("seg_no"), "o_orderpriority", "o_orderstatus")
    pattern = F.when(F.col("seg_no") % 4 == 0, "all_original_audio").when(F.col("seg_no") % 4 == 1, "narration_then_original_audio").when(
        F.col("seg_no") % 4 == 2, "original_audio_then_narration"
    )
    segments = numbered.select(
        *P, "seg_no", F.concat("o_orderpriority", F.lit(" told in many words "), F.col("seg_no").cast("string")).alias("text"), pattern.alias("audio_pattern"),
        F.when(F.col("o_orderstatus") == "F", "ai_rewritten").otherwise("original").alias("rewrite_status"),
    )
    action = F.when(F.col("item_no") % 3 == 1, F.expr("case part_no % 4 when 0 then 'play_original_audio' when 1 then 'play_original_audio_low_volume' else 'rewrite_and_voiceover' end"))
    ranges = t.clips.select(
        (F.col("item_no") % 50).alias("project_id"), F.col("item_no").alias("seg_no"), F.col("clip_no").alias("range_pos"),
        F.concat(F.lit("range_"), F.col("clip_no").cast("string")).alias("range_id"), (F.col("part_no") * 1_000).alias("start_ms"),
        (F.col("part_no") * 1_000 + F.floor((F.col("end_ms") - F.col("start_ms")) / 10)).cast("bigint").alias("end_ms"),
        F.array(F.concat(F.lit("s"), F.col("part_no").cast("string"))).alias("shot_ids"), F.concat(F.lit("r"), F.col("clip_no").cast("string")).alias("source_ref_shot"),
        action.alias("audio_action"), F.when(F.col("part_no") % 5 == 0, "low").otherwise("high").alias("confidence"), (F.col("clip_no") % 2 == 0).alias("is_original"),
    )
    ranges = held(ranges)
    units = ranges.where("seg_no % 5 < 2").select(
        *P, "seg_no", F.col("range_pos").alias("unit_pos"), F.when(F.col("range_pos") % 3 != 0, F.concat(F.lit("new "), "range_id")).alias("new_text"),
        F.concat(F.lit("old "), "range_id").alias("old_text"), (F.col("range_pos") % 4 == 0).alias("keep_original_audio"),
        F.when(F.col("range_pos") % 5 != 0, F.array("range_id")).otherwise(F.array().cast("array<string>")).alias("related_range_ids"),
    )
    return segments, ranges, units


def _written_script(t):
    """The script, its ranges written: units follow from them."""
    return _script(t, cut_lineage)


@query("composed_timeline", "F10 F11 F12 P20 P25")
def _(t):
    return plans.compose_timeline(*_written_script(t), P).items


@query("composed_clips", "F10 F11 F12")
def _(t):
    clips = plans.compose_timeline(*_written_script(t), P).clips
    return clips.withColumn("shot_ids", F.concat_ws(",", "shot_ids"))


CHUNK_SQL = ctes(CLIPS_SQL) + """,
r AS (SELECT item_no AS seg_no, clip_no AS pos, CASE WHEN item_no % 3 <> 1 THEN 'voiceover' WHEN part_no % 4 = 0 THEN 'original' WHEN part_no % 4 = 1 THEN 'mixed' ELSE 'voiceover' END AS act, (end_ms - start_ms) // 10 AS len FROM clips),
u AS (SELECT seg_no, pos, act, len, pos % 5 <> 0 AS related, pos % 3 <> 0 AS rewritten, pos % 4 = 0 AS kept,
  CASE WHEN pos % 4 = 0 THEN 'original' WHEN pos % 5 <> 0 THEN act ELSE 'voiceover' END AS mode FROM r WHERE seg_no % 5 < 2),
a AS (SELECT seg_no, 0 AS part, pos, mode, CASE WHEN kept THEN '' WHEN rewritten THEN 'new range_' || pos ELSE 'old range_' || pos END AS said, CASE WHEN related THEN len END AS len
      FROM u WHERE related OR (mode <> 'original' AND rewritten)
  UNION ALL SELECT seg_no, 1, pos, act, '', len FROM r WHERE seg_no % 5 >= 2 OR pos % 5 = 0),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR pm <> part || mode THEN 1 ELSE 0 END) OVER (PARTITION BY seg_no ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS c
      FROM (SELECT *, lag(part || mode) OVER (PARTITION BY seg_no ORDER BY part, pos) AS pm FROM a)),
k AS (SELECT seg_no, c, mode, string_agg(said, '' ORDER BY pos) AS said, CAST(coalesce(sum(len), 0) AS BIGINT) AS span, count(len) AS shown FROM g GROUP BY ALL),
n AS (SELECT k.*, CASE WHEN mode = 'original' THEN '' WHEN said = '' AND mode = 'voiceover' AND seg_no % 5 >= 2 THEN o_orderpriority || ' told in many words ' || seg_no ELSE said END AS narration
      FROM k JOIN orders ON o_orderkey = seg_no),
t AS (SELECT *, CASE WHEN narration = '' THEN 0 ELSE greatest(1200, CAST(floor(length(regexp_replace(narration, '[\\s.,!?;:]', '', 'g')) * 1000 / 4.2::DOUBLE + 0.5) AS BIGINT)) END AS speech FROM n)
SELECT seg_no, CAST(c AS BIGINT) AS chunk_no, mode AS audio_mode, narration, CASE WHEN mode = 'original' OR (mode = 'mixed' AND speech = 0) THEN span ELSE speech END AS tts_ms
FROM t WHERE shown > 0 OR narration <> ''
"""


@query("audio_aware_items", "F11 P5 P6", CHUNK_SQL)
def _(t):
    segments, ranges, units = map(settled, _written_script(t))
    items = plans.audio_aware_items(segments, ranges, units, P).items
    return items.select("seg_no", "chunk_no", "audio_mode", "narration", "tts_ms")


@query(
    "pattern_parts",
    "F12",
    ctes(CLIPS_SQL)
    + """,
p AS (SELECT item_no AS seg_no, clip_no, item_no % 4 AS k, clip_no % 2 = 0 AS orig FROM clips)
SELECT seg_no, part_no, kind, count(*) AS ranges FROM (
  SELECT seg_no, 0 AS part_no, 'original' AS kind FROM p WHERE k = 0 UNION ALL SELECT seg_no, 0, 'narration' FROM p WHERE k = 3
  UNION ALL SELECT seg_no, CASE WHEN (k = 1) = orig THEN 1 ELSE 0 END, CASE WHEN orig THEN 'original' ELSE 'narration' END FROM p WHERE k IN (1, 2)) GROUP BY ALL
""",
)
def _(t):
    segments, ranges, _ = _script(t)
    _, rows = plans.pattern_parts(segments, ranges, P)
    return rows.groupBy("seg_no", F.col("part_no").cast("bigint").alias("part_no"), "kind").agg(F.count(F.lit(1)).alias("ranges"))


def _edit_inputs(t):
    audio = t.audio_results
    items = audio.select(*P, "item_no", "audio_ms", (F.col("status") == "F").alias("is_original"), F.concat(F.lit("voice-"), (F.col("item_no") % 97).cast("string")).alias("audio_path"))
    clips = t.clips.where("flag <> 'N' or part_no % 3 = 0").join(audio.select("item_no", "project_id"), "item_no").select(
        *P, "item_no", "clip_no", F.concat(F.lit("film-"), (F.col("part_no") % 5).cast("string")).alias("source"), "start_ms", "end_ms"
    )
    media = clips.select(*P, "source").distinct().where("source <> 'film-4'").select(*P, "source", F.lit(500_000).alias("duration_ms"))
    return items, clips, media


EDIT_SQL = ctes(CLIPS_SQL, AUDIO_RESULTS_SQL) + """,
it AS (SELECT project_id, item_no, audio_ms, status = 'F' AS orig, 'voice-' || (item_no % 97) AS path FROM audio_results),
ec AS (SELECT c.*, 'film-' || (part_no % 5) AS source FROM clips c WHERE flag <> 'N' OR part_no % 3 = 0),
src AS (SELECT ec.*, project_id, audio_ms AS target, orig FROM ec JOIN it USING (item_no))
""" + FIT_SQL + f""",
rt AS (SELECT project_id, item_no, clip_no, source, orig, start_ms AS s, {RETIME_END} AS e FROM fit WHERE av <= 0 OR target <= 0 OR target > av OR take > 30 * av),
ln AS (SELECT *, CASE WHEN orig AND source <> 'film-4' THEN least(greatest(30, e - s), greatest(30, 500000 - s)) ELSE greatest(30, e - s) END AS d FROM rt),
cu AS (SELECT project_id, item_no, clip_no, source, d * 1000 AS duration_us, CASE WHEN orig THEN s * 1000 ELSE 0 END AS source_start_us, CASE WHEN orig THEN 1 ELSE 0 END AS volume,
   CASE WHEN orig THEN 'source|' || source ELSE 'cut|' || source || '|' || s || '|' || d END AS mk FROM ln),
fi AS (SELECT item_no, min_by(source, clip_no) AS fs FROM ec GROUP BY 1),
nb AS (SELECT it.*, coalesce(fs, first_value(fs IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY it.item_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
   last_value(fs IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY it.item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS fill FROM it LEFT JOIN fi USING (item_no)),
ro AS (SELECT * FROM cu UNION ALL SELECT project_id, item_no, 1, fill, audio_ms * 1000, 0, 0, 'fill|' || project_id || '|' || item_no || '|' || fill FROM nb WHERE NOT orig AND item_no NOT IN (SELECT item_no FROM cu)),
vid AS (SELECT *, CAST(coalesce(sum(duration_us) OVER (PARTITION BY project_id ORDER BY item_no, clip_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS target_start_us FROM ro)
"""


@query(
    "edit_video_segments",
    "F29 P9 J26",
    EDIT_SQL + "SELECT project_id, item_no, clip_no, source, duration_us, source_start_us, volume, target_start_us, md5(mk) AS material_id FROM vid",
)
def _(t):
    return bd.edit_tracks(*_edit_inputs(t), P).video.select(
        *P, "item_no", "clip_no", "source", "duration_us", "source_start_us", F.col("volume").cast("bigint").alias("volume"), "target_start_us", "material_id"
    )


@query(
    "edit_audio_segments",
    "F29",
    EDIT_SQL
    + """
SELECT it.project_id, it.item_no, min(target_start_us) AS target_start_us, CAST(least(audio_ms * 1000, sum(duration_us)) AS BIGINT) AS duration_us, path AS source
FROM it JOIN vid USING (item_no) WHERE NOT orig GROUP BY it.project_id, it.item_no, audio_ms, path
""",
)
def _(t):
    return bd.edit_tracks(*_edit_inputs(t), P).audio.drop("material_id")


@query(
    "edit_materials",
    "F29",
    EDIT_SQL
    + """
SELECT project_id, kind, count(*) AS materials FROM (SELECT DISTINCT project_id, md5(mk) AS m, 'video' AS kind FROM vid UNION SELECT DISTINCT it.project_id, md5('audio|' || path), 'audio' FROM it JOIN vid USING (item_no) WHERE NOT orig) GROUP BY ALL
""",
)
def _(t):
    return bd.edit_tracks(*_edit_inputs(t), P).materials.groupBy(*P, "kind").agg(F.count(F.lit(1)).alias("materials"))


@query(
    "cleaned_script_segments",
    "P28",
    ctes(CLIPS_SQL)
    + """,
m AS (SELECT DISTINCT item_no, 200000 + (item_no % 5) * 200000 AS d FROM clips),
c AS (SELECT clips.item_no, clip_no AS seg_no, greatest(0, start_ms - 50000) AS s, least(end_ms - 50000, d) AS e, shot_id AS text FROM clips JOIN m USING (item_no))
SELECT item_no, seg_no, s AS start_ms, e AS end_ms, text FROM c WHERE e > s
UNION ALL SELECT item_no, 1, 0, d, '' FROM m WHERE item_no NOT IN (SELECT item_no FROM c WHERE e > s)
""",
)
def _(t):
    rows = t.clips.select("item_no", F.col("clip_no").alias("seg_no"), (F.col("start_ms") - 50_000).alias("start_ms"), (F.col("end_ms") - 50_000).alias("end_ms"), F.col("shot_id").alias("text"))
    media = rows.select("item_no").distinct().withColumn("duration_ms", (200_000 + F.col("item_no") % 5 * 200_000).cast("bigint"))
    return bd.clean_script_segments(rows, media, ["item_no"])


def _breakdown_inputs(t):
    audio = t.audio_results
    lines = cut_lineage(t.clips)  # read twice
    held = cut_lineage(lines.join(audio.select("item_no", "project_id"), "item_no"))  # clips and ranges follow from it row by row
    items = audio.select(
        *P, "item_no", F.col("item_no").alias("seg_no"), F.concat(F.lit("line "), F.col("item_no").cast("string")).alias("narration"),
        F.when(F.col("status") == "O", "original").otherwise("voiceover").alias("audio_mode"), F.lit(0).alias("ost"), F.lit(4_000).cast("bigint").alias("tts_ms"),
        F.lit(0).cast("bigint").alias("ref_start_ms"), (F.col("item_no") % 9_000).alias("ref_end_ms"),
    )
    clips = held.select(
        *P, "item_no", "clip_no", "start_ms", "end_ms", F.when(F.col("flag") == "R", True).when(F.col("flag") == "A", False).alias("keep_original_audio"),
        F.when(F.col("part_no") % 3 == 1, F.col("item_no")).when(F.col("part_no") % 3 == 2, F.col("item_no") + 1).alias("source_ref_shot"),
        F.when(F.col("part_no") % 2 == 0, "synthetic_extension").otherwise("original").alias("allocation"),
    )
    ranges = held.select(
        *P, F.col("item_no").alias("seg_no"), F.col("clip_no").alias("range_pos"), F.col("start_ms").alias("range_start_ms"), (F.col("end_ms") - 500).alias("range_end_ms"),
        F.when(F.col("part_no") % 4 == 1, "keep_original_audio").alias("audio_action"), F.lit("").alias("audio_role"),
        F.when(F.col("part_no") % 3 == 0, F.array("shot_id")).otherwise(F.array().cast("array<string>")).alias("texts"),
    )
    ref_shots = audio.select(*P, F.col("item_no").alias("shot_no"), (F.col("item_no") % 9_000).alias("start_ms"), (F.col("item_no") % 9_000 + F.col("audio_ms")).alias("end_ms"))
    subs = lines.select(
        (F.col("item_no") % 50).alias("project_id"), F.col("part_no").alias("sub_no"), (F.col("start_ms") + F.col("clip_no") * 777).alias("start_ms"),
        (F.col("start_ms") + F.col("clip_no") * 777 + 300).alias("end_ms"), F.col("shot_id").alias("text"),
    )
    return items, told(clips, held), audio.select(*P, "item_no", "audio_ms").where("item_no % 4 <> 0"), told(ranges, held), ref_shots, subs, subs


BREAKDOWN_SQL = ctes(CLIPS_SQL, AUDIO_RESULTS_SQL) + """,
src AS (SELECT c.*, a.project_id, a.status, CASE WHEN c.item_no % 4 <> 0 AND audio_ms > 0 THEN audio_ms ELSE 4000 END AS target FROM clips c JOIN audio_results a USING (item_no))
""" + FIT_SQL + f""",
rt AS (SELECT project_id, item_no, clip_no, status, flag, part_no, target, start_ms AS s, {RETIME_END} AS e FROM fit WHERE av <= 0 OR target <= 0 OR target > av OR take > 30 * av),
pl AS (SELECT *, greatest(0, e - s) AS d FROM rt),
pp AS (SELECT *, CAST(coalesce(sum(d) OVER (PARTITION BY project_id ORDER BY item_no, clip_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ts,
   CAST(coalesce(sum(d) OVER (PARTITION BY item_no ORDER BY clip_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cf FROM pl),
ov AS (SELECT p.item_no, p.clip_no, r.part_no AS rpart, r.shot_id AS rshot, row_number() OVER (PARTITION BY p.item_no, p.clip_no ORDER BY least(p.e, r.end_ms - 500) - greatest(p.s, r.start_ms) DESC, r.clip_no) AS rn
   FROM pp p JOIN clips r ON r.item_no = p.item_no AND p.s < r.end_ms - 500 AND r.start_ms < p.e AND p.e > p.s),
sb AS (SELECT item_no % 50 AS project_id, part_no AS sub_no, start_ms + clip_no * 777 AS s0, start_ms + clip_no * 777 + 300 AS s1, shot_id AS text FROM clips),
mt AS (SELECT p.item_no, p.clip_no, string_agg(text, ' ' ORDER BY sub_no, s0, s1, text) AS txt FROM pp p JOIN sb ON sb.project_id = p.project_id AND p.s < s1 AND s0 < p.e GROUP BY ALL)
SELECT p.project_id, p.item_no, p.clip_no, ts AS timeline_start_ms, ts + d AS timeline_end_ms, d AS duration_ms,
  CASE WHEN flag = 'R' THEN true WHEN flag = 'A' THEN false WHEN p.status = 'O' THEN true ELSE coalesce(rpart % 4 = 1, false) END AS is_original_play,
  coalesce(CASE WHEN rpart % 3 = 0 THEN rshot END, txt, '') AS shot_subtitle,
  CASE WHEN o.item_no IS NOT NULL THEN o.item_no % 9000 WHEN p.item_no % 9000 = 0 OR (part_no % 2 = 0 AND part_no % 3 = 0) THEN 0 ELSE CAST(((p.item_no % 9000) * least(cf, target) * 2 + target) // (2 * target) AS BIGINT) END AS ref_start_ms,
  CASE WHEN o.item_no IS NOT NULL THEN o.item_no % 9000 + o.audio_ms WHEN p.item_no % 9000 = 0 OR (part_no % 2 = 0 AND part_no % 3 = 0) THEN p.item_no % 9000 ELSE CAST(((p.item_no % 9000) * least(cf + d, target) * 2 + target) // (2 * target) AS BIGINT) END AS ref_end_ms
FROM pp p LEFT JOIN (SELECT * FROM ov WHERE rn = 1) USING (item_no, clip_no) LEFT JOIN mt USING (item_no, clip_no)
LEFT JOIN (SELECT project_id, item_no, audio_ms FROM audio_results) o ON o.project_id = p.project_id AND o.item_no = CASE part_no % 3 WHEN 1 THEN p.item_no WHEN 2 THEN p.item_no + 1 END
"""


@query("shot_breakdown", "F28 J6 P21 G12 W13 W11", BREAKDOWN_SQL)
def _(t):
    rows = bd.shot_breakdown(*_breakdown_inputs(t), P)
    return rows.select(
        *P, "item_no", "clip_no", "timeline_start_ms", "timeline_end_ms", "duration_ms", "is_original_play", "shot_subtitle", "ref_start_ms", "ref_end_ms"
    )


@query(
    "breakdown_totals",
    "G14",
    BREAKDOWN_SQL.replace("SELECT p.project_id, p.item_no, p.clip_no, ts", "SELECT project_id, count(*) AS shot_count, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(DISTINCT item_no) AS segment_count FROM (SELECT p.project_id, p.item_no, p.clip_no, ts")
    + ") GROUP BY project_id",
)
def _(t):
    return bd.breakdown_totals(bd.shot_breakdown(*_breakdown_inputs(t), P), P)
