"""Audio roles: signals, patterns, budget, blocks and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recut.operators import audio as au
from recut.queries.domain import AUDIO_RANGES_SQL, CLIPS_SQL, DECISIONS_SQL
from recut.queries.registry import ctes, query
from recut.session import cut_lineage

SEG = ["project_id", "seg_no"]
BASE = ctes(CLIPS_SQL, AUDIO_RANGES_SQL)

SIGNALS_SQL = """,
a AS (SELECT *, count(*) OVER (PARTITION BY seg_no) AS n, greatest(0, end_ms - start_ms) AS len FROM audio_ranges),
b AS (SELECT *, CASE WHEN len > 0 THEN CAST(floor(covered_ms * 10000 / len + 0.5) AS BIGINT) ELSE 0 END AS cov,
  CASE text_role WHEN 'ending' THEN -4 WHEN 'hook' THEN CASE WHEN clip_pos < greatest(1, n * 6 // 10) THEN -3 ELSE -1 END ELSE 0 END
  + CASE WHEN covered_ms * 100 >= len * 45 THEN 3 WHEN covered_ms * 100 >= len * 20 THEN 2 WHEN covered_ms > 0 THEN 1 ELSE -3 END
  + CASE WHEN subtitle_count >= 2 THEN 1 ELSE 0 END - CASE WHEN len < 1200 THEN 1 ELSE 0 END AS base FROM a),
c AS (SELECT *, base + CASE WHEN cov >= 2000 AND (coalesce(lag(cov) OVER w >= 2000 AND start_ms <= lag(end_ms) OVER w + 1000, false)
     OR coalesce(lead(cov) OVER w >= 2000 AND lead(start_ms) OVER w <= end_ms + 1000, false)) THEN 1 ELSE 0 END AS score FROM b WINDOW w AS (PARTITION BY seg_no ORDER BY clip_pos)),
sig AS (SELECT *, CASE WHEN score >= 3 THEN 'original_dialogue' ELSE 'narration' END AS role0 FROM c)
"""


def _signals(t):
    return au.initial_signals(t.audio_ranges, SEG)


@query("timing_signals", "F13 W7", BASE + SIGNALS_SQL + "SELECT seg_no, clip_pos, cov AS coverage_e4, CAST(score AS BIGINT) AS score, role0 AS audio_role FROM sig")
def _(t):
    return _signals(t).select("seg_no", "clip_pos", "coverage_e4", "score", "audio_role")


@query(
    "smoothed_roles",
    "W8 F13",
    BASE
    + SIGNALS_SQL
    + """,
r AS (SELECT *, sum(CASE WHEN pr IS NULL OR pr <> role0 THEN 1 ELSE 0 END) OVER (PARTITION BY seg_no ORDER BY clip_pos ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, lag(role0) OVER (PARTITION BY seg_no ORDER BY clip_pos) AS pr FROM sig)),
sp AS (SELECT seg_no, run, greatest(0, max_by(end_ms, clip_pos) - min_by(start_ms, clip_pos)) AS span FROM r GROUP BY ALL),
k AS (SELECT r.*, CASE WHEN role0 = 'original_dialogue' AND span < 3000 THEN 'narration' ELSE role0 END AS role1 FROM r JOIN sp USING (seg_no, run))
SELECT seg_no, clip_pos, CASE WHEN role1 = 'narration' AND lag(role1) OVER w = 'original_dialogue' AND lead(role1) OVER w = 'original_dialogue' AND len <= 1200
  AND start_ms <= lag(end_ms) OVER w + 1000 AND lead(start_ms) OVER w <= end_ms + 1000 THEN 'original_dialogue' ELSE role1 END AS audio_role
FROM k WINDOW w AS (PARTITION BY seg_no ORDER BY clip_pos)
""",
)
def _(t):
    return au.smooth_roles(_signals(t), SEG).select("seg_no", "clip_pos", "audio_role")


SPLIT_SQL = """,
w AS (SELECT project_id, seg_no, clip_pos, clip_index, 2 * score - 5 AS v FROM sig),
p AS (SELECT *, sum(v) OVER (PARTITION BY seg_no) AS s, coalesce(sum(v) OVER (PARTITION BY seg_no ORDER BY clip_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w),
cand AS (SELECT project_id, seg_no, -s AS val, 0 AS rank, 'all_narration' AS pat, NULL AS pt FROM p WHERE clip_pos = 0
  UNION ALL SELECT project_id, seg_no, s, 1, 'all_original_audio', NULL FROM p WHERE clip_pos = 0
  UNION ALL SELECT project_id, seg_no, s - 2 * b, 2 * clip_pos, 'narration_then_original_audio', clip_index FROM p WHERE clip_pos > 0
  UNION ALL SELECT project_id, seg_no, 2 * b - s, 2 * clip_pos + 1, 'original_audio_then_narration', clip_index FROM p WHERE clip_pos > 0),
dec AS (SELECT project_id, seg_no, pat AS audio_pattern, pt AS split_clip_index FROM (SELECT *, row_number() OVER (PARTITION BY seg_no ORDER BY val DESC, rank) AS rn FROM cand) WHERE rn = 1)
"""


def _split(t):
    return au.best_split(_signals(t), SEG)


def _ranges_and_split(t):
    """Ranges, read several times by what follows, and their timing decisions."""
    ranges = cut_lineage(t.audio_ranges)
    return ranges, au.best_split(au.initial_signals(ranges, SEG), SEG)


@query("timing_decisions", "W19 F14", BASE + SIGNALS_SQL + SPLIT_SQL + "SELECT seg_no, audio_pattern, split_clip_index FROM dec")
def _(t):
    return _split(t).select("seg_no", "audio_pattern", "split_clip_index")


ROLES_SQL = """,
cl AS (SELECT r.project_id, r.seg_no, r.clip_pos, r.clip_index, r.start_ms, r.end_ms, coalesce(CASE audio_pattern WHEN 'all_original_audio' THEN true
   WHEN 'narration_then_original_audio' THEN clip_index >= split_clip_index WHEN 'original_audio_then_narration' THEN clip_index < split_clip_index ELSE false END, false) AS orig
   FROM audio_ranges r JOIN dec USING (seg_no)),
bl AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms > pe + 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY seg_no ORDER BY start_ms, clip_index ROWS UNBOUNDED PRECEDING) AS blk
   FROM (SELECT *, lag(end_ms) OVER (PARTITION BY seg_no ORDER BY start_ms, clip_index) AS pe FROM cl WHERE orig)),
bd AS (SELECT project_id, seg_no, blk, greatest(0, max_by(end_ms, (start_ms, clip_index)) - min(start_ms)) AS d, count(*) AS n FROM bl GROUP BY ALL),
blocks AS (SELECT project_id, seg_no, CAST(sum(n) AS BIGINT) AS clip_count, CAST(sum(d) AS BIGINT) AS original_ms, min(d) AS shortest_ms FROM bd GROUP BY ALL)
"""


@query("original_blocks", "G9 F16", BASE + SIGNALS_SQL + SPLIT_SQL + ROLES_SQL + "SELECT seg_no, clip_count, original_ms, shortest_ms FROM blocks")
def _(t):
    roles = au.clip_roles(*_ranges_and_split(t), SEG)
    return au.original_blocks(roles, SEG).select("seg_no", "clip_count", "original_ms", "shortest_ms")


LIMIT_SQL = """,
lim AS (SELECT project_id, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS total_ms, count(*) AS total_clips, CAST(sum(greatest(0, end_ms - start_ms)) * 30 AS BIGINT) AS max_ms_x100,
   CAST(ceil(count(*) * 30 / 100) AS BIGINT) AS max_clips FROM audio_ranges GROUP BY 1)
"""


@query("budget_totals", "G8", BASE + LIMIT_SQL + "SELECT * FROM lim")
def _(t):
    return au.budget_totals(t.audio_ranges, ["project_id"])


BUDGET_SQL = """,
elig AS (SELECT b.project_id, b.seg_no, clip_count, original_ms, 50.0::DOUBLE + least(25.0::DOUBLE, original_ms / 1000.0::DOUBLE) AS priority FROM blocks b WHERE shortest_ms >= 3000),
rk AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, seg_no) AS rn FROM elig),
gr AS (
  SELECT r.project_id, r.rn, r.seg_no, r.original_ms * 100 <= l.max_ms_x100 AND r.clip_count <= l.max_clips AS keep,
    CASE WHEN r.original_ms * 100 <= l.max_ms_x100 AND r.clip_count <= l.max_clips THEN r.original_ms ELSE 0 END AS used,
    CASE WHEN r.original_ms * 100 <= l.max_ms_x100 AND r.clip_count <= l.max_clips THEN r.clip_count ELSE 0 END AS usedc
  FROM rk r JOIN lim l USING (project_id) WHERE rn = 1
  UNION ALL
  SELECT r.project_id, r.rn, r.seg_no, (g.used + r.original_ms) * 100 <= l.max_ms_x100 AND g.usedc + r.clip_count <= l.max_clips,
    g.used + CASE WHEN (g.used + r.original_ms) * 100 <= l.max_ms_x100 AND g.usedc + r.clip_count <= l.max_clips THEN r.original_ms ELSE 0 END,
    g.usedc + CASE WHEN (g.used + r.original_ms) * 100 <= l.max_ms_x100 AND g.usedc + r.clip_count <= l.max_clips THEN r.clip_count ELSE 0 END
  FROM gr g JOIN rk r ON r.project_id = g.project_id AND r.rn = g.rn + 1 JOIN lim l ON l.project_id = r.project_id
),
bud AS (SELECT d.project_id, d.seg_no, CASE WHEN b.clip_count IS NULL OR keep THEN d.audio_pattern ELSE 'all_narration' END AS audio_pattern,
   CASE WHEN b.clip_count IS NULL OR keep THEN 'timing_rule' WHEN shortest_ms < 3000 THEN 'budget_min_original_block' ELSE 'budget_over_limit' END AS source,
   coalesce(b.clip_count, 0) AS clip_count, coalesce(b.original_ms, 0) AS original_ms, coalesce(keep, false) AS kept
   FROM dec d LEFT JOIN blocks b USING (seg_no) LEFT JOIN gr g ON g.seg_no = d.seg_no)
"""


def _budgeted(t):
    ranges, split = _ranges_and_split(t)
    decisions = cut_lineage(split.withColumn("priority", F.lit(None).cast("double")))
    roles = au.clip_roles(ranges, decisions, SEG)
    limits = au.budget_totals(ranges, ["project_id"])
    return au.apply_budget(decisions, au.original_blocks(roles, SEG), limits, ["project_id"]), limits


@query("audio_budget", "F15", BASE + SIGNALS_SQL + SPLIT_SQL + ROLES_SQL + LIMIT_SQL + BUDGET_SQL + "SELECT project_id, seg_no, audio_pattern, source, kept FROM bud")
def _(t):
    return _budgeted(t)[0].select("project_id", "seg_no", "audio_pattern", "source", "kept")


@query(
    "audio_budget_summary",
    "G15 G8",
    BASE
    + SIGNALS_SQL
    + SPLIT_SQL
    + ROLES_SQL
    + LIMIT_SQL
    + BUDGET_SQL
    + """
SELECT l.project_id, l.total_ms, l.total_clips, l.max_ms_x100, l.max_clips, count(*) FILTER (WHERE kept) AS kept_count,
  CAST(coalesce(sum(original_ms) FILTER (WHERE kept), 0) AS BIGINT) AS used_original_ms, CAST(coalesce(sum(clip_count) FILTER (WHERE kept), 0) AS BIGINT) AS used_original_clips,
  count(*) FILTER (WHERE source = 'budget_min_original_block') AS rejected_short, count(*) FILTER (WHERE source = 'budget_over_limit') AS rejected_budget, 0 AS fallback_count
FROM lim l JOIN bud USING (project_id) GROUP BY ALL
""",
)
def _(t):
    budgeted, limits = _budgeted(t)
    return au.budget_summary(budgeted, limits, ["project_id"])


@query(
    "greedy_budget_by_priority",
    "F15",
    ctes(DECISIONS_SQL)
    + """,
lim AS (SELECT project_id, sum(dur_ms) * 30 AS m, ceil(sum(clip_count) * 30 / 100) AS c FROM decisions GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, seg_no) AS rn FROM decisions),
gr AS (
  SELECT r.project_id, r.rn, r.seg_no, r.dur_ms * 100 <= m AND r.clip_count <= c AS kept, CASE WHEN r.dur_ms * 100 <= m AND r.clip_count <= c THEN r.dur_ms ELSE 0 END AS u,
    CASE WHEN r.dur_ms * 100 <= m AND r.clip_count <= c THEN r.clip_count ELSE 0 END AS k FROM rk r JOIN lim USING (project_id) WHERE rn = 1
  UNION ALL
  SELECT r.project_id, r.rn, r.seg_no, (g.u + r.dur_ms) * 100 <= m AND g.k + r.clip_count <= c,
    g.u + CASE WHEN (g.u + r.dur_ms) * 100 <= m AND g.k + r.clip_count <= c THEN r.dur_ms ELSE 0 END,
    g.k + CASE WHEN (g.u + r.dur_ms) * 100 <= m AND g.k + r.clip_count <= c THEN r.clip_count ELSE 0 END
  FROM gr g JOIN rk r ON r.project_id = g.project_id AND r.rn = g.rn + 1 JOIN lim l ON l.project_id = r.project_id)
SELECT project_id, seg_no, kept FROM gr
""",
)
def _(t):
    rows = t.decisions.withColumnRenamed("dur_ms", "original_ms")
    limits = rows.groupBy("project_id").agg(
        (F.sum("original_ms") * 30).alias("max_ms_x100"), F.ceil(F.sum("clip_count") * 30 / 100).cast("bigint").alias("max_clips")
    )
    return au.greedy_budget(rows, limits, ["project_id"], width=20).select("project_id", "seg_no", "kept")


@query(
    "audio_blocks",
    "F16 W6",
    BASE
    + SIGNALS_SQL
    + SPLIT_SQL
    + ROLES_SQL
    + """,
r AS (SELECT *, sum(CASE WHEN pr IS NULL OR pr <> orig THEN 1 ELSE 0 END) OVER (PARTITION BY seg_no ORDER BY clip_pos ROWS UNBOUNDED PRECEDING) AS blk
   FROM (SELECT *, lag(orig) OVER (PARTITION BY seg_no ORDER BY clip_pos) AS pr FROM cl))
SELECT seg_no, CAST(blk AS BIGINT) AS block_no, CASE WHEN orig THEN 'original_audio' ELSE 'narration' END AS type, string_agg(CAST(clip_index AS VARCHAR), ',' ORDER BY clip_pos) AS clip_indexes,
  min_by(start_ms, clip_pos) AS start_ms, max_by(end_ms, clip_pos) AS end_ms FROM r GROUP BY seg_no, blk, orig
""",
)
def _(t):
    blocks = au.audio_blocks(au.clip_roles(*_ranges_and_split(t), SEG), SEG)
    return blocks.select(
        "seg_no", "block_no", "type", F.concat_ws(",", F.transform("clip_indexes", lambda i: i.cast("string"))).alias("clip_indexes"), "start_ms", "end_ms"
    )


TEXTS_SQL = """,
tx AS (SELECT o_orderkey % 50 AS project_id, o_orderkey AS seg_no, o_orderpriority || ' status ' || o_orderstatus || ' of segment ' || o_orderkey AS old_text FROM orders)
"""


def texts(t):
    return t.orders.select(
        (F.col("o_orderkey") % 50).alias("project_id"),
        F.col("o_orderkey").alias("seg_no"),
        F.concat("o_orderpriority", F.lit(" status "), "o_orderstatus", F.lit(" of segment "), F.col("o_orderkey").cast("string")).alias("old_text"),
    )


@query(
    "narration_text_slices",
    "W12",
    BASE
    + SIGNALS_SQL
    + SPLIT_SQL
    + ROLES_SQL
    + TEXTS_SQL
    + """,
tm AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY seg_no ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, sum(len) OVER (PARTITION BY seg_no) AS tot
       FROM (SELECT *, greatest(0, end_ms - start_ms) AS len FROM cl)),
g AS (SELECT seg_no, count(*) AS n, count(*) FILTER (WHERE NOT orig) AS sp, max(tot) AS tot FROM tm GROUP BY 1),
pt AS (SELECT seg_no, clip_index, trim(substr(old_text, CAST((2 * length(old_text) * f + tot) // (2 * tot) + 1 AS BIGINT),
   CAST((2 * length(old_text) * (f + len) + tot) // (2 * tot) - (2 * length(old_text) * f + tot) // (2 * tot) AS BIGINT))) AS part FROM tm JOIN tx USING (seg_no) WHERE NOT orig AND tot > 0),
ps AS (SELECT seg_no, trim(string_agg(part, '' ORDER BY clip_index)) AS txt FROM pt GROUP BY 1)
SELECT tx.seg_no, CASE WHEN n IS NULL OR sp = 0 THEN '' WHEN sp = n OR tot <= 0 THEN old_text WHEN coalesce(txt, '') <> '' THEN txt ELSE old_text END AS narration_text
FROM tx LEFT JOIN g USING (seg_no) LEFT JOIN ps USING (seg_no)
""",
)
def _(t):
    roles = au.clip_roles(*_ranges_and_split(t), SEG)
    return au.narration_text(roles, texts(t), SEG).select("seg_no", "narration_text")


@query(
    "validated_model_decisions",
    "F17",
    BASE
    + """,
an AS (SELECT o_orderkey AS seg_no, CASE o_orderkey % 5 WHEN 0 THEN ' all_narration ' WHEN 1 THEN 'all_original_audio' WHEN 2 THEN 'narration_then_original_audio' WHEN 3 THEN 'original_audio_then_narration' ELSE 'something' END AS pat,
   o_orderkey % 6 AS sp, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 2000 END AS pr FROM orders),
ix AS (SELECT seg_no, min(clip_index) AS lo, count(*) AS n FROM audio_ranges GROUP BY 1),
v AS (SELECT an.*, trim(pat) AS p, coalesce(n >= 2 AND sp > lo AND EXISTS (SELECT 1 FROM audio_ranges r WHERE r.seg_no = an.seg_no AND r.clip_index = an.sp), false) AS okspl FROM an LEFT JOIN ix USING (seg_no)),
u AS (SELECT *, p IN ('all_narration', 'all_original_audio') AS plain, p IN ('all_narration', 'all_original_audio') OR (p IN ('narration_then_original_audio', 'original_audio_then_narration') AND okspl) AS usable FROM v)
SELECT seg_no, CASE WHEN usable THEN p ELSE 'all_narration' END AS audio_pattern, CASE WHEN usable AND NOT plain THEN sp END AS split_clip_index,
  CASE WHEN NOT usable OR p = 'all_narration' THEN 0 ELSE CAST(floor(greatest(0, least(100, coalesce(pr, 50))) * 1000 + 0.5) AS BIGINT) END AS priority_e3, CASE WHEN usable THEN 'model' ELSE 'fallback' END AS source FROM u
""",
)
def _(t):
    k = F.col("o_orderkey")
    pattern = (
        F.when(k % 5 == 0, " all_narration ").when(k % 5 == 1, "all_original_audio").when(k % 5 == 2, "narration_then_original_audio")
        .when(k % 5 == 3, "original_audio_then_narration").otherwise("something")
    )
    answers = t.orders.select(
        (k % 50).alias("project_id"), k.alias("seg_no"), pattern.alias("audio_pattern"), (k % 6).cast("string").alias("split_clip_index"),
        F.when(k % 9 != 0, F.col("o_totalprice") / 2_000).cast("string").alias("priority"),
    )
    checked = au.validate_model_decisions(answers, t.audio_ranges, SEG)
    return checked.select("seg_no", "audio_pattern", "split_clip_index", F.floor(F.col("priority") * 1_000 + 0.5).cast("bigint").alias("priority_e3"), "source")


@query(
    "model_fallback_decisions",
    "F17 F14",
    BASE
    + SIGNALS_SQL
    + SPLIT_SQL
    + """
SELECT seg_no, CASE WHEN seg_no % 3 = 0 THEN 'all_original_audio' ELSE audio_pattern END AS audio_pattern, CASE WHEN seg_no % 3 <> 0 THEN split_clip_index END AS split_clip_index,
  CASE WHEN seg_no % 3 = 0 THEN 'model' ELSE 'timing_fallback_after_model' END AS source FROM dec
""",
)
def _(t):
    keyed = t.audio_ranges.select(*SEG).distinct().where("seg_no % 3 <> 2")
    answers = keyed.select(
        *SEG, F.when(F.col("seg_no") % 3 == 0, "all_original_audio").otherwise("odd").alias("audio_pattern"),
        F.lit(None).cast("string").alias("split_clip_index"), F.lit("80").alias("priority"),
    )
    checked = au.validate_model_decisions(answers, t.audio_ranges, SEG)
    return au.fill_fallbacks(checked, _split(t), SEG).select("seg_no", "audio_pattern", "split_clip_index", "source")


ACTIONS = "CASE part_no % 6 WHEN 0 THEN 'manual_review' WHEN 1 THEN 'play_original_audio' WHEN 2 THEN 'play_original_audio' ELSE 'rewrite_and_voiceover' END"


def _acted(t):
    return t.clips.withColumn("audio_action", F.expr(ACTIONS))


@query(
    "segment_audio_roles",
    "G5",
    ctes(CLIPS_SQL)
    + f""",
a AS (SELECT item_no, {ACTIONS} AS act FROM clips)
SELECT item_no, CASE WHEN bool_or(act = 'manual_review') THEN 'manual_review' WHEN bool_and(act = 'rewrite_and_voiceover') THEN 'narration_overlay'
  WHEN bool_and(act = 'play_original_audio') THEN 'original_dialogue' ELSE 'mixed' END AS segment_audio_role FROM a GROUP BY 1
""",
)
def _(t):
    return au.segment_audio_role(_acted(t), ["item_no"])


@query(
    "range_audio_decisions",
    "G6",
    ctes(CLIPS_SQL)
    + f""",
a AS (SELECT item_no, clip_no, CASE WHEN item_no % 2 = 0 THEN 'original' ELSE 'voiceover' END AS audio_mode, {ACTIONS} AS act, flag AS role FROM clips)
SELECT item_no, audio_mode, CASE WHEN min(role) = max(role) THEN min(role) WHEN audio_mode = 'original' THEN 'original_dialogue' ELSE 'narration_overlay' END AS audio_role,
  CASE WHEN min(act) = max(act) THEN min(act) WHEN audio_mode = 'original' THEN 'play_original_audio' ELSE 'rewrite_and_voiceover' END AS audio_action,
  string_agg('range_' || clip_no, ',' ORDER BY clip_no) AS source_range_ids FROM a GROUP BY item_no, audio_mode
""",
)
def _(t):
    ranges = _acted(t).select(
        "item_no", F.col("clip_no").alias("range_pos"), F.concat(F.lit("range_"), F.col("clip_no").cast("string")).alias("range_id"),
        F.when(F.col("item_no") % 2 == 0, "original").otherwise("voiceover").alias("audio_mode"), "audio_action", F.col("flag").alias("audio_role"),
    )
    merged = au.range_audio_decision(ranges, ["item_no"])
    return merged.withColumn("source_range_ids", F.concat_ws(",", "source_range_ids"))


@query(
    "no_subtitle_shortcut",
    "F18",
    ctes(CLIPS_SQL) + "SELECT item_no, 'all_narration' AS audio_pattern FROM clips GROUP BY 1 HAVING bool_and(part_no % 3 <> 0)",
)
def _(t):
    ranges = t.clips.withColumn("subtitle_text", F.when(F.col("part_no") % 3 == 0, "words").otherwise(" "))
    return au.no_subtitle_shortcut(ranges, ["item_no"]).select("item_no", "audio_pattern")
