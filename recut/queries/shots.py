"""Shot boundaries and frame positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from recut.operators import shots
from recut.queries.domain import FRAME_SCORES_SQL, INTERVALS_SQL, REF_SHOTS_SQL
from recut.queries.registry import ctes, query

SCORES = ctes(INTERVALS_SQL, FRAME_SCORES_SQL)

CUTOFF_SQL = """,
sc AS (SELECT media_id, frame_no, score_m / 1000.0::DOUBLE AS score FROM frame_scores),
md AS (SELECT media_id, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.958) AS high FROM sc GROUP BY 1),
mad AS (SELECT media_id, quantile_cont(abs(score - median), 0.5) AS mad FROM sc JOIN md USING (media_id) GROUP BY 1),
cut AS (SELECT media_id, median, mad, greatest(0.045::DOUBLE, median + 2.2::DOUBLE * greatest(mad, 0.002::DOUBLE), high) AS cutoff FROM md JOIN mad USING (media_id))
"""


def scored(t):
    return t.frame_scores.select("media_id", "frame_no", (F.col("score_m") / 1000.0).alias("score"))


@query(
    "adaptive_cut_threshold",
    "G1",
    SCORES
    + CUTOFF_SQL
    + """
SELECT media_id, CAST(floor(median * 100000 + 0.5) AS BIGINT) AS median_e5, CAST(floor(mad * 100000 + 0.5) AS BIGINT) AS mad_e5,
       CAST(floor(cutoff * 100000 + 0.5) AS BIGINT) AS cutoff_e5 FROM cut
""",
)
def _(t):
    cut = shots.adaptive_cut_threshold(scored(t), ["media_id"], "score", 0.3)
    e5 = lambda c: F.floor(F.col(c) * 100_000 + 0.5).cast("bigint").alias(f"{c}_e5")
    return cut.select("media_id", e5("median"), e5("mad"), e5("cutoff"))


CUTS_SQL = """,
nb AS (SELECT *, coalesce(lag(score) OVER w, -1) AS l, coalesce(lead(score) OVER w, -1) AS r FROM sc WINDOW w AS (PARTITION BY media_id ORDER BY frame_no)),
cand AS (SELECT nb.media_id, frame_no FROM nb JOIN cut USING (media_id) WHERE score >= cutoff AND score >= l AND score >= r),
rec AS (
  SELECT media_id, min(frame_no) AS frame_no FROM cand WHERE frame_no >= 9 GROUP BY media_id
  UNION ALL
  SELECT rec.media_id, (SELECT min(c.frame_no) FROM cand c WHERE c.media_id = rec.media_id AND c.frame_no >= rec.frame_no + 9) AS frame_no
  FROM rec WHERE EXISTS (SELECT 1 FROM cand c WHERE c.media_id = rec.media_id AND c.frame_no >= rec.frame_no + 9)
)
"""


@query("select_cuts", "W1", SCORES + CUTOFF_SQL + CUTS_SQL + "SELECT media_id, frame_no FROM rec")
def _(t):
    frames = scored(t)
    cut = shots.adaptive_cut_threshold(frames, ["media_id"], "score", 0.3)
    return shots.select_cuts(frames, cut, ["media_id"], fps=25.0, width=2_000)


@query(
    "cut_scenes",
    "W1 W4",
    SCORES
    + CUTOFF_SQL
    + CUTS_SQL
    + """,
op AS (SELECT media_id, frame_no AS s FROM rec UNION ALL SELECT DISTINCT media_id, 0 FROM sc),
n AS (SELECT media_id, max(frame_no) + 1 AS n FROM sc GROUP BY 1)
SELECT media_id, s AS start_frame, coalesce(lead(s) OVER (PARTITION BY media_id ORDER BY s), n) - 1 AS end_frame FROM op JOIN n USING (media_id)
""",
)
def _(t):
    frames = scored(t)
    cut = shots.adaptive_cut_threshold(frames, ["media_id"], "score", 0.3)
    cuts = shots.select_cuts(frames, cut, ["media_id"], fps=25.0, width=2_000)
    counts = frames.groupBy("media_id").agg((F.max("frame_no") + 1).alias("frame_count"))
    return shots.cuts_to_scenes(cuts, counts, ["media_id"], width=2_000)


SCENES_SQL = """,
fr AS (SELECT media_id, frame_no - 1 AS f, prob_m > 700 AS above FROM frame_scores),
nx AS (SELECT *, lead(f) OVER w AS nf, lag(above) OVER w AS pa FROM fr WINDOW w AS (PARTITION BY media_id ORDER BY f)),
rn AS (SELECT *, sum(CASE WHEN pa IS NULL OR pa <> above THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS run FROM nx),
scenes AS (SELECT media_id, min(f) AS start_frame, max(coalesce(nf, f)) AS end_frame FROM rn WHERE NOT above GROUP BY media_id, run
           UNION ALL SELECT media_id, min(f), max(f) FROM fr GROUP BY media_id HAVING bool_and(above))
"""


def _scenes(t):
    probs = t.frame_scores.select("media_id", (F.col("frame_no") - 1).alias("frame_idx"), "prob_m")
    return shots.probs_to_scenes(probs, ["media_id"], above=F.col("prob_m") > 700, width=2_000)


@query("probability_scenes", "W2", SCORES + SCENES_SQL + "SELECT media_id, start_frame, end_frame FROM scenes")
def _(t):
    return _scenes(t)


@query(
    "normalize_scenes",
    "W4",
    SCORES
    + SCENES_SQL
    + """,
-- every third scene is stretched so that it reaches into the next ones
raw AS (SELECT media_id, start_frame AS s, end_frame + CASE WHEN start_frame % 3 = 0 THEN 3 ELSE 0 END AS e FROM scenes),
cl AS (SELECT s.media_id, greatest(0, s) AS s, least(n - 1, e) AS e, row_number() OVER (PARTITION BY s.media_id ORDER BY s, e) AS rn
       FROM raw s JOIN (SELECT media_id, count(*) AS n FROM fr GROUP BY 1) USING (media_id) WHERE least(n - 1, e) >= greatest(0, s)),
fold AS (
  SELECT media_id, rn, s AS os, e AS le, true AS opened, true AS kept FROM cl WHERE rn = 1
  UNION ALL
  SELECT c.media_id, c.rn, CASE WHEN c.s <= f.le THEN f.os WHEN c.e - c.s + 1 >= 4 THEN c.s ELSE f.os END,
         CASE WHEN c.s <= f.le THEN c.e WHEN c.e - c.s + 1 >= 4 THEN c.e ELSE f.le END,
         NOT c.s <= f.le AND c.e - c.s + 1 >= 4, c.s <= f.le OR c.e - c.s + 1 >= 4
  FROM fold f JOIN cl c ON c.media_id = f.media_id AND c.rn = f.rn + 1
)
SELECT media_id, os AS start_frame, max_by(le, rn) AS end_frame FROM fold GROUP BY media_id, os
""",
)
def _(t):
    stretch = F.when(F.col("start_frame") % 3 == 0, 3).otherwise(0)
    counts = t.frame_scores.groupBy("media_id").agg(F.count(F.lit(1)).alias("frame_count"))
    raw = _scenes(t).withColumn("end_frame", F.col("end_frame") + stretch).join(counts, "media_id")
    return shots.normalize_scenes(raw, ["media_id"], min_frames=4, width=2_000)


@query(
    "keyframe_times",
    "P11 P12 P13",
    ctes(INTERVALS_SQL, REF_SHOTS_SQL)
    + """
SELECT media_id, printf('ref_shot_%03d', shot_no) AS shot_id, 'fifth_' || CAST(i + 1 AS VARCHAR) AS role,
  CAST(floor(start_ms + greatest(1, end_ms - start_ms) * p + 0.5) AS BIGINT) AS time_ms
FROM ref_shots, (VALUES (0, 0.12::DOUBLE), (1, 0.5::DOUBLE), (2, 0.88::DOUBLE)) v(i, p) WHERE end_ms > start_ms
""",
)
def _(t):
    usable = t.ref_shots.where("end_ms > start_ms")
    timed = shots.keyframe_times(usable, shots.position_array(F.lit(".5,.88,.12,.5")), 25.0)
    return timed.select("media_id", F.format_string("ref_shot_%03d", "shot_no").alias("shot_id"), "role", "time_ms")


@query(
    "sample_times",
    "P14",
    ctes(INTERVALS_SQL, REF_SHOTS_SQL)
    + """,
n AS (SELECT *, CAST(end_ms - start_ms AS DOUBLE) AS len, CAST(least(4, greatest(1, floor((end_ms - start_ms) * 0.2::DOUBLE / 1000 + 0.5))) AS INTEGER) AS n
      FROM ref_shots WHERE end_ms > start_ms),
x AS (SELECT *, unnest(range(n)) AS i, least(len * 0.08::DOUBLE, 250.0::DOUBLE) AS mg FROM n)
SELECT media_id, shot_no, i AS sample_no, CAST(floor(CASE WHEN n = 1 THEN (start_ms + end_ms) / 2 ELSE start_ms + mg + (len - 2 * mg) / (n - 1) * i END + 0.5) AS BIGINT) AS time_ms FROM x
""",
)
def _(t):
    sampled = shots.sample_times(t.ref_shots, 0.2, 4)
    return sampled.select("media_id", "shot_no", F.col("sample_no").cast("bigint").alias("sample_no"), "time_ms")


@query(
    "interior_keyframes",
    "P15",
    """
WITH d AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS f FROM documents),
p AS (SELECT doc_id, f, len(f) AS n, unnest([1, 2, 3, 4]) AS i FROM d),
x AS (SELECT doc_id, i, n, f, CASE WHEN n <= 2 OR n = 4 THEN i - 1
   ELSE greatest(1, least(n - 2, CAST(round_even(i / 5.0::DOUBLE * (n - 1), 0) AS BIGINT))) END AS k FROM p),
w AS (SELECT doc_id, f[k + 1] AS w, min(i) AS o FROM x WHERE k < n GROUP BY ALL)
SELECT doc_id, string_agg(w, ' ' ORDER BY o) AS keyframes FROM w GROUP BY doc_id
""",
)
def _(t):
    frames = F.split("text", r"\s+")
    return t.documents.select(
        "doc_id", F.concat_ws(" ", shots.select_keyframes(frames, 4)).alias("keyframes")
    )


@query(
    "overlapped_window_stitch",
    "W17",
    SCORES
    + """,
fr AS (SELECT media_id, frame_no - 1 AS f, score_m AS v, count(*) OVER (PARTITION BY media_id) AS n FROM frame_scores),
sz AS (SELECT DISTINCT media_id, n, 25 + n + 25 + 50 - (CASE WHEN n % 50 <> 0 THEN n % 50 ELSE 50 END) AS padded FROM fr),
slots AS (SELECT media_id, n, w, j, greatest(0, least(n - 1, 50 * w + j - 25)) AS f
          FROM (SELECT media_id, n, unnest(range((padded - 100) // 50 + 1)) AS w FROM sz), range(100) r(j)),
win AS (SELECT s.media_id, w, sum(v) AS total FROM slots s JOIN fr USING (media_id, f) GROUP BY ALL)
SELECT s.media_id, 50 * s.w + s.j - 25 AS frame_idx, v AS score, CAST(total AS BIGINT) AS window_total
FROM slots s JOIN win USING (media_id, w) JOIN fr ON fr.media_id = s.media_id AND fr.f = 50 * s.w + s.j - 25 WHERE j BETWEEN 25 AND 74
""",
)
def _(t):
    frames = t.frame_scores.select("media_id", (F.col("frame_no") - 1).alias("frame_idx"), F.col("score_m").alias("score"))
    counts = frames.groupBy("media_id").agg(F.count(F.lit(1)).alias("frame_count"))
    slots = shots.overlapped_windows(frames, ["media_id"], frame="frame_idx")
    totals = slots.groupBy("media_id", "window_no").agg(F.sum("score").alias("window_total"))
    predicted = slots.select("media_id", "window_no", "slot", "score").join(totals, ["media_id", "window_no"])
    return shots.stitch_windows(predicted, ["media_id"], counts)


@query(
    "shots_from_scenes",
    "W4 P11",
    SCORES
    + SCENES_SQL
    + """
SELECT media_id, start_frame, end_frame, CAST(floor(start_frame / 25.0::DOUBLE * 1000 + 0.5) AS BIGINT) AS start_ms,
  CAST(floor(least(30.0::DOUBLE, (end_frame + 1) / 25.0::DOUBLE) * 1000 + 0.5) AS BIGINT) AS end_ms
FROM scenes
""",
)
def _(t):
    media = t.frame_scores.select("media_id").distinct().select("media_id", F.lit(25.0).alias("fps"), F.lit(30.0).alias("duration"))
    timed = shots.shots_from_scenes(_scenes(t), media, ["media_id"])
    ms = lambda c: F.floor(F.col(c) * 1_000 + 0.5).cast("bigint").alias(f"{c}_ms")
    return timed.select("media_id", "start_frame", "end_frame", ms("start"), ms("end"))
