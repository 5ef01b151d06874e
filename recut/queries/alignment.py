"""Alignment of reference shots: full localisation, overrides, timeline rows, summary and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from recut.operators import similarity as sim
from recut.operators.runs import pivot_top
from recut.plans import alignment as al
from recut.queries.domain import FRAMES_SQL, SHOT_VECTORS_SQL
from recut.queries.registry import ctes, query
from recut.queries.similarity import POOL_SQL, e6

P = ["project_id"]


def _sides(t):
    """Shots of ten frames; reference and source shots numbered densely."""
    shot = F.floor(F.col("vec_id") / 10).cast("bigint")
    frames = t.embeddings.select(
        F.lit(0).cast("bigint").alias("project_id"),
        shot.alias("shot_no"),
        (F.col("vec_id") % 10).alias("frame_pos"),
        F.col("embedding").alias("vec"),
        (1_000 + (shot * 7) % 13 * 250).cast("bigint").alias("dur_ms"),
    )
    keys = ["project_id", "shot_no"]
    shots = sim.mean_pool(frames, [*keys, "dur_ms"], "frame_pos", "vec").join(sim.pack_vectors(frames, P), keys)
    ref_no, movie_no = F.floor(F.col("shot_no") / 5), F.col("shot_no") - F.floor(F.col("shot_no") / 5) - 1
    refs = shots.where("shot_no % 5 = 0").withColumn("ref_no", ref_no).drop("shot_no")
    movies = shots.where("shot_no % 5 <> 0").withColumn("movie_no", movie_no).drop("shot_no")
    local = t.local_features
    return (
        refs,
        movies,
        local.where("side = 'ref'").withColumn("shot_no", ref_no),
        local.where("side = 'movie'").withColumn("shot_no", movie_no),
    )


@query("localize_shots", "J19")
def _(t):
    found = al.localize(*_sides(t), P)
    return found.select("ref_no", "movie_no", "rank", e6(F.col("score"), "score_e6"), "inliers", e6(F.col("support"), "support_e6"))


@query("aligned_catalogue", "J19 J20 J9")
def _(t):
    refs, movies, ref_local, movie_local = _sides(t)
    found = al.localize(refs, movies, ref_local, movie_local, P)
    overrides = refs.where("ref_no % 7 = 3").select("project_id", "ref_no", F.col("ref_no").alias("movie_no"))
    candidates = al.apply_overrides(found, overrides, refs, movies, P)
    timed = lambda df, no, prefix: df.select(
        "project_id",
        no,
        F.concat(F.lit(prefix), F.col(no).cast("string")).alias("ref_shot_id" if no == "ref_no" else "movie_shot_id"),
        (F.col(no) * 4_000).alias("start_ms"),
        (F.col(no) * 4_000 + F.col("dur_ms")).alias("end_ms"),
        F.lit(True).alias("has_features"),
    )
    rows = al.alignment_timeline(timed(refs, "ref_no", "ref_"), timed(movies, "movie_no", "movie_"), candidates, P)
    return rows.select("ref_shot_id", "movie_start_ms", "status", "confidence", F.size("candidates").alias("candidate_count"))


CAND_SQL = (
    ctes(SHOT_VECTORS_SQL)
    + """,
s AS (SELECT r.shot_no // 5 AS ref_no, m.shot_no AS movie_no, round(list_dot_product(r.vec, m.vec), 9) AS score
      FROM shot_vectors r JOIN shot_vectors m ON r.project_id = m.project_id WHERE r.side = 'ref' AND m.side = 'movie' AND r.shot_no % 15 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY ref_no ORDER BY score DESC, movie_no DESC) AS rank, (ref_no * 7 + movie_no) % 30 AS inliers FROM s),
cand AS (SELECT *, floor(least(1, greatest(0, score * 2)) * 10000 + 0.5) / 10000 AS fs, least(1, greatest(0, score * 2)) AS cs FROM k WHERE rank <= 5),
agg AS (SELECT ref_no, max(cs) FILTER (WHERE rank = 1) AS score, max(inliers) FILTER (WHERE rank = 1) AS inliers, max(movie_no) FILTER (WHERE rank = 1) AS movie_no,
        max(fs) FILTER (WHERE rank > 1) AS other FROM cand GROUP BY 1),
j AS (SELECT shot_no // 5 AS ref_no, (shot_no // 5) % 11 <> 0 AS has, a.score, a.inliers, a.movie_no,
        floor((a.score - a.other) * 10000 + 0.5) / 10000 AS gap FROM shot_vectors v LEFT JOIN agg a ON a.ref_no = v.shot_no // 5 WHERE side = 'ref'),
lv AS (SELECT *, CASE WHEN score >= 0.72 AND inliers >= 20 AND gap >= 0.03 THEN 'high' WHEN score >= 0.55 OR inliers >= 8 THEN 'medium' ELSE 'low' END AS lvl FROM j),
matches AS (SELECT ref_no, 'ref_' || ref_no AS ref_shot_id, CASE WHEN has THEN movie_no * 4000 END AS movie_start_ms,
  CASE WHEN has AND movie_no IS NOT NULL THEN 'movie_' || movie_no END AS shot,
  CASE WHEN NOT has OR score IS NULL THEN 'low' ELSE lvl END AS confidence,
  CASE WHEN NOT has THEN 'missing_reference_clip' WHEN score IS NULL THEN 'localization_failed' WHEN score < 0.35 THEN 'needs_review'
       WHEN lvl = 'low' OR inliers < 8 THEN 'matched_low_confidence' ELSE 'matched' END AS status,
  CASE WHEN has THEN CAST(floor(coalesce(score, 0) * 10000 + 0.5) AS BIGINT) ELSE 0 END AS score_e4,
  CASE WHEN has THEN CAST(floor(coalesce(gap, 0) * 10000 + 0.5) AS BIGINT) ELSE 0 END AS gap_e4,
  CASE WHEN has THEN coalesce(inliers, 0) ELSE 0 END AS inliers
  FROM lv)
"""
)


def _matches(t):
    vectors = t.shot_vectors
    refs = vectors.where("side = 'ref'").withColumn("ref_no", F.floor(F.col("shot_no") / 5))
    movies = vectors.where("side = 'movie'").withColumnRenamed("shot_no", "movie_no")
    asked = refs.where("shot_no % 15 <> 0")
    best = sim.cosine_top_k(asked, movies, P, 5)
    candidates = best.select(
        *P, "ref_no", "movie_no", "rank",
        (F.col("score") * 2).alias("score"),
        F.lit(0.5).alias("geometry"),
        ((F.col("ref_no") * 7 + F.col("movie_no")) % 30).alias("inliers"),
        F.lit(9).cast("bigint").alias("good_matches"),
        *[F.col("score").alias(c) for c in ("local_score", "global_score", "fine_score")],
        F.lit(0.0).alias("support"),
        F.lit(False).alias("manual_override"),
    )
    ref_rows = refs.select(
        *P, "ref_no",
        F.concat(F.lit("ref_"), F.col("ref_no").cast("string")).alias("ref_shot_id"),
        (F.col("ref_no") * 1_000).alias("start_ms"),
        (F.col("ref_no") * 1_000 + F.col("dur_ms")).alias("end_ms"),
        (F.col("ref_no") % 11 != 0).alias("has_features"),
    )
    movie_rows = movies.select(
        *P, "movie_no",
        F.concat(F.lit("movie_"), F.col("movie_no").cast("string")).alias("movie_shot_id"),
        (F.col("movie_no") * 4_000).alias("start_ms"),
        (F.col("movie_no") * 4_000 + F.col("dur_ms")).alias("end_ms"),
    )
    return al.alignment_timeline(ref_rows, movie_rows, candidates, P)


@query("alignment_timeline", "J20 P16 P17 W16", CAND_SQL + "SELECT * EXCLUDE (shot), shot AS movie_shot FROM matches")
def _(t):
    e4 = lambda c, n: F.floor(F.col(c) * 10_000 + 0.5).cast("bigint").alias(n)
    return _matches(t).select(
        "ref_no", "ref_shot_id", "movie_start_ms", F.try_element_at("movie_shot_ids", F.lit(1)).alias("movie_shot"),
        "confidence", "status", e4("match_score", "score_e4"), e4("score_gap", "gap_e4"), F.col("geometry_inliers").alias("inliers"),
    )


@query(
    "alignment_summary",
    "G3 W9 W10",
    CAND_SQL
    + """,
p AS (SELECT *, last_value(movie_start_ms IGNORE NULLS) OVER (ORDER BY ref_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM matches)
SELECT count(*) AS total_ref_shots, count(*) FILTER (WHERE status LIKE 'matched%') AS matched_count,
  count(*) FILTER (WHERE confidence = 'high') AS high_confidence_count,
  count(*) FILTER (WHERE confidence = 'low' OR status NOT LIKE 'matched%') AS manual_review_count,
  count(*) FILTER (WHERE movie_start_ms < prev - 500) AS timeline_backward_count,
  count(shot) - count(DISTINCT shot) AS duplicate_movie_shot_count,
  CAST(floor(count(*) FILTER (WHERE status LIKE 'matched%') * 10000.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS matched_rate_e4
FROM p
""",
)
def _(t):
    summary = al.alignment_summary(_matches(t), P, width=20)
    return summary.select(
        "total_ref_shots", "matched_count", "high_confidence_count", "manual_review_count", "timeline_backward_count",
        "duplicate_movie_shot_count", F.floor(F.col("matched_rate") * 10_000 + 0.5).cast("bigint").alias("matched_rate_e4"),
    )


@query(
    "low_confidence_report",
    "B7",
    CAND_SQL
    + "SELECT ref_shot_id, status, confidence, score_e4 FROM matches WHERE confidence = 'low' OR status NOT LIKE 'matched%'",
)
def _(t):
    from recut.sinks.reports import low_confidence_report

    report = low_confidence_report(_matches(t), P)
    return report.select(
        "ref_shot_id", "status", "confidence", F.floor(F.col("match_score") * 10_000 + 0.5).cast("bigint").alias("score_e4")
    )


@query(
    "match_manifest",
    "B6 K3",
    CAND_SQL
    + """,
t3 AS (SELECT ref_no, max(movie_no) FILTER (WHERE rank = 1) AS m1, max(movie_no) FILTER (WHERE rank = 2) AS m2, max(movie_no) FILTER (WHERE rank = 3) AS m3,
   max(fs) FILTER (WHERE rank = 3) AS f3 FROM cand GROUP BY 1)
SELECT ref_shot_id AS ref_name, shot AS movie_name, status, confidence, inliers AS geometry_inliers,
  'movie_' || m1 AS top1_movie_shot_id, 'movie_' || m2 AS top2_movie_shot_id, 'movie_' || m3 AS top3_movie_shot_id,
  CAST(floor(f3 * 10000 + 0.5) AS BIGINT) AS top3_e4
FROM matches JOIN t3 USING (ref_no) WHERE shot IS NOT NULL
""",
)
def _(t):
    from recut.sinks.reports import match_manifest

    rows = match_manifest(_matches(t))
    return rows.select(
        "ref_name", "movie_name", "status", "confidence", "geometry_inliers",
        "top1_movie_shot_id", "top2_movie_shot_id", "top3_movie_shot_id",
        F.floor(F.col("top3_score") * 10_000 + 0.5).cast("bigint").alias("top3_e4"),
    )


@query(
    "manual_overrides",
    "J9",
    ctes(FRAMES_SQL)
    + POOL_SQL
    + """,
o AS (SELECT r.shot_no AS ref_no, r.shot_no + 2 AS movie_no FROM pool r WHERE r.side = 'ref' AND r.shot_no % 2 = 0),
ff AS (SELECT o.ref_no, o.movie_no, a.frame_pos AS fa, b.frame_pos AS fb, list_dot_product(a.vec, b.vec) AS s
       FROM o JOIN frames a ON a.shot_no = o.ref_no JOIN frames b ON b.shot_no = o.movie_no AND b.side = 'movie'),
ra AS (SELECT ref_no, movie_no, avg(x) AS m FROM (SELECT ref_no, movie_no, fa, max(s) AS x FROM ff GROUP BY ALL) GROUP BY ALL),
rb AS (SELECT ref_no, movie_no, avg(x) AS m FROM (SELECT ref_no, movie_no, fb, max(s) AS x FROM ff GROUP BY ALL) GROUP BY ALL)
,
forced AS (SELECT o.ref_no, o.movie_no, 999 AS inliers,
 CAST(floor(greatest(0, least(1, 0.45::DOUBLE * list_dot_product(r.clip, m.clip) + 0.45::DOUBLE * ((ra.m + rb.m) / 2) + 0.10::DOUBLE * (least(r.dur_ms, m.dur_ms) / greatest(r.dur_ms, m.dur_ms)::DOUBLE))) * 1000000 + 0.5) AS BIGINT) AS score_e6
FROM o JOIN pool r ON r.shot_no = o.ref_no JOIN pool m ON m.shot_no = o.movie_no JOIN ra USING (ref_no, movie_no) JOIN rb USING (ref_no, movie_no)),
found AS (SELECT r.shot_no AS ref_no, m.shot_no AS movie_no, round(list_dot_product(r.clip, m.clip), 9) AS score FROM pool r JOIN pool m ON r.side = 'ref' AND m.side = 'movie'),
best AS (SELECT *, row_number() OVER (PARTITION BY ref_no ORDER BY score DESC, movie_no DESC) AS rank FROM found)
SELECT ref_no, movie_no, 1 AS rank, true AS manual_override, inliers, score_e6 FROM forced
UNION ALL SELECT ref_no, movie_no, rank, false, 0, CAST(floor(score * 1000000 + 0.5) AS BIGINT) FROM best WHERE rank <= 3 AND ref_no NOT IN (SELECT ref_no FROM forced)
""",
)
def _(t):
    frames = t.frames
    shots = sim.mean_pool(frames, ["project_id", "shot_no", "side", "dur_ms"], "frame_pos", "vec").join(
        sim.pack_vectors(frames, P), ["project_id", "shot_no"]
    )
    refs = shots.where("side = 'ref'").withColumnRenamed("shot_no", "ref_no")
    movies = shots.where("side = 'movie'").withColumnRenamed("shot_no", "movie_no")
    overrides = refs.where("ref_no % 2 = 0").select("project_id", "ref_no", (F.col("ref_no") + 2).alias("movie_no"))
    found = sim.cosine_top_k(refs, movies, P, 3, size=256).select(
        *P, "ref_no", "movie_no", "rank", "score", F.lit(0.0).alias("geometry"),
        F.lit(0).cast("bigint").alias("inliers"), F.lit(0).cast("bigint").alias("good_matches"), F.col("score").alias("global_score"),
        *[F.lit(0.0).alias(c) for c in ("local_score", "fine_score", "support")],
    )
    candidates = al.apply_overrides(found, overrides, refs, movies, P)
    return candidates.select("ref_no", "movie_no", "rank", "manual_override", "inliers", e6(F.col("score"), "score_e6"))
