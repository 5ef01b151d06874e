"""Picture similarity, retrieval and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from recut.operators import similarity as sim
from recut.queries.domain import AUDIO_RESULTS_SQL, CLIPS_SQL, FRAME_SCORES_SQL, FRAMES_SQL, INTERVALS_SQL, LOCAL_SQL, SHOT_VECTORS_SQL, WORDS_SQL
from recut.queries.registry import ctes, query
from recut.session import cut_lineage

P = ["project_id"]


def e6(column, name):
    return F.floor(column * 1_000_000 + 0.5).cast("bigint").alias(name)


def ref_side(df, no="ref_no"):
    return df.where("side = 'ref'").withColumnRenamed("shot_no", no)


def movie_side(df, no="movie_no"):
    return df.where("side = 'movie'").withColumnRenamed("shot_no", no)


@query(
    "mean_pooled_shots",
    "G2",
    ctes(FRAMES_SQL)
    + """,
d AS (SELECT shot_no, unnest(range(64)) AS i, vec FROM frames),
m AS (SELECT shot_no, i, avg(vec[i + 1]) AS x FROM d GROUP BY ALL),
n AS (SELECT shot_no, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1)
SELECT shot_no, i AS dim, CAST(floor(x / norm * 1000000 + 0.5) AS BIGINT) AS value_e6 FROM m JOIN n USING (shot_no)
""",
)
def _(t):
    pooled = sim.mean_pool(t.frames, ["project_id", "shot_no"], "frame_pos", "vec")
    out = pooled.select("shot_no", F.posexplode("vec").alias("dim", "x"))
    return out.select("shot_no", F.col("dim").cast("bigint").alias("dim"), e6(F.col("x"), "value_e6"))


@query(
    "cosine_top_k",
    "J10 K1",
    ctes(SHOT_VECTORS_SQL)
    + """,
s AS (SELECT r.shot_no AS ref_no, m.shot_no AS movie_no, round(list_dot_product(r.vec, m.vec), 9) AS score
      FROM shot_vectors r JOIN shot_vectors m ON r.project_id = m.project_id WHERE r.side = 'ref' AND m.side = 'movie'),
k AS (SELECT *, row_number() OVER (PARTITION BY ref_no ORDER BY score DESC, movie_no DESC) AS rank FROM s)
SELECT ref_no, movie_no, rank, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score_e6 FROM k WHERE rank <= 15
""",
)
def _(t):
    vectors = t.shot_vectors
    best = sim.cosine_top_k(ref_side(vectors), movie_side(vectors), P, 15, size=256)
    return best.select("ref_no", "movie_no", "rank", e6(F.col("score"), "score_e6"))


TFIDF_SQL = """,
movie AS (SELECT * FROM {counts} WHERE {movie}),
tot AS (SELECT count(*) AS nn FROM {universe}),
dfs AS (SELECT hash, count(*) AS df, ln((nn + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM movie, tot GROUP BY hash, nn),
mw AS (SELECT shot_no, hash, ln(1 + n::DOUBLE) * idf AS w FROM movie JOIN dfs USING (hash)),
mn AS (SELECT shot_no, sqrt(sum(w * w)) AS norm FROM mw GROUP BY 1),
ix AS (SELECT shot_no, hash, CASE WHEN norm > 1e-6 THEN w / norm ELSE w END AS weight FROM mw JOIN mn USING (shot_no)),
qw AS (SELECT shot_no, hash, ln(1 + c.n::DOUBLE) * coalesce(idf, ln(t.nn + 1.0::DOUBLE) + 1.0::DOUBLE) AS w FROM {counts} c LEFT JOIN dfs USING (hash), tot t WHERE {ref}),
qn AS (SELECT shot_no, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
qs AS (SELECT shot_no, hash, CASE WHEN norm > 1e-6 THEN w / norm ELSE w END AS weight FROM qw JOIN qn USING (shot_no)),
sc AS (SELECT q.shot_no AS ref_no, m.shot_no AS movie_no, round(sum(q.weight * m.weight), 9) AS score FROM qs q JOIN ix m USING (hash) GROUP BY ALL)
"""
WORDS_TFIDF = ctes(WORDS_SQL) + TFIDF_SQL.format(
    counts="words", movie="shot_no % 5 <> 0", ref="c.shot_no % 5 = 0", universe="documents WHERE doc_id % 5 <> 0"
)


def _word_index(t):
    counts = cut_lineage(t.words)
    shots = t.documents.where("doc_id % 5 <> 0").select(F.lit(0).cast("bigint").alias("project_id"), "doc_id")
    source, asked = counts.where("shot_no % 5 <> 0"), counts.where("shot_no % 5 = 0")
    idf = sim.inverse_frequencies(source, shots, P)
    totals = shots.groupBy(*P).agg(F.count(F.lit(1)).alias("__total"))
    return sim.tfidf_weights(source, idf, P, also=["df", "hash_no"]), sim.tfidf_weights(asked, idf, P, totals, also=["hash_no"])


@query(
    "tfidf_index",
    "J11",
    WORDS_TFIDF + "SELECT shot_no, hash, df, CAST(floor(weight * 1000000 + 0.5) AS BIGINT) AS weight_e6 FROM ix JOIN dfs USING (hash)",
)
def _(t):
    index, _ = _word_index(t)
    return index.select("shot_no", "hash", "df", e6(F.col("weight"), "weight_e6"))


@query(
    "tfidf_retrieve",
    "J12 K1",
    WORDS_TFIDF
    + """,
k AS (SELECT *, row_number() OVER (PARTITION BY ref_no ORDER BY score DESC, movie_no DESC) AS rank FROM sc WHERE score > 0)
SELECT ref_no, movie_no, rank, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score_e6 FROM k WHERE rank <= 30
""",
)
def _(t):
    index, asked = _word_index(t)
    # Words the index never saw count in the length of an asked document only.
    by_number = lambda df: df.where("hash_no is not null").select(*P, "shot_no", F.col("hash_no").alias("hash"), "weight")
    best = sim.tfidf_top_k(by_number(asked), by_number(index), P, 30)
    return best.select("ref_no", "movie_no", "rank", e6(F.col("score"), "score_e6"))


LOCAL_COUNTS_SQL = """
hashed AS (SELECT project_id, shot_no, side, {byte} FROM local),
hash_counts AS (SELECT project_id, shot_no, side, hash, count(*) AS n FROM (
  SELECT project_id, shot_no, side, unnest([{hashes}]) AS hash FROM hashed) GROUP BY ALL)
""".format(
    byte=", ".join(f"(w{i // 8} >> {56 - 8 * (i % 8)}) & 255 AS b{i}" for i in sorted({b for p in sim.HASH_BYTE_PAIRS for b in p})),
    hashes=", ".join(f"b{left} * 16 + (b{right} & 15) + {k * 4096}" for k, (left, right) in enumerate(sim.HASH_BYTE_PAIRS)),
)


HASH_TOP = 30
HASH_CANDIDATES_SQL = (
    ctes(LOCAL_SQL, LOCAL_COUNTS_SQL)
    + TFIDF_SQL.format(
        counts="hash_counts", movie="side = 'movie'", ref="c.side = 'ref'", universe="(SELECT DISTINCT shot_no FROM local WHERE side = 'movie')"
    )
    + f""",
cand AS (SELECT ref_no, movie_no, score FROM (
  SELECT *, row_number() OVER (PARTITION BY ref_no ORDER BY score DESC, movie_no DESC) AS rank FROM sc WHERE score > 0) WHERE rank <= {HASH_TOP})
"""
)


def _hash_candidates(t):
    """The best source shots of each reference shot by shared descriptor hashes, and both sides' weights."""
    local = t.local_features
    movie = local.where("side = 'movie'")
    shots = movie.select("project_id", "shot_no").distinct()
    source = sim.descriptor_hashes(movie, P)
    asked = sim.descriptor_hashes(local.where("side = 'ref'"), P)
    idf = sim.inverse_frequencies(source, shots, P)
    totals = shots.groupBy(*P).agg(F.count(F.lit(1)).alias("__total"))
    index, queries = sim.tfidf_weights(source, idf, P), sim.tfidf_weights(asked, idf, P, totals)
    return sim.tfidf_top_k(queries, index, P, HASH_TOP), queries, index


@query(
    "descriptor_hash_retrieve",
    "J11 J12",
    HASH_CANDIDATES_SQL + "SELECT ref_no, movie_no, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score_e6 FROM cand",
)
def _(t):
    pairs = sim.tfidf_pair_scores(*_hash_candidates(t), P)
    return pairs.select("ref_no", "movie_no", e6(F.round("local_raw", 9), "score_e6"))


@query(
    "neighbour_votes",
    "J13",
    ctes(LOCAL_SQL)
    + """,
d AS (SELECT r.shot_no AS ref_no, r.desc_no, m.shot_no AS movie_no, m.desc_no AS near_no,
  bit_count(xor(r.w0, m.w0))::BIGINT + bit_count(xor(r.w1, m.w1)) + bit_count(xor(r.w2, m.w2)) + bit_count(xor(r.w3, m.w3)) AS dist
  FROM local r JOIN local m ON r.project_id = m.project_id WHERE r.side = 'ref' AND m.side = 'movie'),
k AS (SELECT *, row_number() OVER (PARTITION BY ref_no, desc_no ORDER BY dist, movie_no, near_no) AS rn FROM d),
o AS (SELECT ref_no, desc_no, movie_no, min(dist) AS dist FROM k WHERE rn <= 6 AND dist <= 60 GROUP BY ALL)
SELECT ref_no, movie_no, CAST(floor(sum((68 - dist) / 68.0::DOUBLE) * 1000000 + 0.5) AS BIGINT) AS votes_e6 FROM o GROUP BY ALL
""",
)
def _(t):
    local = t.local_features
    votes = sim.ann_votes(local.where("side = 'ref'"), local.where("side = 'movie'"), P, size=128)
    return votes.select("ref_no", "movie_no", e6(F.col("votes"), "votes_e6"))


MATCH_SQL = """,
d AS (SELECT r.shot_no AS ref_no, m.shot_no AS movie_no, r.frame_pos AS ref_frame, m.frame_pos AS movie_frame, r.kp_no AS q, m.kp_no AS c, m.x - r.x AS dx, m.y - r.y AS dy,
  bit_count(xor(r.w0, m.w0))::BIGINT + bit_count(xor(r.w1, m.w1)) + bit_count(xor(r.w2, m.w2)) + bit_count(xor(r.w3, m.w3)) AS dist
  FROM cand JOIN local r ON r.shot_no = cand.ref_no JOIN local m ON m.shot_no = cand.movie_no AND r.project_id = m.project_id),
k AS (SELECT *, row_number() OVER w AS rn, lead(dist) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY ref_no, movie_no, ref_frame, movie_frame, q ORDER BY dist, c)),
good AS (SELECT * FROM k WHERE rn = 1 AND dist < 0.75::DOUBLE * d2)
"""


def _matches(t):
    local = t.local_features
    movie, ref = local.where("side = 'movie'"), local.where("side = 'ref'")
    pairs = _hash_candidates(t)[0].select("project_id", "ref_no", "movie_no")
    return sim.ratio_test_matches(pairs, sim.pack_frames(ref, P), sim.pack_frames(movie, P), P)


@query(
    "ratio_test_matches",
    "J14",
    HASH_CANDIDATES_SQL
    + MATCH_SQL
    + """
SELECT ref_no, movie_no, ref_frame, movie_frame, count(*) AS good, CAST(sum(dx) AS BIGINT) AS dx_sum, CAST(sum(dist) AS BIGINT) AS dist_sum FROM good GROUP BY ALL
""",
)
def _(t):
    found = _matches(t).where(F.size("matches") > 0).select("ref_no", "movie_no", "ref_frame", "movie_frame", F.explode("matches").alias("m"))
    return found.groupBy("ref_no", "movie_no", "ref_frame", "movie_frame").agg(
        F.count(F.lit(1)).alias("good"), F.sum("m.dx").alias("dx_sum"), F.sum("m.d1").cast("bigint").alias("dist_sum")
    )


GEOMETRY_SQL = """,
bx AS (SELECT ref_no, movie_no, ref_frame, movie_frame, floor(dx / 5.0::DOUBLE) AS bx, floor(dy / 5.0::DOUBLE) AS by, count(*) AS v FROM good GROUP BY ALL),
fr AS (SELECT ref_no, movie_no, ref_frame, movie_frame, max(v) AS agree, CAST(sum(v) AS BIGINT) AS good FROM bx GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, CASE WHEN good >= 4 THEN agree ELSE 0 END AS inl,
   row_number() OVER (PARTITION BY ref_no, movie_no ORDER BY CASE WHEN good >= 4 THEN agree ELSE 0 END DESC, good DESC) AS rn FROM fr) WHERE rn = 1),
geo AS (SELECT ref_no, movie_no, coalesce(inl, 0) AS inliers, coalesce(good, 0) AS good_matches,
   0.75::DOUBLE * least(coalesce(inl, 0) / 35.0::DOUBLE, 1) + 0.25::DOUBLE * least(coalesce(good, 0) / 50.0::DOUBLE, 1) AS geometry
 FROM (SELECT DISTINCT ref_no, movie_no FROM d) LEFT JOIN best USING (ref_no, movie_no))
"""


@query(
    "geometry_consensus",
    "J15",
    HASH_CANDIDATES_SQL
    + MATCH_SQL
    + GEOMETRY_SQL
    + "SELECT ref_no, movie_no, inliers, good_matches, CAST(floor(geometry * 1000000 + 0.5) AS BIGINT) AS geometry_e6 FROM geo",
)
def _(t):
    scored = sim.geometry_consensus(_matches(t), P)
    return scored.select("ref_no", "movie_no", "inliers", "good_matches", e6(F.col("geometry"), "geometry_e6"))


POOL_SQL = """,
dd AS (SELECT shot_no, side, dur_ms, unnest(range(64)) AS i, vec FROM frames),
mm AS (SELECT shot_no, side, dur_ms, i, avg(vec[i + 1]) AS x FROM dd GROUP BY ALL),
pool AS (SELECT shot_no, side, dur_ms, list(x / norm ORDER BY i) AS clip FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY shot_no)) AS norm FROM mm) GROUP BY ALL)
"""


@query(
    "fine_scores",
    "J16",
    ctes(FRAMES_SQL)
    + POOL_SQL
    + """,
p AS (SELECT r.shot_no AS ref_no, m.shot_no AS movie_no, list_dot_product(r.clip, m.clip) AS clip, least(r.dur_ms, m.dur_ms) / greatest(r.dur_ms, m.dur_ms)::DOUBLE AS dr
      FROM pool r JOIN pool m ON m.shot_no > r.shot_no AND m.shot_no <= r.shot_no + 12 WHERE r.side = 'ref' AND m.side = 'movie'),
ff AS (SELECT p.ref_no, p.movie_no, a.frame_pos AS fa, b.frame_pos AS fb, list_dot_product(a.vec, b.vec) AS s
       FROM p JOIN frames a ON a.shot_no = p.ref_no JOIN frames b ON b.shot_no = p.movie_no),
ra AS (SELECT ref_no, movie_no, avg(x) AS m FROM (SELECT ref_no, movie_no, fa, max(s) AS x FROM ff GROUP BY ALL) GROUP BY ALL),
rb AS (SELECT ref_no, movie_no, avg(x) AS m FROM (SELECT ref_no, movie_no, fb, max(s) AS x FROM ff GROUP BY ALL) GROUP BY ALL)
SELECT ref_no, movie_no, CAST(floor((0.45::DOUBLE * clip + 0.45::DOUBLE * ((ra.m + rb.m) / 2) + 0.10::DOUBLE * dr) * 1000000 + 0.5) AS BIGINT) AS fine_e6
FROM p JOIN ra USING (ref_no, movie_no) JOIN rb USING (ref_no, movie_no)
""",
)
def _(t):
    frames = t.frames
    packed = sim.pack_vectors(frames, P)
    pooled = sim.mean_pool(frames, ["project_id", "shot_no", "side", "dur_ms"], "frame_pos", "vec").join(packed, ["project_id", "shot_no"])
    ref = pooled.where("side = 'ref'").select("project_id", F.col("shot_no").alias("ref_no"), F.col("dur_ms").alias("rd"), F.col("vec").alias("rv"), F.col("frames").alias("rf"))
    movie = pooled.where("side = 'movie'").select(
        "project_id", F.col("shot_no").alias("movie_no"), F.col("dur_ms").alias("md"), F.col("vec").alias("mv"), F.col("frames").alias("mf")
    )
    near = ref.withColumn("movie_no", F.explode(F.sequence(F.col("ref_no") + 1, F.col("ref_no") + 12))).join(movie, ["project_id", "movie_no"])
    score = sim.fine_score(sim.dot(F.col("rv"), F.col("mv")), F.col("rf"), F.col("mf"), sim.duration_ratio(F.col("rd"), F.col("md")))
    return near.select("ref_no", "movie_no", e6(score, "fine_e6"))


RANKS_SQL = """,
g AS (SELECT ref_no, movie_no, row_number() OVER (PARTITION BY ref_no ORDER BY score DESC, movie_no DESC) AS rank FROM (
   SELECT r.shot_no AS ref_no, m.shot_no AS movie_no, round(list_dot_product(r.vec, m.vec), 9) AS score
   FROM shot_vectors r JOIN shot_vectors m ON r.project_id = m.project_id WHERE r.side = 'ref' AND m.side = 'movie'))
"""


@query(
    "expanded_candidates",
    "J17",
    ctes(SHOT_VECTORS_SQL)
    + RANKS_SQL
    + """,
refs AS (SELECT shot_no // 5 AS n, shot_no AS ref_no FROM shot_vectors WHERE side = 'ref'),
gn AS (SELECT n, movie_no, rank FROM g JOIN refs USING (ref_no))
SELECT n AS ref_no, movie_no FROM gn WHERE rank <= 15
UNION SELECT r.n, gn.movie_no FROM refs r JOIN gn ON gn.n BETWEEN r.n - 2 AND r.n + 2 WHERE rank <= 5
""",
)
def _(t):
    vectors = t.shot_vectors
    numbered = ref_side(vectors).withColumn("ref_no", F.floor(F.col("ref_no") / 5))
    best = sim.cosine_top_k(numbered, movie_side(vectors), P, 15)
    return sim.expand_candidates(best, best, numbered, P, 2, own_local=10).select("ref_no", "movie_no")


@query(
    "sequence_support",
    "J18",
    ctes(SHOT_VECTORS_SQL)
    + RANKS_SQL
    + """,
refs AS (SELECT shot_no // 5 AS n, shot_no AS ref_no FROM shot_vectors WHERE side = 'ref'),
pre AS (SELECT n, movie_no, (n * 7) % 20 AS inliers FROM g JOIN refs USING (ref_no) WHERE rank = 1),
lent AS (SELECT r.n AS ref_no, pre.movie_no + o AS movie_no, 0.18::DOUBLE / abs(pre.n - r.n) * (1 - 0.2::DOUBLE * abs(o)) AS b
  FROM refs r JOIN pre ON pre.n BETWEEN r.n - 2 AND r.n + 2 AND pre.n <> r.n, unnest([-2, -1, 0, 1, 2]) x(o) WHERE inliers >= 10)
SELECT ref_no, movie_no, CAST(floor(sum(b) * 1000000 + 0.5) AS BIGINT) AS support_e6 FROM lent
WHERE movie_no IN (SELECT shot_no FROM shot_vectors WHERE side = 'movie') GROUP BY ALL
""",
)
def _(t):
    vectors = t.shot_vectors
    refs = ref_side(vectors).withColumn("ref_no", F.floor(F.col("ref_no") / 5))
    movies = movie_side(vectors)
    best = sim.cosine_top_k(refs, movies, P, 1).withColumn("inliers", (F.col("ref_no") * 7) % 20)
    support = sim.sequence_support(best, refs, movies, P, 2)
    return support.select("ref_no", "movie_no", e6(F.col("support"), "support_e6"))


BAND_SQL = """,
a AS (SELECT media_id, frame_no, score_m AS s FROM frame_scores WHERE media_id % 2 = 0),
b AS (SELECT media_id - 1 AS media_id, frame_no, score_m AS s FROM frame_scores WHERE media_id % 2 = 1),
c AS (SELECT a.media_id, a.frame_no, b.frame_no AS clip_frame, abs(a.s - b.s) AS d,
  CASE WHEN b.frame_no > a.frame_no THEN 2 * (b.frame_no - a.frame_no) - 1 ELSE 2 * (a.frame_no - b.frame_no) END AS tie
  FROM a JOIN b ON a.media_id = b.media_id AND b.frame_no BETWEEN a.frame_no - 20 AND a.frame_no + 20),
k AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame_no ORDER BY d, tie) AS rn FROM c)
SELECT a.media_id, a.frame_no, CASE WHEN k.d IS NULL OR k.d >= 3 THEN a.frame_no ELSE k.clip_frame END AS clip_frame, k.d IS NULL OR k.d >= 3 AS is_fallback
FROM a LEFT JOIN k ON a.media_id = k.media_id AND a.frame_no = k.frame_no AND rn = 1
"""


@query("banded_nearest_frame", "J23", ctes(INTERVALS_SQL, FRAME_SCORES_SQL) + BAND_SQL)
def _(t):
    frames = t.frame_scores.select("media_id", "frame_no", F.col("score_m").alias("score"))
    clip = frames.where("media_id % 2 = 1").withColumn("media_id", F.col("media_id") - 1)
    return sim.banded_nearest_frame(
        frames.where("media_id % 2 = 0"), clip, ["media_id"], lambda a, b: F.abs(a - b), radius=20, threshold=3
    )


@query(
    "fps_resample_map",
    "J24",
    ctes(INTERVALS_SQL, FRAME_SCORES_SQL)
    + """,
m AS (SELECT media_id, frame_no - 1 AS frame_idx, ((frame_no - 1) * 1001 * 24000) // (30000 * 1001) AS ref_frame FROM frame_scores),
p AS (SELECT *, lag(ref_frame) OVER (PARTITION BY media_id ORDER BY frame_idx) AS pr FROM m),
q AS (SELECT *, coalesce(ref_frame = pr, false) AS duplicate FROM p)
SELECT media_id, frame_idx, ref_frame, duplicate,
  CASE WHEN duplicate THEN CAST(ref_frame + sum(duplicate::INT) OVER (PARTITION BY media_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS deletion FROM q
""",
)
def _(t):
    frames = t.frame_scores.select("media_id", (F.col("frame_no") - 1).alias("frame_idx"))
    return sim.fps_resample_map(frames, ["media_id"], clip_rate=(30_000, 1_001), ref_rate=(24_000, 1_001))


@query(
    "shot_pair_scores",
    "J25 P27",
    ctes(LOCAL_SQL)
    + """,
f AS (SELECT l.shot_no, l.side, l.desc_no, l.w1 AS h, CAST(e.embedding AS DOUBLE[]) AS v FROM local l JOIN embeddings e ON e.vec_id = l.shot_no * 10 + l.desc_no),
c AS (SELECT a.shot_no AS ref_no, b.shot_no AS movie_no, a.desc_no AS fa, b.desc_no AS fb, ((64 - bit_count(xor(a.h, b.h))) * 10000 + 32) // 64 AS hs,
  list_dot_product(a.v, b.v) - list_sum(a.v) * list_sum(b.v) / 64 AS cov,
  (list_dot_product(a.v, a.v) - list_sum(a.v) * list_sum(a.v) / 64) * (list_dot_product(b.v, b.v) - list_sum(b.v) * list_sum(b.v) / 64) AS vv
  FROM f a JOIN f b ON b.shot_no BETWEEN a.shot_no + 1 AND a.shot_no + 6 WHERE a.side = 'ref' AND b.side = 'movie'),
s AS (SELECT *, (hs * 55 + CAST(floor(greatest(0, least(1, (CASE WHEN vv > 0 THEN cov / sqrt(vv) ELSE 1 END + 1) / 2)) * 10000 + 0.5) AS BIGINT) * 45 + 50) // 100 AS sc FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY ref_no, movie_no ORDER BY sc DESC, fa, fb) AS rn FROM s)
SELECT ref_no, movie_no, CAST((max(sc) * 6 * count(*) + sum(sc) * 4 + count(*) * 5) // (count(*) * 10) AS BIGINT) AS score_e4,
  min_by(fa, rn) AS best_ref_frame, min_by(fb, rn) AS best_movie_frame FROM r WHERE rn <= 3 GROUP BY ALL
""",
)
def _(t):
    frames = (
        t.local_features.withColumn("vec_id", F.col("shot_no") * 10 + F.col("desc_no"))
        .join(t.embeddings.select("vec_id", F.col("embedding").alias("hist")), "vec_id")
        .select("project_id", "shot_no", "side", F.col("desc_no").alias("frame_pos"), F.col("w1").alias("dhash"), "hist")
    )
    ref, movie = frames.where("side = 'ref'"), frames.where("side = 'movie'")
    pairs = (
        ref.select("project_id", F.col("shot_no").alias("ref_no"))
        .distinct()
        .withColumn("movie_no", F.explode(F.sequence(F.col("ref_no") + 1, F.col("ref_no") + 6)))
    )
    return sim.shot_pair_scores(pairs, ref, movie, P).drop("project_id")


@query(
    "nearest_clip_fill",
    "J26",
    ctes(CLIPS_SQL, AUDIO_RESULTS_SQL)
    + """,
f AS (SELECT item_no, min_by(part_no, clip_no) AS clip FROM clips WHERE flag = 'A' GROUP BY 1),
i AS (SELECT project_id, item_no, clip FROM audio_results LEFT JOIN f USING (item_no))
SELECT project_id, item_no, coalesce(clip,
   first_value(clip IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY item_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
   last_value(clip IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS filled, clip IS NULL AS borrowed FROM i
""",
)
def _(t):
    firsts = t.clips.where("flag = 'A'").groupBy("item_no").agg(F.min_by("part_no", "clip_no").alias("clip"))
    items = t.audio_results.select("project_id", "item_no").join(firsts, "item_no", "left")
    filled = sim.nearest_clip_fill(items, P, ["item_no"], "clip", width=1_000)
    return filled.select("project_id", "item_no", "filled", F.col("clip").isNull().alias("borrowed"))
