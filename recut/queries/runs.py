"""Runs, ranks, top-k, keep-last and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from recut.operators import runs
from recut.operators.ordered import ORDINAL_SLICE, TIME_SLICE_MS, lag, last_before, position, scan, sum_before
from recut.queries import domain
from recut.queries.domain import AUDIO_RESULTS_SQL, CLIPS_SQL, INTERVALS_SQL
from recut.queries.registry import ctes, query


@query(
    "run_length_groups",
    "W6",
    """
WITH p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS pr, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
g AS (SELECT *, sum(CASE WHEN rn = 1 OR role <> pr THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run_no FROM p)
SELECT conv_id, CAST(run_no AS BIGINT) AS run_no, role, min(turn) AS first_turn, max(turn) AS last_turn,
       string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns
FROM g GROUP BY conv_id, run_no, role
""",
)
def _(t):
    grouped = runs.run_ids(t.runs, ["conv_id"], ["turn"], "role", width=ORDINAL_SLICE)
    return grouped.groupBy("conv_id", "run_no", "role").agg(
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string"))).alias("turns"),
    )


@query(
    "event_type_runs",
    "W6",
    ctes(INTERVALS_SQL)
    + """,
p AS (SELECT *, lag(event_type) OVER w AS pt, row_number() OVER w AS rn FROM intervals WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, event_id)),
g AS (SELECT *, sum(CASE WHEN rn = 1 OR event_type <> pt THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM p)
SELECT media_id, CAST(run_no AS BIGINT) AS run_no, event_type, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members
FROM g GROUP BY media_id, run_no, event_type
""",
)
def _(t):
    grouped = runs.run_ids(t.intervals, ["media_id"], ["start_ms", "event_id"], "event_type", width=TIME_SLICE_MS)
    return grouped.groupBy("media_id", "run_no", "event_type").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("members")
    )


@query(
    "top_k_clips",
    "K1 K4",
    """
SELECT l_orderkey AS item_no, l_partkey AS part_no, CAST(rank AS BIGINT) AS rank, qty FROM (
  SELECT l_orderkey, l_partkey, qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY qty DESC, l_partkey DESC) AS rank
  FROM (SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL)) WHERE rank <= 3
""",
)
def _(t):
    totals = t.lineitem.groupBy(F.col("l_orderkey").alias("item_no"), F.col("l_partkey").alias("part_no")).agg(
        F.sum("l_quantity").cast("bigint").alias("qty")
    )
    return runs.top_k(totals, ["item_no"], "qty", "part_no", 3)


@query(
    "head_ratio",
    "K2",
    ctes(INTERVALS_SQL)
    + """,
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, event_id) AS rn, count(*) OVER (PARTITION BY media_id) AS c FROM intervals)
SELECT media_id, event_id FROM n WHERE rn <= greatest(1, ceil(c * 0.15::DOUBLE))
""",
)
def _(t):
    head = runs.head_ratio(t.intervals, ["media_id"], ["start_ms", "event_id"], 0.15, width=TIME_SLICE_MS)
    return head.select("media_id", "event_id")


@query(
    "even_subsample",
    "W20",
    ctes(INTERVALS_SQL)
    + """,
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, event_id) - 1 AS p, count(*) OVER (PARTITION BY media_id) AS c FROM intervals),
want AS (SELECT DISTINCT media_id, (j * (c - 1)) // 319 AS p FROM (SELECT DISTINCT media_id, c FROM n), range(320) r(j))
SELECT n.media_id, n.event_id FROM n JOIN want USING (media_id, p)
""",
)
def _(t):
    kept = runs.even_subsample(t.intervals, ["media_id"], ["start_ms", "event_id"], 320, width=TIME_SLICE_MS)
    return kept.select("media_id", "event_id")


@query(
    "first_middle_last",
    "W20",
    ctes(INTERVALS_SQL)
    + """,
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS c
      FROM (SELECT e.user_id, i.event_id, i.start_ms FROM intervals i JOIN events e USING (event_id)))
SELECT user_id, event_id FROM n WHERE p IN (0, c // 2, c - 1)
""",
)
def _(t):
    rows = domain.intervals(t, "user_id")
    return runs.first_middle_last(rows, ["user_id"], ["start_ms", "event_id"], width=TIME_SLICE_MS).select("user_id", "event_id")


@query(
    "keep_last_duplicate",
    "J8 A14",
    """
SELECT l_partkey AS shot_no, max_by(l_orderkey, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS item_no,
       max_by(l_suppkey, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS supp_no
FROM lineitem GROUP BY l_partkey
""",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_partkey").alias("shot_no"),
        F.col("l_orderkey").alias("item_no"),
        F.col("l_suppkey").alias("supp_no"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("pos"),
    )
    return runs.last_per_key(rows, ["shot_no"], "pos").select("shot_no", "item_no", "supp_no")


@query(
    "candidate_score_gap",
    "W16",
    """
WITH c AS (SELECT l_orderkey AS ref_no, l_partkey AS cand_no, max(l_quantity / 45.0::DOUBLE) AS s FROM lineitem GROUP BY ALL),
sel AS (SELECT *, greatest(0, least(1, s)) AS fs, cand_no = min(cand_no) OVER (PARTITION BY ref_no) AS selected,
  row_number() OVER (PARTITION BY ref_no ORDER BY s DESC, cand_no) AS final_rank FROM c),
g AS (SELECT ref_no, max(fs) FILTER (WHERE selected) AS own, max(fs) FILTER (WHERE NOT selected) AS other FROM sel GROUP BY ref_no)
SELECT ref_no, cand_no, final_rank, selected, CAST(floor((own - coalesce(other, 0)) * 10000 + 0.5) AS BIGINT) AS gap_e4
FROM sel JOIN g USING (ref_no)
""",
)
def _(t):
    scored = t.lineitem.groupBy(F.col("l_orderkey").alias("ref_no"), F.col("l_partkey").alias("cand_no")).agg(
        F.max(F.col("l_quantity") / 45.0).alias("s")
    )
    chosen = scored.groupBy("ref_no").agg(F.min("cand_no").alias("__chosen"))
    ranked = runs.candidate_ranks(
        scored.join(chosen, "ref_no"), ["ref_no"], "s", F.col("cand_no") == F.col("__chosen"), "cand_no"
    )
    return ranked.select(
        "ref_no",
        "cand_no",
        "final_rank",
        "selected",
        F.floor(F.col("score_gap") * 10_000 + 0.5).cast("bigint").alias("gap_e4"),
    )


@query(
    "top_three_columns",
    "K3",
    """
WITH c AS (SELECT l_orderkey AS ref_no, l_partkey AS cand, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ref_no ORDER BY score DESC, cand DESC) AS rank FROM c)
SELECT ref_no, max(cand) FILTER (WHERE rank = 1) AS top1_cand, max(score) FILTER (WHERE rank = 1) AS top1_score,
       max(cand) FILTER (WHERE rank = 2) AS top2_cand, max(score) FILTER (WHERE rank = 2) AS top2_score,
       max(cand) FILTER (WHERE rank = 3) AS top3_cand, max(score) FILTER (WHERE rank = 3) AS top3_score
FROM r GROUP BY ref_no
""",
)
def _(t):
    scored = t.lineitem.groupBy(F.col("l_orderkey").alias("ref_no"), F.col("l_partkey").alias("cand")).agg(
        F.sum("l_quantity").cast("bigint").alias("score")
    )
    return runs.pivot_top(runs.top_k(scored, ["ref_no"], "score", "cand", 3), ["ref_no"], "rank", ["cand", "score"])


@query(
    "candidate_union",
    "O1",
    """
SELECT l_orderkey AS ref_no, l_partkey AS cand_no FROM lineitem WHERE l_returnflag = 'R'
UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 30
""",
)
def _(t):
    pairs = t.lineitem.select(F.col("l_orderkey").alias("ref_no"), F.col("l_partkey").alias("cand_no"), "l_returnflag", "l_quantity")
    flagged = pairs.where("l_returnflag = 'R'").select("ref_no", "cand_no")
    return flagged.unionByName(pairs.where("l_quantity > 30").select("ref_no", "cand_no")).distinct()


@query(
    "ordered_distinct",
    "O3 G7",
    ctes(CLIPS_SQL)
    + """,
f AS (SELECT item_no, part_no % 5 AS ref_no, min(clip_no) AS first_no FROM clips GROUP BY ALL)
SELECT item_no, string_agg(CAST(ref_no AS VARCHAR), ',' ORDER BY first_no) AS ref_shot_ids FROM f GROUP BY item_no
""",
)
def _(t):
    firsts = t.clips.groupBy("item_no", (F.col("part_no") % 5).alias("ref_no")).agg(F.min("clip_no").alias("first_no"))
    return firsts.groupBy("item_no").agg(
        F.concat_ws(
            ",", F.transform(F.array_sort(F.collect_list(F.struct("first_no", "ref_no"))), lambda s: s.ref_no.cast("string"))
        ).alias("ref_shot_ids")
    )


@query(
    "index_set_difference",
    "O2",
    ctes(CLIPS_SQL)
    + """
SELECT item_no, string_agg(CAST(clip_no AS VARCHAR), ',' ORDER BY clip_no) AS narration_indexes
FROM clips GROUP BY item_no HAVING count(*) FILTER (WHERE flag <> 'R') >= 0 AND count(*) > 0
EXCEPT SELECT item_no, string_agg(CAST(clip_no AS VARCHAR), ',' ORDER BY clip_no) FROM clips GROUP BY item_no
UNION ALL SELECT item_no, coalesce(string_agg(CAST(clip_no AS VARCHAR), ',' ORDER BY clip_no) FILTER (WHERE flag <> 'R'), '') FROM clips GROUP BY item_no
""",
)
def _(t):
    sets = t.clips.groupBy("item_no").agg(
        F.collect_set("clip_no").alias("all_indexes"),
        F.collect_set(F.when(F.col("flag") == "R", F.col("clip_no"))).alias("original_indexes"),
    )
    narration = F.array_sort(F.array_except("all_indexes", "original_indexes"))
    return sets.select(
        "item_no", F.concat_ws(",", F.transform(narration, lambda i: i.cast("string"))).alias("narration_indexes")
    )


@query(
    "backward_count",
    "W9",
    ctes(INTERVALS_SQL)
    + """,
m AS (SELECT media_id, start_ms, event_id, CASE WHEN event_type <> 'error' THEN end_ms END AS movie_start FROM intervals),
p AS (SELECT *, last_value(movie_start IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m)
SELECT media_id, count(*) FILTER (WHERE movie_start < prev - 500) AS backward_count FROM p GROUP BY media_id
""",
)
def _(t):
    rows = t.intervals.withColumn("movie_start", F.expr("case when event_type <> 'error' then end_ms end"))
    seen = scan(rows, ["media_id"], ["start_ms", "event_id"], [last_before("prev", "movie_start")], width=TIME_SLICE_MS)
    return seen.groupBy("media_id").agg(F.count_if(F.col("movie_start") < F.col("prev") - 500).alias("backward_count"))


@query(
    "duplicate_count",
    "W10",
    "SELECT l_returnflag AS project, count(*) - count(DISTINCT l_partkey) AS duplicate_count FROM lineitem GROUP BY 1",
)
def _(t):
    # Two-step count: equal shots combine before the shuffle, also within a hot project.
    per_shot = t.lineitem.groupBy(F.col("l_returnflag").alias("project"), "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return per_shot.groupBy("project").agg((F.sum("n") - F.count(F.lit(1))).alias("duplicate_count"))


@query(
    "timeline_cursor",
    "W11 P11",
    ctes(AUDIO_RESULTS_SQL)
    + """
SELECT project_id, item_no, CAST(coalesce(sum(audio_ms) OVER (PARTITION BY project_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
  CAST(sum(audio_ms) OVER (PARTITION BY project_id ORDER BY item_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_ms,
  printf('rebuild_item_%03d', row_number() OVER (PARTITION BY project_id ORDER BY item_no)) AS item_id
FROM audio_results
""",
)
def _(t):
    placed = scan(
        t.audio_results, ["project_id"], ["item_no"], [sum_before("start_ms", "audio_ms"), position("n")], width=1_000
    )
    return placed.select(
        "project_id",
        "item_no",
        F.col("start_ms").cast("bigint").alias("start_ms"),
        (F.col("start_ms") + F.col("audio_ms")).cast("bigint").alias("end_ms"),
        F.format_string("rebuild_item_%03d", "n").alias("item_id"),
    )
