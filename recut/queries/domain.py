"""The given tables seen as media tables, once for Spark and once as SQL text.

Times are integer milliseconds.  Each ``NAME_SQL`` string is the CTE twin of the view above it.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from recut.queries.registry import Tables


def _micros_since_2024(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        zero = F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)")
        return F.unix_micros(F.col(name).cast("timestamp")) - F.unix_micros(zero)
    return F.unix_micros(F.col(name)) - F.lit(1_704_067_200_000_000)


def intervals(t: Tables, *more: str) -> DataFrame:
    """Events as time-coded intervals, a media file for each user, with more columns of the events if asked."""
    events = t.events
    start = F.floor(_micros_since_2024(events, "ts") / 100_000).cast("bigint")
    length = F.floor(F.col("value") * 500 + 0.5).cast("bigint")
    return events.select(
        F.col("user_id").alias("media_id"),
        "event_id",
        "event_type",
        start.alias("start_ms"),
        (start + length).alias("end_ms"),
        *more,
    )


INTERVALS_SQL = """
intervals AS (
  SELECT user_id AS media_id, event_id, event_type, s AS start_ms,
         s + CAST(floor(value * 500 + 0.5) AS BIGINT) AS end_ms
  FROM (SELECT *, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 100000) AS BIGINT) AS s FROM events)
)
"""


def ref_shots(t: Tables) -> DataFrame:
    return intervals(t).where(F.col("event_type").isin("view", "click")).select(
        "media_id", F.col("event_id").alias("shot_no"), F.col("start_ms"), F.col("end_ms")
    )


REF_SHOTS_SQL = """
ref_shots AS (SELECT media_id, event_id AS shot_no, start_ms, end_ms FROM intervals WHERE event_type IN ('view','click'))
"""


def subtitles(t: Tables) -> DataFrame:
    return intervals(t).where(~F.col("event_type").isin("view", "click")).select(
        "media_id",
        F.col("event_id").alias("sub_no"),
        "start_ms",
        "end_ms",
        F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("text"),
    )


SUBTITLES_SQL = """
subtitles AS (SELECT media_id, event_id AS sub_no, start_ms, end_ms,
                     event_type || '-' || CAST(event_id AS VARCHAR) AS text
              FROM intervals WHERE event_type NOT IN ('view','click'))
"""


def clips(t: Tables) -> DataFrame:
    """Line items as clips of timeline items; at most a handful per order, numbered by a total order."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = t.lineitem.withColumn("__clip", F.row_number().over(order).cast("bigint"))
    # What is derived from a row is derived behind the shuffle.
    return numbered.select(
        F.col("l_orderkey").alias("item_no"),
        F.col("__clip").alias("clip_no"),
        (F.col("l_suppkey") * 10_000).cast("bigint").alias("start_ms"),
        (F.col("l_suppkey") * 10_000 + F.col("l_quantity") * 1_000).cast("bigint").alias("end_ms"),
        F.col("l_partkey").alias("part_no"),
        F.concat(F.lit("shot-"), F.col("l_partkey").cast("string")).alias("shot_id"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
    )


CLIPS_SQL = """
clips AS (
  SELECT l_orderkey AS item_no,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS clip_no,
         CAST(l_suppkey * 10000 AS BIGINT) AS start_ms,
         CAST(l_suppkey * 10000 + l_quantity * 1000 AS BIGINT) AS end_ms,
         l_partkey AS part_no, 'shot-' || CAST(l_partkey AS VARCHAR) AS shot_id,
         l_returnflag AS flag, l_linestatus AS line_status
  FROM lineitem
)
"""


def audio_results(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("item_no"),
        F.floor(F.col("o_totalprice") / 10 + 0.5).cast("bigint").alias("audio_ms"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_custkey") % 50).alias("project_id"),
    )


AUDIO_RESULTS_SQL = """
audio_results AS (SELECT o_orderkey AS item_no, CAST(floor(o_totalprice / 10 + 0.5) AS BIGINT) AS audio_ms,
                         o_orderstatus AS status, o_custkey % 50 AS project_id FROM orders)
"""


def runs(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", "text")


def shot_vectors(t: Tables) -> DataFrame:
    """Every fifth embedding is a reference shot, the rest are source shots."""
    return t.embeddings.select(
        F.lit(0).cast("bigint").alias("project_id"),
        F.col("vec_id").alias("shot_no"),
        F.when(F.col("vec_id") % 5 == 0, "ref").otherwise("movie").alias("side"),
        F.col("embedding").alias("vec"),
        (1_000 + (F.col("vec_id") * 7) % 13 * 250).cast("bigint").alias("dur_ms"),
    )


SHOT_VECTORS_SQL = """
shot_vectors AS (SELECT 0::BIGINT AS project_id, vec_id AS shot_no, CASE WHEN vec_id % 5 = 0 THEN 'ref' ELSE 'movie' END AS side,
                        CAST(embedding AS DOUBLE[]) AS vec, CAST(1000 + (vec_id * 7) % 13 * 250 AS BIGINT) AS dur_ms
                 FROM embeddings)
"""


def frames(t: Tables) -> DataFrame:
    """Five consecutive embeddings are the frames of one shot; every fifth shot is a reference shot."""
    shot = F.floor(F.col("vec_id") / 5).cast("bigint")
    return t.embeddings.select(
        F.lit(0).cast("bigint").alias("project_id"),
        shot.alias("shot_no"),
        (F.col("vec_id") % 5).alias("frame_pos"),
        F.when(shot % 5 == 0, "ref").otherwise("movie").alias("side"),
        F.col("embedding").alias("vec"),
        (1_000 + (shot * 7) % 13 * 250).cast("bigint").alias("dur_ms"),
    )


FRAMES_SQL = """
frames AS (SELECT 0::BIGINT AS project_id, vec_id // 5 AS shot_no, vec_id % 5 AS frame_pos,
                  CASE WHEN (vec_id // 5) % 5 = 0 THEN 'ref' ELSE 'movie' END AS side,
                  CAST(embedding AS DOUBLE[]) AS vec, CAST(1000 + ((vec_id // 5) * 7) % 13 * 250 AS BIGINT) AS dur_ms
           FROM embeddings)
"""


def words(t: Tables) -> DataFrame:
    """Words of whole documents with counts, standing in for the hashes of local features."""
    word = F.explode(F.split(F.lower("text"), r"\s+"))
    return (
        t.documents.select(F.lit(0).cast("bigint").alias("project_id"), F.col("doc_id").alias("shot_no"), word.alias("hash"))
        .where(F.col("hash") != "")
        .groupBy("project_id", "shot_no", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
    )


WORDS_SQL = """
words AS (SELECT 0::BIGINT AS project_id, shot_no, hash, count(*) AS n
          FROM (SELECT doc_id AS shot_no, unnest(regexp_split_to_array(lower(text), '\\s+')) AS hash FROM documents)
          WHERE hash <> '' GROUP BY ALL)
"""


def frame_scores(t: Tables) -> DataFrame:
    """Events of a media file in time order are its frames; values stand for difference scores."""
    from recut.operators.ordered import TIME_SLICE_MS, position, scan

    numbered = scan(intervals(t, "value"), ["media_id"], ["start_ms", "event_id"], [position("frame_no")], width=TIME_SLICE_MS)
    return numbered.select(
        "media_id",
        "frame_no",
        F.floor(F.col("value") * 2 + 0.5).cast("bigint").alias("score_m"),
        F.least(F.floor(F.col("value") * 10 + 0.5), F.lit(1000)).cast("bigint").alias("prob_m"),
    )


FRAME_SCORES_SQL = """
frame_scores AS (
  SELECT i.media_id, row_number() OVER (PARTITION BY i.media_id ORDER BY i.start_ms, i.event_id) AS frame_no,
         CAST(floor(e.value * 2 + 0.5) AS BIGINT) AS score_m,
         CAST(least(floor(e.value * 10 + 0.5), 1000) AS BIGINT) AS prob_m
  FROM intervals i JOIN events e USING (event_id)
)
"""


def decisions(t: Tables) -> DataFrame:
    return t.orders.select(
        (F.col("o_custkey") % 50).alias("project_id"),
        F.col("o_orderkey").alias("seg_no"),
        (F.lit(100) - F.substring("o_orderpriority", 1, 1).cast("bigint") * 10).alias("priority"),
        F.floor(F.col("o_totalprice") / 100 + 0.5).cast("bigint").alias("dur_ms"),
        (1 + F.col("o_orderkey") % 4).cast("bigint").alias("clip_count"),
    )


DECISIONS_SQL = """
decisions AS (SELECT o_custkey % 50 AS project_id, o_orderkey AS seg_no,
                     100 - CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10 AS priority,
                     CAST(floor(o_totalprice / 100 + 0.5) AS BIGINT) AS dur_ms,
                     CAST(1 + o_orderkey % 4 AS BIGINT) AS clip_count FROM orders)
"""


_LOCAL_THRESHOLDS = (-0.18, -0.06, 0.06, 0.18)


def local_features(t: Tables) -> DataFrame:
    """Ten embeddings make a shot of two frames with five key points each.

    A descriptor word holds one bit for each of the 64 dimensions: set where the value lies above the word's threshold.
    """
    word = lambda v: F.expr(
        f"aggregate(transform(embedding, (x, i) -> if(double(x) > {v}D, shiftleft(1L, i), 0L)), 0L, (a, b) -> a + b)"
    )
    shot = F.floor(F.col("vec_id") / 10).cast("bigint")
    return t.embeddings.select(
        F.lit(0).cast("bigint").alias("project_id"),
        shot.alias("shot_no"),
        F.when(shot % 5 == 0, "ref").otherwise("movie").alias("side"),
        (F.floor(F.col("vec_id") / 5) % 2).cast("bigint").alias("frame_pos"),
        (F.col("vec_id") % 5).alias("kp_no"),
        (F.col("vec_id") % 10).alias("desc_no"),
        F.floor(F.element_at("embedding", 61) * 100).cast("bigint").alias("x"),
        F.floor(F.element_at("embedding", 62) * 100).cast("bigint").alias("y"),
        *[word(v).alias(f"w{i}") for i, v in enumerate(_LOCAL_THRESHOLDS)],
    )


# The last of the 64 bits is the sign of the word.
_WORD_SQL = "list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1]::DOUBLE <= {v}::DOUBLE THEN 0::HUGEINT WHEN i = 63 THEN -(1::HUGEINT << 63) ELSE 1::HUGEINT << i END))::BIGINT AS w{n}"
LOCAL_SQL = (
    """
local AS (SELECT 0::BIGINT AS project_id, vec_id // 10 AS shot_no, CASE WHEN (vec_id // 10) % 5 = 0 THEN 'ref' ELSE 'movie' END AS side,
  (vec_id // 5) % 2 AS frame_pos, vec_id % 5 AS kp_no, vec_id % 10 AS desc_no,
  CAST(floor(embedding[61] * 100) AS BIGINT) AS x, CAST(floor(embedding[62] * 100) AS BIGINT) AS y,
"""
    + ", ".join(_WORD_SQL.format(v=v, n=n) for n, v in enumerate(_LOCAL_THRESHOLDS))
    + " FROM embeddings)"
)


def audio_ranges(t: Tables) -> DataFrame:
    """Line items as clips of segments ten seconds apart, with derived subtitle coverage."""
    length = (F.col("qty") * 200).cast("bigint")
    start = (F.col("clip_no") - 1) * 10_000
    qty = ((F.col("end_ms") - F.col("start_ms")) / 1_000).alias("qty")
    base = clips(t).select("item_no", "clip_no", "part_no", qty)
    return base.select(
        (F.col("item_no") % 50).alias("project_id"),
        F.col("item_no").alias("seg_no"),
        (F.col("clip_no") - 1).alias("clip_pos"),
        (F.col("clip_no") - 1).alias("clip_index"),
        start.alias("start_ms"),
        (start + length).alias("end_ms"),
        F.floor(length * (F.col("part_no") % 101) / 100).cast("bigint").alias("covered_ms"),
        (F.col("part_no") % 4).alias("subtitle_count"),
        F.when(F.col("item_no") % 7 == 0, "hook").when(F.col("item_no") % 7 == 1, "ending").otherwise("narration").alias("text_role"),
    )


AUDIO_RANGES_SQL = """
audio_ranges AS (
  SELECT item_no % 50 AS project_id, item_no AS seg_no, clip_no - 1 AS clip_pos, clip_no - 1 AS clip_index, (clip_no - 1) * 10000 AS start_ms,
    (clip_no - 1) * 10000 + (end_ms - start_ms) // 5 AS end_ms, ((end_ms - start_ms) // 5) * (part_no % 101) // 100 AS covered_ms,
    part_no % 4 AS subtitle_count, CASE item_no % 7 WHEN 0 THEN 'hook' WHEN 1 THEN 'ending' ELSE 'narration' END AS text_role FROM clips)
"""
