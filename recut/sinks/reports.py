"""Review reports of an alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recut.functions.media import is_accepted

# Fixed column order of the manifest.
MANIFEST_COLUMNS = (
    "ref_index", "ref_name", "movie_index", "movie_name", "score", "ref_duration", "movie_duration", "status", "confidence",
    "geometry_inliers", "good_matches", "top1_movie_shot_id", "top1_score", "top2_movie_shot_id", "top2_score",
    "top3_movie_shot_id", "top3_score",
)


def low_confidence_report(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows a person should look at."""
    return matches.where((F.col("confidence") == "low") | ~is_accepted(F.col("status"))).select(
        *keys, "ref_shot_id", "status", "confidence", "match_score", "movie_shot_ids", "score_gap", "geometry_inliers", "good_matches"
    )


def match_manifest(matches: DataFrame) -> DataFrame:
    """Matched rows flat, with the three best candidates side by side."""
    at = lambda i, field: F.try_element_at("candidates", F.lit(i)).getField(field)
    tops = [
        column
        for i in (1, 2, 3)
        for column in (at(i, "movie_shot_id").alias(f"top{i}_movie_shot_id"), at(i, "final_score").alias(f"top{i}_score"))
    ]
    shot = F.try_element_at("movie_shot_ids", F.lit(1))
    rows = matches.where(shot.isNotNull()).select(
        F.col("ref_no").alias("ref_index"),
        F.col("ref_shot_id").alias("ref_name"),
        F.regexp_extract(shot, r"(\d+)$", 1).cast("bigint").alias("movie_index"),
        shot.alias("movie_name"),
        F.col("match_score").alias("score"),
        (F.col("ref_end_ms") - F.col("ref_start_ms")).alias("ref_duration"),
        (F.col("movie_end_ms") - F.col("movie_start_ms")).alias("movie_duration"),
        "status",
        "confidence",
        "geometry_inliers",
        "good_matches",
        *tops,
    )
    return rows.select(*MANIFEST_COLUMNS)


def write_manifest_csv(matches: DataFrame, path: str) -> None:
    """CSV files that open in spreadsheet programs: header and a byte-order mark on the first column name."""
    rows = match_manifest(matches)
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
