"""Locate each reference shot in the source film: recall, verify, support by neighbours, rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recut.functions import media as fx
from recut.operators import similarity as sim
from recut.operators.ordered import ORDINAL_SLICE, last_before, scan
from recut.session import cut_lineage

ROUND = 9


@dataclass(frozen=True)
class Settings:
    candidate_count: int = 30
    geometry_limit: int = 24
    neighbour_radius: int = 2
    top_k: int = 5
    min_score: float = 0.35
    min_inliers: int = 8


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def localize(
    refs: DataFrame,
    movies: DataFrame,
    ref_local: DataFrame,
    movie_local: DataFrame,
    keys: Sequence[str],
    settings: Settings = Settings(),
) -> DataFrame:
    """Ranked candidates per reference shot.

    refs: ref_no, dur_ms, vec, frames; movies: movie_no, dur_ms, vec, frames (numbers dense per key);
    local features: shot_no, frame_pos, kp_no, desc_no, x, y, w0..w3.
    """
    keys = list(keys)
    pair = [*keys, "ref_no", "movie_no"]
    s = settings

    counts = sim.descriptor_hashes(movie_local, keys)
    shots = movies.select(*keys, "movie_no")
    totals = shots.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    idf = sim.inverse_frequencies(counts, shots, keys)
    index = sim.tfidf_weights(counts, idf, keys)
    queries = sim.tfidf_weights(sim.descriptor_hashes(ref_local, keys), idf, keys, totals)
    found = sim.tfidf_top_k(queries, index, keys, s.candidate_count)
    local = cut_lineage(sim.pad_with_latest(found, refs, movies, keys, s.candidate_count))
    wide = max(15, s.geometry_limit)
    global_ = cut_lineage(sim.cosine_top_k(refs, movies, keys, wide))
    peak = local.groupBy(*keys, "ref_no").agg(F.greatest(F.max("score"), F.lit(1e-6)).alias("peak"))
    ref_frames, movie_frames = sim.pack_frames(ref_local, keys), sim.pack_frames(movie_local, keys)
    ranks = (
        local.select(*pair, F.col("rank").alias("local_rank"))
        .join(global_.select(*pair, F.col("rank").alias("global_rank")), pair, "full")
    )

    def facts(pairs: DataFrame) -> DataFrame:
        left = refs.select(*keys, "ref_no", F.col("dur_ms").alias("rd"), F.col("vec").alias("rv"), F.col("frames").alias("rf"))
        right = movies.select(*keys, "movie_no", F.col("dur_ms").alias("md"), F.col("vec").alias("mv"), F.col("frames").alias("mf"))
        clip = sim.dot(F.col("rv"), F.col("mv"))
        ratio = sim.duration_ratio(F.col("rd"), F.col("md"))
        compared = (
            pairs.join(left, [*keys, "ref_no"])
            .join(right, [*keys, "movie_no"])
            .select(
                *pair,
                clip01(clip).alias("global_score"),
                clip01(sim.fine_score(clip, F.col("rf"), F.col("mf"), ratio)).alias("fine_score"),
                ratio.alias("dur_ratio"),
            )
        )
        return (
            compared.join(sim.tfidf_pair_scores(pairs, queries, index, keys), pair)
            .join(peak, [*keys, "ref_no"])
            .withColumn("local_score", F.col("local_raw") / F.col("peak"))
            .drop("local_raw", "peak")
            .join(ranks, pair, "left")
        )

    def chosen(candidates: DataFrame) -> DataFrame:
        """The pairs worth verifying: forced ones first, then by the cheap score."""
        forced = (
            F.coalesce(F.col("local_rank") <= min(10, s.geometry_limit), F.lit(False))
            | F.coalesce(F.col("global_rank") <= min(8, s.geometry_limit), F.lit(False))
            | F.col("support").isNotNull()
        )
        cheap = (
            0.35 * F.col("local_score")
            + 0.25 * F.col("fine_score")
            + 0.25 * F.col("global_score")
            + 0.10 * F.col("dur_ratio")
            + F.least(F.coalesce("support", F.lit(0.0)), F.lit(0.30))
        )
        per_ref = Window.partitionBy(*keys, "ref_no")
        order = per_ref.orderBy(F.col("__forced").desc(), F.round(F.col("__cheap"), ROUND).desc(), "movie_no")
        return (
            candidates.withColumn("__forced", forced)
            .withColumn("__cheap", cheap)
            .withColumn("__place", F.row_number().over(order))
            .withColumn("__room", F.greatest(F.lit(s.geometry_limit), F.count_if("__forced").over(per_ref)))
            .where(F.col("__place") <= F.col("__room"))
            .drop("__forced", "__cheap", "__place", "__room")
        )

    def verify(pairs: DataFrame) -> DataFrame:
        matches = sim.ratio_test_matches(pairs, ref_frames, movie_frames, keys)
        return sim.geometry_consensus(matches, keys)

    def ranked(candidates: DataFrame, verified: DataFrame) -> DataFrame:
        scored = candidates.join(verified, pair, "left").fillna(0, ["inliers", "good_matches"]).fillna(0.0, ["geometry"])
        support = F.least(F.coalesce("support", F.lit(0.0)), F.lit(0.30))
        strong = (
            0.55
            + 0.30 * F.col("geometry")
            + 0.05 * F.col("local_score")
            + 0.05 * F.col("fine_score")
            + 0.02 * F.col("global_score")
            + 0.03 * F.col("dur_ratio")
        )
        weak = (
            0.35 * F.col("geometry")
            + 0.20 * F.col("local_score")
            + 0.25 * F.col("fine_score")
            + 0.15 * F.col("global_score")
            + 0.05 * F.col("dur_ratio")
        )
        score = F.round(F.when(F.col("inliers") >= 8, strong).otherwise(weak) + support, ROUND)
        order = Window.partitionBy(*keys, "ref_no").orderBy(F.col("score").desc(), "movie_no")
        return (
            scored.withColumn("score", score)
            .withColumn("support", support)
            .withColumn("rank", F.row_number().over(order).cast("bigint"))
        )

    none = F.lit(None).cast("double").alias("support")
    pairs = sim.expand_candidates(local, global_, refs, keys, s.neighbour_radius, own_local=s.candidate_count)
    known = cut_lineage(facts(pairs))
    first = chosen(known.select("*", none))
    verified = cut_lineage(verify(first))
    preliminary = ranked(first, verified).where(F.col("rank") == 1)

    # Reference shots without a verified match ask their nearest descriptors for more candidates.
    weak = preliminary.where(F.col("inliers") < 8).select(*keys, "ref_no")
    asking = ref_local.join(weak.withColumnRenamed("ref_no", "shot_no"), [*keys, "shot_no"], "left_semi")
    votes = sim.ann_votes(asking, movie_local, keys)
    voted = sim.top_k(votes, [*keys, "ref_no"], "votes", "movie_no", max(s.candidate_count, 24))
    extra = voted.select(*pair).join(known.select(*pair), pair, "left_anti")
    known = cut_lineage(known.unionByName(facts(extra)))
    second = chosen(known.select("*", none))
    fresh = second.select(*pair).join(verified.select(*pair), pair, "left_anti")
    verified = cut_lineage(verified.unionByName(verify(fresh)))
    preliminary = ranked(second, verified).where(F.col("rank") == 1)

    support = cut_lineage(sim.sequence_support(preliminary, refs, movies, keys, s.neighbour_radius))
    extra = support.select(*pair).join(known.select(*pair), pair, "left_anti")
    supported = cut_lineage(known.unionByName(facts(extra))).join(support, pair, "left")
    third = chosen(supported)
    fresh = third.select(*pair).join(verified.select(*pair), pair, "left_anti")
    verified = verified.unionByName(verify(fresh))
    final = ranked(third, verified).where(F.col("rank") <= s.top_k)
    return final.select(
        *pair, "rank", "score", "geometry", "inliers", "good_matches", "local_score", "global_score", "fine_score", "support"
    )


def apply_overrides(candidates: DataFrame, overrides: DataFrame, refs: DataFrame, movies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the candidates of manually paired reference shots; both shots must have features."""
    keys = list(keys)
    left = refs.select(*keys, "ref_no", F.col("dur_ms").alias("rd"), F.col("vec").alias("rv"), F.col("frames").alias("rf"))
    right = movies.select(*keys, "movie_no", F.col("dur_ms").alias("md"), F.col("vec").alias("mv"), F.col("frames").alias("mf"))
    fine = clip01(
        sim.fine_score(sim.dot(F.col("rv"), F.col("mv")), F.col("rf"), F.col("mf"), sim.duration_ratio(F.col("rd"), F.col("md")))
    )
    forced = (
        overrides.select(*keys, "ref_no", "movie_no")
        .join(left, [*keys, "ref_no"])
        .join(right, [*keys, "movie_no"])
        .select(*keys, "ref_no", "movie_no", fine.alias("score"))
        .select(
            *keys,
            "ref_no",
            "movie_no",
            F.lit(1).cast("bigint").alias("rank"),
            "score",
            F.lit(1.0).alias("geometry"),
            F.lit(999).cast("bigint").alias("inliers"),
            F.lit(999).cast("bigint").alias("good_matches"),
            F.col("score").alias("local_score"),
            F.col("score").alias("global_score"),
            F.col("score").alias("fine_score"),
            F.lit(0.0).alias("support"),
            F.lit(True).alias("manual_override"),
        )
    )
    kept = candidates.join(forced.select(*keys, "ref_no"), [*keys, "ref_no"], "left_anti")
    return kept.withColumn("manual_override", F.lit(False)).unionByName(forced)


def _e4(x: Column) -> Column:
    return F.floor(x * 10_000 + 0.5) / 10_000


def alignment_timeline(
    ref_shots: DataFrame, movie_shots: DataFrame, candidates: DataFrame, keys: Sequence[str], settings: Settings = Settings()
) -> DataFrame:
    """One row per reference shot with its match, status, confidence and nested candidates.

    ref_shots: ref_no, ref_shot_id, start_ms, end_ms, has_features; movie_shots: movie_no,
    movie_shot_id, start_ms, end_ms; candidates as written by ``apply_overrides``.
    """
    keys = list(keys)
    source = movie_shots.select(
        *keys, "movie_no", "movie_shot_id", F.col("start_ms").alias("movie_start_ms"), F.col("end_ms").alias("movie_end_ms")
    )
    shown = (
        candidates.where(F.col("rank") <= settings.top_k)
        .join(source, [*keys, "movie_no"])
        .withColumn("final_score", _e4(clip01(F.col("score"))))
    )
    rows = shown.groupBy(*keys, "ref_no").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "rank", "movie_shot_id", "movie_start_ms", "movie_end_ms", "final_score",
                    _e4(F.col("local_score")).alias("local_score"),
                    _e4(F.col("global_score")).alias("global_score"),
                    _e4(F.col("fine_score")).alias("fine_score"),
                    _e4(F.col("geometry")).alias("geometry_score"),
                    "inliers", "good_matches",
                    _e4(F.col("support")).alias("sequence_support"),
                )
            )
        ).alias("candidates"),
        F.min_by(F.struct(clip01(F.col("score")).alias("score"), "movie_shot_id", "movie_start_ms", "movie_end_ms", "inliers", "good_matches", "manual_override"), "rank").alias("best"),
        F.max(F.when(F.col("rank") > 1, F.col("final_score"))).alias("other"),
    )
    joined = ref_shots.join(rows, [*keys, "ref_no"], "left")
    score = F.coalesce("best.score", F.lit(0.0))
    inliers = F.coalesce("best.inliers", F.lit(0))
    gap = _e4(score - F.coalesce("other", F.lit(0.0)))
    reason = F.when(~F.col("has_features"), "missing_reference_clip").when(F.col("best").isNull(), "localization_failed")
    override = F.coalesce("best.manual_override", F.lit(False))
    level = fx.confidence(score, inliers, gap)
    shaped = joined.select(
        *keys,
        "ref_no",
        "ref_shot_id",
        F.col("start_ms").alias("ref_start_ms"),
        F.col("end_ms").alias("ref_end_ms"),
        F.when(F.col("has_features"), F.col("best")).alias("best"),
        F.when(F.col("has_features"), F.col("candidates")).alias("candidates"),
        F.when(F.col("has_features"), score).otherwise(0.0).alias("__score"),
        F.when(F.col("has_features"), inliers).otherwise(0).alias("inliers"),
        F.when(F.col("has_features"), gap).otherwise(0.0).alias("score_gap"),
        reason.alias("reason"),
        override.alias("manual_override"),
        level.alias("__level"),
    )
    status = fx.match_status(
        F.col("reason"), F.col("manual_override"), F.col("__score"), F.col("__level"), F.col("inliers"),
        min_score=settings.min_score, min_inliers=settings.min_inliers,
    )
    return shaped.select(
        *keys,
        "ref_no",
        "ref_shot_id",
        "ref_start_ms",
        "ref_end_ms",
        F.col("best.movie_start_ms").alias("movie_start_ms"),
        F.col("best.movie_end_ms").alias("movie_end_ms"),
        F.array_compact(F.array("best.movie_shot_id")).alias("movie_shot_ids"),
        _e4(F.col("__score")).alias("match_score"),
        F.when(F.col("reason").isNotNull(), "low").when(F.col("manual_override"), "high").otherwise(F.col("__level")).alias("confidence"),
        status.alias("status"),
        "score_gap",
        F.col("inliers").cast("bigint").alias("geometry_inliers"),
        F.coalesce("best.good_matches", F.lit(0)).cast("bigint").alias("good_matches"),
        F.when(F.col("manual_override"), "manual_override").otherwise("independent_shot_localize").alias("match_type"),
        F.coalesce("candidates", F.array().cast(shaped.schema["candidates"].dataType)).alias("candidates"),
    )


def alignment_summary(matches: DataFrame, keys: Sequence[str], *, width: float = ORDINAL_SLICE) -> DataFrame:
    """Totals, rates to four decimals, backward jumps and repeated source shots per project."""
    keys = list(keys)
    good = fx.is_accepted(F.col("status"))
    walked = scan(matches, keys, ["ref_no"], [last_before("__prev", "movie_start_ms")], width=width)
    totals = walked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_ref_shots"),
        F.count_if(good).alias("matched_count"),
        F.count_if(F.col("confidence") == "high").alias("high_confidence_count"),
        F.count_if((F.col("confidence") == "low") | ~good).alias("manual_review_count"),
        F.count_if(F.col("movie_start_ms") < F.col("__prev") - 500).alias("timeline_backward_count"),
    )
    shown = (
        matches.select(*keys, F.explode("movie_shot_ids").alias("shot"))
        .groupBy(*keys, "shot")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg((F.sum("n") - F.count(F.lit(1))).alias("duplicate_movie_shot_count"))
    )
    rate = lambda c: _e4(F.col(c) / F.greatest(F.lit(1), F.col("total_ref_shots")))
    return (
        totals.join(shown, keys, "left")
        .fillna(0, ["duplicate_movie_shot_count"])
        .withColumn("matched_rate", rate("matched_count"))
        .withColumn("high_confidence_rate", rate("high_confidence_count"))
    )
