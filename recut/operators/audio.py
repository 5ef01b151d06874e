"""Which clips keep their original sound: timing signals, split patterns and the global budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recut.functions.media import PATTERNS
from recut.operators.intervals import gap_groups
from recut.operators.ordered import ORDINAL_SLICE, TIME_SLICE_MS, lag, lead, scan, sum_before, told, total
from recut.operators.runs import run_ids
from recut.session import cut_lineage

# Fixed values of the rules; times in milliseconds, shares in per cent.
STRONG_COVER, WEAK_COVER = 45, 20
CONNECTED_GAP_MS = 1_000
SHORT_CLIP_MS = 1_200
MIN_BLOCK_MS = 3_000
BUDGET_PERCENT = 30

ORIGINAL, NARRATION = "original_dialogue", "narration"


def initial_signals(ranges: DataFrame, keys: Sequence[str], *, pos: str = "clip_pos", width: float = ORDINAL_SLICE) -> DataFrame:
    """Score every clip of a segment from subtitle coverage, place and length, then from its neighbours.

    ranges: segment keys, clip_pos from 0, start_ms, end_ms, covered_ms, subtitle_count, text_role.
    """
    keys = list(keys)
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    covered = F.col("covered_ms")
    place = (
        F.when(F.lower("text_role") == "ending", -4)
        .when(
            F.lower("text_role") == "hook",
            F.when(F.col(pos) < F.greatest(F.lit(1), F.floor(F.col("__total") * 6 / 10)), -3).otherwise(-1),
        )
        .otherwise(0)
    )
    cover = (
        F.when((length > 0) & (covered * 100 >= length * STRONG_COVER), 3)
        .when((length > 0) & (covered * 100 >= length * WEAK_COVER), 2)
        .when(covered > 0, 1)
        .otherwise(-3)
    )
    extra = F.when(F.col("subtitle_count") >= 2, 1).otherwise(0) - F.when(length < SHORT_CLIP_MS, 1).otherwise(0)
    coverage = F.when(length > 0, F.floor(covered * 10_000 / length + 0.5)).otherwise(0).cast("bigint")
    near = scan(
        ranges, keys, [pos],
        [lag("__pc", coverage), lag("__pe", "end_ms"), lead("__nc", coverage), lead("__ns", "start_ms"), total("__total", F.lit(1))],
        width=width,
    )
    weak = WEAK_COVER * 100
    before = (F.col("__pc") >= weak) & (F.col("start_ms") <= F.col("__pe") + CONNECTED_GAP_MS)
    after = (F.col("__nc") >= weak) & (F.col("__ns") <= F.col("end_ms") + CONNECTED_GAP_MS)
    bonus = (F.col("coverage_e4") >= weak) & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    score = F.col("__base") + F.when(bonus, 1).otherwise(0)
    signals = (
        near.withColumn("coverage_e4", coverage)
        .withColumn("__base", place + cover + extra)
        .withColumn("score", score.cast("bigint"))
        .withColumn("audio_role", F.when(F.col("score") >= 3, ORIGINAL).otherwise(NARRATION))
        .drop("__base", "__pc", "__pe", "__nc", "__ns", "__total")
    )
    return told(signals, near)


def smooth_roles(signals: DataFrame, keys: Sequence[str], *, pos: str = "clip_pos", width: float = ORDINAL_SLICE) -> DataFrame:
    """Short original runs become narration; then a short narration clip between originals flips back."""
    keys = list(keys)
    runs = run_ids(signals, keys, [pos], "audio_role", "__run", width=width)
    edged = scan(runs, keys, [pos], [lag("__before", "__run"), lead("__behind", "__run")], width=width)
    edge = lambda other, time: F.when(F.col(other).isNull() | (F.col(other) != F.col("__run")), F.col(time))
    ends = [total("__from", edge("__before", "start_ms")), total("__to", edge("__behind", "end_ms"))]
    spans = scan(edged, [*keys, "__run"], [pos], ends, width=width)
    span = F.greatest(F.lit(0), F.col("__to") - F.col("__from"))
    kept = told(spans.withColumn("audio_role", F.when((F.col("audio_role") == ORIGINAL) & (span < MIN_BLOCK_MS), NARRATION).otherwise(F.col("audio_role"))), spans)
    near = scan(
        kept, keys, [pos],
        [lag("__pr", "audio_role"), lag("__pe", "end_ms"), lead("__nr", "audio_role"), lead("__ns", "start_ms")],
        width=width,
    )
    flips = (
        (F.col("audio_role") == NARRATION)
        & (F.col("__pr") == ORIGINAL)
        & (F.col("__nr") == ORIGINAL)
        & (F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")) <= SHORT_CLIP_MS)
        & (F.col("start_ms") <= F.col("__pe") + CONNECTED_GAP_MS)
        & (F.col("__ns") <= F.col("end_ms") + CONNECTED_GAP_MS)
    )
    return near.withColumn("audio_role", F.when(flips, ORIGINAL).otherwise(F.col("audio_role"))).drop(
        "__run", "__before", "__behind", "__from", "__to", "__pr", "__pe", "__nr", "__ns"
    )


def best_split(signals: DataFrame, keys: Sequence[str], *, pos: str = "clip_pos", width: float = ORDINAL_SLICE) -> DataFrame:
    """The all, none, prefix or suffix pattern that fits the clip scores best.

    Every clip is worth its score less 2.5 as original and the opposite as narration; doubled, these
    are whole numbers.  Ties go to none, all, then the earliest split, originals last before first.
    """
    keys = list(keys)
    worth = (F.col("score") * 2 - 5).cast("bigint")
    before = scan(signals, keys, [pos], [sum_before("__p", worth), total("__s", worth)], width=width)
    s, p, k = F.col("__s"), F.col("__p"), F.col(pos)
    plain = F.array(
        F.struct((-s).alias("value"), F.lit(0).cast("bigint").alias("rank"), F.lit(PATTERNS[0]).alias("pattern")),
        F.struct(s.alias("value"), F.lit(-1).cast("bigint").alias("rank"), F.lit(PATTERNS[1]).alias("pattern")),
    )
    split = F.array(
        F.struct((s - 2 * p).alias("value"), (-2 * k).cast("bigint").alias("rank"), F.lit(PATTERNS[2]).alias("pattern")),
        F.struct((2 * p - s).alias("value"), (-2 * k - 1).cast("bigint").alias("rank"), F.lit(PATTERNS[3]).alias("pattern")),
    )
    offered = before.withColumn("__best", F.array_max(F.when(k == 0, plain).otherwise(split)))
    picked = offered.groupBy(*keys).agg(F.max(F.struct("__best", F.col("clip_index").alias("at"))).alias("b"))
    chosen = F.col("b")["__best"]["pattern"]
    return picked.select(
        *keys,
        chosen.alias("audio_pattern"),
        F.when(chosen.isin(PATTERNS[2], PATTERNS[3]), F.col("b.at")).alias("split_clip_index"),
        F.lit("timing_rule").alias("source"),
    )


def clip_roles(ranges: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Role and action of every clip under its segment's pattern."""
    keys = list(keys)
    joined = ranges.join(decisions.select(*keys, "audio_pattern", "split_clip_index"), keys, "left")
    at = F.col("clip_index") >= F.col("split_clip_index")
    original = (
        F.when(F.col("audio_pattern") == PATTERNS[1], True)
        .when(F.col("audio_pattern") == PATTERNS[2], at)
        .when(F.col("audio_pattern") == PATTERNS[3], ~at)
        .otherwise(False)
    )
    return (
        joined.withColumn("is_original", F.coalesce(original, F.lit(False)))
        .withColumn("audio_role", F.when(F.col("is_original"), ORIGINAL).otherwise(NARRATION))
        .withColumn("audio_action", F.when(F.col("is_original"), "keep_original_audio").otherwise("narration"))
    )


def original_blocks(clips: DataFrame, keys: Sequence[str], *, width: float = TIME_SLICE_MS) -> DataFrame:
    """Per segment: original clips, total and shortest length of their time-connected blocks."""
    keys = list(keys)
    grouped = gap_groups(
        clips.where("is_original"), keys, ["start_ms", "clip_index"], gap=CONNECTED_GAP_MS, out="__block", width=width
    )
    blocks = grouped.groupBy(*keys, "__block").agg(
        F.greatest(F.lit(0), F.max_by("end_ms", F.struct("start_ms", "clip_index")) - F.min("start_ms")).alias("__len"),
        F.count(F.lit(1)).alias("__n"),
    )
    return blocks.groupBy(*keys).agg(
        F.sum("__n").alias("clip_count"), F.sum("__len").alias("original_ms"), F.min("__len").alias("shortest_ms")
    )


def budget_totals(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length and number of all clips of a project, and how much of each may keep its sound."""
    keys = list(keys)
    totals = ranges.groupBy(*keys).agg(
        F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("total_ms"),
        F.count(F.lit(1)).alias("total_clips"),
    )
    return totals.select(
        *keys,
        "total_ms",
        "total_clips",
        (F.col("total_ms") * BUDGET_PERCENT).alias("max_ms_x100"),
        F.ceil(F.col("total_clips") * BUDGET_PERCENT / 100).cast("bigint").alias("max_clips"),
    )


def default_priority(priority: Column, duration_ms: Column) -> Column:
    return F.coalesce(priority.cast("double"), 50.0 + F.least(F.lit(25.0), duration_ms / 1_000))


def greedy_budget(candidates: DataFrame, limits: DataFrame, keys: Sequence[str], *, width: float = ORDINAL_SLICE) -> DataFrame:
    """Keep candidates by (priority down, order up) while both budgets hold; one that does not fit is skipped.

    candidates: keys, seg_no, priority, original_ms, clip_count.  All projects advance together in rounds.  A candidate
    is large if it asks for more than half of what is left of either budget.  As long as no large one fits, the small
    ones are kept by a running total; a round ends for a project at the first large one that fits, which is kept, or
    the first small one that does not, which is not.  Either way at most half of one budget is left, so the rounds are
    no more than the binary digits of both budgets, whatever the candidates.  What is larger than the rest drops out.
    """
    keys = list(keys)
    ranked = candidates.withColumn("__neg", -F.col("priority").cast("double"))
    room = limits.select(*keys, F.col("max_ms_x100").cast("bigint").alias("__ms"), F.col("max_clips").alias("__clips"))
    columns = [*keys, "seg_no", "__neg", "__need", "clip_count", "__ms", "__clips"]
    need = (F.col("original_ms") * 100).cast("bigint")
    able = (F.col("__need") <= F.col("__ms")) & (F.col("clip_count") <= F.col("__clips"))
    open_rows = cut_lineage(ranked.join(room, keys).withColumn("__need", need).select(*columns).where(able))
    order = ["__neg", "seg_no"]
    rank = F.struct(*order)
    small = (2 * F.col("__need") <= F.col("__ms")) & (2 * F.col("clip_count") <= F.col("__clips"))
    fits = (F.col("__used_ms") + F.col("__need") <= F.col("__ms")) & (F.col("__used_clips") + F.col("clip_count") <= F.col("__clips"))
    settled = open_rows.select(*keys, "seg_no").limit(0)
    while not open_rows.isEmpty():
        totals = [sum_before("__used_ms", F.when(small, F.col("__need"))), sum_before("__used_clips", F.when(small, F.col("clip_count")))]
        totalled = scan(open_rows, keys, order, totals, width=width)
        totalled = totalled.withColumn("__small", small).withColumn("__fits", fits)
        stops = totalled.groupBy(*keys).agg(F.min(F.when(F.col("__small") != F.col("__fits"), rank)).alias("__stop"))
        side = (
            F.when(rank > F.col("__stop"), "open")
            .when(rank == F.col("__stop"), F.when(F.col("__fits"), "kept").otherwise("out"))
            .otherwise(F.when(F.col("__small"), "kept").otherwise("out"))
        )
        judged = cut_lineage(totalled.join(stops, keys).withColumn("__side", side).select(*columns, "__side"))
        kept = judged.where("__side = 'kept'")
        settled = settled.unionByName(kept.select(*keys, "seg_no"))
        used = kept.groupBy(*keys).agg(F.sum("__need").alias("__k_ms"), F.sum("clip_count").alias("__k_clips"))
        left_over = (
            judged.where("__side = 'open'")
            .join(used, keys, "left")
            .fillna(0, ["__k_ms", "__k_clips"])
            .withColumn("__ms", F.col("__ms") - F.col("__k_ms"))
            .withColumn("__clips", F.col("__clips") - F.col("__k_clips"))
        )
        open_rows = cut_lineage(left_over.where(able).select(*columns))
    marked = settled.withColumn("__kept", F.lit(True))
    return candidates.join(marked, [*keys, "seg_no"], "left").select(
        *candidates.columns, F.coalesce("__kept", F.lit(False)).alias("kept")
    )


def apply_budget(decisions: DataFrame, blocks: DataFrame, limits: DataFrame, keys: Sequence[str], *, width: float = ORDINAL_SLICE) -> DataFrame:
    """Decisions after the budget: short blocks and what does not fit fall back to narration.

    decisions: keys, seg_no, audio_pattern, split_clip_index, priority, source; blocks as written by
    ``original_blocks``.
    """
    keys = list(keys)
    # Read four times below, one of them in rounds: settle it once.
    stats = cut_lineage(decisions.join(blocks, [*keys, "seg_no"], "left").fillna(0, ["clip_count", "original_ms"]))
    quiet = stats.where(F.col("clip_count") <= 0)
    short = stats.where((F.col("clip_count") > 0) & (F.col("shortest_ms") < MIN_BLOCK_MS))
    eligible = stats.where((F.col("clip_count") > 0) & (F.col("shortest_ms") >= MIN_BLOCK_MS)).withColumn(
        "priority", default_priority(F.col("priority"), F.col("original_ms"))
    )
    judged = greedy_budget(eligible, limits, keys, width=width)
    narrated = lambda df, source: df.select(
        *keys, "seg_no", F.lit(PATTERNS[0]).alias("audio_pattern"), F.lit(None).cast("bigint").alias("split_clip_index"),
        F.lit(source).alias("source"), "clip_count", "original_ms", F.lit(False).alias("kept"),
    )
    as_is = lambda df, kept: df.select(
        *keys, "seg_no", "audio_pattern", "split_clip_index", "source", "clip_count", "original_ms", F.lit(kept).alias("kept")
    )
    return (
        as_is(quiet, False)
        .unionByName(narrated(short, "budget_min_original_block"))
        .unionByName(as_is(judged.where("kept"), True))
        .unionByName(narrated(judged.where("not kept"), "budget_over_limit"))
    )


def budget_summary(budgeted: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of kept and rejected decisions and the time and clips they use, per project."""
    keys = list(keys)
    counts = budgeted.groupBy(*keys).agg(
        F.count_if("kept").alias("kept_count"),
        F.sum(F.when(F.col("kept"), F.col("original_ms")).otherwise(0)).alias("used_original_ms"),
        F.sum(F.when(F.col("kept"), F.col("clip_count")).otherwise(0)).alias("used_original_clips"),
        F.count_if(F.col("source") == "budget_min_original_block").alias("rejected_short"),
        F.count_if(F.col("source") == "budget_over_limit").alias("rejected_budget"),
        F.count_if(F.col("source") == "timing_fallback_after_model").alias("fallback_count"),
    )
    return limits.join(counts, keys, "left")


def audio_blocks(clips: DataFrame, keys: Sequence[str], *, pos: str = "clip_pos", width: float = ORDINAL_SLICE) -> DataFrame:
    """Runs of clips of one kind with their clip indexes, start and end."""
    keys = list(keys)
    kind = F.when(F.col("audio_role") == ORIGINAL, "original_audio").otherwise("narration")
    runs = run_ids(clips.withColumn("type", kind), keys, [pos], "type", "block_no", width=width)
    return runs.groupBy(*keys, "block_no", "type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(pos, "clip_index"))), lambda s: s.clip_index).alias("clip_indexes"),
        F.min_by("start_ms", pos).alias("start_ms"),
        F.max_by("end_ms", pos).alias("end_ms"),
    )


def narration_text(clips: DataFrame, texts: DataFrame, keys: Sequence[str], *, width: float = ORDINAL_SLICE) -> DataFrame:
    """The part of a segment's text spoken over its narration clips, by share of running time.

    Both ends of a share are rounded half up to whole characters; a segment without original clips
    keeps its text, one whose slices are blank keeps it too.
    """
    keys = list(keys)
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    narrowed = clips.select(*keys, "clip_index", "is_original", length.alias("__len"))  # read twice below
    timed = scan(narrowed, keys, ["clip_index"], [sum_before("__from", "__len")], width=width)
    totals = timed.groupBy(*keys).agg(
        F.sum("__len").alias("__total"), F.count(F.lit(1)).alias("__n"), F.count_if(~F.col("is_original")).alias("__spoken")
    )
    whole = texts.join(totals, keys, "left")
    chars = F.char_length("old_text")
    at = lambda c: F.floor((2 * chars * c + F.col("__total")) / (2 * F.col("__total")))
    first, last = at(F.col("__from")), at(F.col("__from") + F.col("__len"))
    sliced = (
        timed.where(~F.col("is_original"))
        .join(whole.where(F.col("__total") > 0), keys)
        .select(
            *keys,
            "clip_index",
            F.trim(F.col("old_text").substr((first + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int")), F.lit(" \n\r\t")).alias("__part"),
        )
    )
    parts = sliced.groupBy(*keys).agg(
        F.trim(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("clip_index", "__part"))), lambda s: s["__part"])), F.lit(" \n\r\t")).alias("__text")
    )
    text = F.coalesce("old_text", F.lit(""))
    chosen = (
        F.when((text == "") | F.col("__n").isNull() | (F.col("__spoken") == 0), "")
        .when((F.col("__spoken") == F.col("__n")) | (F.col("__total") <= 0), text)
        .when(F.coalesce("__text", F.lit("")) != "", F.col("__text"))
        .otherwise(text)
    )
    return whole.join(parts, keys, "left").select(*keys, chosen.alias("narration_text"))


def validate_model_decisions(answers: DataFrame, clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Check decisions a language model proposed; anything unusable becomes a fallback row.

    answers: keys, audio_pattern, split_clip_index, priority (texts).  A split must be an existing clip
    index above the lowest one.
    """
    keys = list(keys)
    indexes = clips.groupBy(*keys).agg(F.min("clip_index").alias("__low"), F.count(F.lit(1)).alias("__n"))
    exists = clips.select(*keys, F.col("clip_index").alias("__split")).distinct().withColumn("__known", F.lit(True))
    pattern = F.trim("audio_pattern")
    wanted = answers.withColumn("__split", F.col("split_clip_index").try_cast("bigint"))
    checked = wanted.join(indexes, keys, "left").join(exists, [*keys, "__split"], "left")
    valid_split = F.coalesce(F.col("__known") & (F.col("__split") > F.col("__low")) & (F.col("__n") >= 2), F.lit(False))
    plain = pattern.isin(PATTERNS[0], PATTERNS[1])
    usable = F.coalesce(plain | (pattern.isin(PATTERNS[2], PATTERNS[3]) & valid_split), F.lit(False))
    priority = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("priority").try_cast("double"), F.lit(50.0))))
    return checked.select(
        *keys,
        F.when(usable, pattern).otherwise(PATTERNS[0]).alias("audio_pattern"),
        F.when(usable & ~plain, F.col("__split")).alias("split_clip_index"),
        F.when(~usable | (pattern == PATTERNS[0]), 0.0).otherwise(priority).alias("priority"),
        F.when(usable, "model").otherwise("fallback").alias("source"),
    )


def fill_fallbacks(answers: DataFrame, timing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fallback rows, and segments without an answer, take the timing decision instead."""
    keys = list(keys)
    rule = timing.select(*keys, F.col("audio_pattern").alias("__p"), F.col("split_clip_index").alias("__s"))
    use = F.coalesce(F.col("source") == "fallback", F.lit(True))
    return rule.join(answers, keys, "left").select(
        *keys,
        F.when(use, F.col("__p")).otherwise(F.col("audio_pattern")).alias("audio_pattern"),
        F.when(use, F.col("__s")).otherwise(F.col("split_clip_index")).alias("split_clip_index"),
        F.when(~use, F.col("priority")).alias("priority"),
        F.when(use, "timing_fallback_after_model").otherwise(F.col("source")).alias("source"),
    )


def segment_audio_role(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One role per segment from the set of actions of its ranges."""
    actions = F.array_sort(F.collect_set("audio_action"))
    has = lambda a: F.array_contains("__a", a)
    role = (
        F.when(has("manual_review"), "manual_review")
        .when((F.size("__a") == 1) & has("rewrite_and_voiceover"), "narration_overlay")
        .when((F.size("__a") == 1) & has("play_original_audio"), "original_dialogue")
        .when(has("rewrite_and_voiceover") & has("play_original_audio"), "mixed")
        .otherwise("unknown")
    )
    return ranges.groupBy(*keys).agg(actions.alias("__a")).select(*keys, role.alias("segment_audio_role"))


def range_audio_decision(ranges: DataFrame, keys: Sequence[str], mode: str = "audio_mode", *, pos: str = "range_pos") -> DataFrame:
    """Role and action of an item's ranges where they agree, else the default of its mode."""
    action = F.coalesce(F.nullif("audio_action", F.lit("")), F.lit("rewrite_and_voiceover"))
    role = F.nullif("audio_role", F.lit(""))
    merged = ranges.groupBy(*keys, mode).agg(
        F.min(role).alias("r0"), F.max(role).alias("r1"), F.min(action).alias("a0"), F.max(action).alias("a1"),
        F.transform(F.array_sort(F.collect_list(F.struct(pos, "range_id"))), lambda s: s.range_id).alias("source_range_ids"),
    )
    m = F.col(mode)
    default_role = F.when(m == "original", "original_dialogue").when(m == "mixed", "mixed_narration_and_dialogue").otherwise("narration_overlay")
    default_action = (
        F.when(m == "original", "play_original_audio").when(m == "mixed", "play_original_audio_low_volume").otherwise("rewrite_and_voiceover")
    )
    return merged.select(
        *keys, mode,
        F.when(F.col("r0") == F.col("r1"), F.col("r0")).otherwise(default_role).alias("audio_role"),
        F.when(F.col("a0") == F.col("a1"), F.col("a0")).otherwise(default_action).alias("audio_action"),
        "source_range_ids",
    )


def no_subtitle_shortcut(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments none of whose ranges carries subtitle text are all narration."""
    return (
        ranges.groupBy(*keys)
        .agg(F.bool_or(F.trim(F.coalesce("subtitle_text", F.lit(""))) != "").alias("__any"))
        .where(~F.col("__any"))
        .select(*keys, F.lit(PATTERNS[0]).alias("audio_pattern"), F.lit(None).cast("bigint").alias("split_clip_index"))
    )
