"""Sliced scans and fixed points against plain windows and plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recut.operators import audio as au
from recut.operators import intervals as iv
from recut.operators import runs
from recut.operators import timeline as tl
from recut.operators.ordered import first_after, lag, last_before, lead, max_before, most, position, scan, sum_before, total


def _rows(n: int, seed: int = 3):
    rng = random.Random(seed)
    return [(i % 2, rng.randrange(0, 400), i, rng.choice([None, rng.randrange(50)])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 1_000_000])
@pytest.mark.parametrize("partitions", [1, 5])
def test_scan_equals_plain_windows(spark, width, partitions):
    df = spark.createDataFrame(_rows(300), "k bigint, t bigint, i bigint, v bigint").repartition(partitions, "v")
    specs = [
        lag("a", "v"), lead("b", "v"), sum_before("c", "v"), max_before("d", "v"), last_before("e", "v"), first_after("f", "v"), position("g"),
    ]
    w = Window.partitionBy("k").orderBy("t", "i")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "k", "t", "i", "v", F.lag("v").over(w), F.lead("v").over(w), F.coalesce(F.sum("v").over(before), F.lit(0)), F.max("v").over(before),
        F.last("v", True).over(before), F.first("v", True).over(after), F.row_number().over(w).cast("bigint"),
    )
    got = scan(df, ["k"], ["t", "i"], specs, width=width)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def _greedy(rows, limits):
    kept = set()
    for p, (most, clips) in limits.items():
        for _, i, _, d, c in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[2], r[1])):
            if d * 100 <= most and c <= clips:
                most, clips = most - d * 100, clips - c
                kept.add((p, i))
    return kept


def _needs(case, rng):
    """(priority, need, clips) in order: mixed, each small one before one just too large, halves, and nothing needed."""
    if case == "mixed":
        return [(rng.randrange(5) * 10, rng.randrange(1, 60), rng.randrange(1, 4)) for _ in range(60)]
    if case == "misfits":
        return [(9, x, 1) for k in range(120) for x in (1, 200 - k)]
    if case == "halves":
        return [(9, x, 1) for k in range(9) for x in (2 ** (8 - k), 2 ** (8 - k))]
    return [(9, rng.choice([0, 0, 7]), rng.choice([0, 2])) for _ in range(40)]


@pytest.mark.parametrize("width", [7, 100_000])
def test_greedy_budget_equals_the_loop(spark, width, monkeypatch):
    """All kinds of needs as projects of one table; the rounds stay below the digits of the budgets."""
    rng = random.Random(8)
    rows, limits = [], {}
    for p, case in enumerate(["mixed", "mixed", "misfits", "halves", "nothing"]):
        rows += [(p, i, *x) for i, x in enumerate(_needs(case, rng))]
        limits[p] = (20_000 + 1_500 * p, 15 * (p + 1) if case != "misfits" else 500)
    limits[4] = (0, 9)
    limits[5] = (100, 1)
    df = spark.createDataFrame(rows, "p bigint, seg_no bigint, priority bigint, original_ms bigint, clip_count bigint")
    room = spark.createDataFrame([(p, *x) for p, x in limits.items()], "p bigint, max_ms_x100 bigint, max_clips bigint")
    writes = []
    monkeypatch.setattr(au, "cut_lineage", lambda d, plain=au.cut_lineage: writes.append(1) or plain(d))
    out = au.greedy_budget(df.repartition(3), room, ["p"], width=width).collect()
    assert len(out) == len(rows) and {(r.p, r.seg_no) for r in out if r.kept} == _greedy(rows, limits)
    digits = max(most.bit_length() + clips.bit_length() for most, clips in limits.values())
    assert len(writes) <= 1 + 2 * digits


def test_budget_of_exactly_the_limit_fits(spark):
    df = spark.createDataFrame([(1, 1, 50, 30, 1), (1, 2, 40, 1, 1)], "p bigint, seg_no bigint, priority bigint, original_ms bigint, clip_count bigint")
    limits = spark.createDataFrame([(1, 3_000, 9)], "p bigint, max_ms_x100 bigint, max_clips bigint")
    assert [r.seg_no for r in au.greedy_budget(df, limits, ["p"]).where("kept").collect()] == [1]


@pytest.mark.parametrize("width", [2, 1_000])
def test_dedupe_fixed_point_equals_the_loop(spark, width):
    rng = random.Random(11)
    rows = []
    for item in range(1, 30):
        for pos in range(1, 6):
            start = rng.randrange(0, 40) * 100
            ids = [f"s{rng.randrange(40)}" for _ in range(rng.randrange(0, 3))]
            rows.append((1, item, pos, start, start + rng.choice([20, 90, 300, 700]), ids))
    want, used = [], set()
    for item in range(1, 30):
        cursor = None
        for _, _, pos, start, end, ids in (r for r in rows if r[1] == item):
            keys = {f"shot:{i}" for i in ids} or {f"time:{start / 1000:.3f}-{end / 1000:.3f}"}
            if keys & used:
                continue
            if cursor is not None and start < cursor - 50:
                if end <= cursor + 30:
                    continue
                start = cursor
            if end - start <= 30:
                continue
            used |= keys
            cursor = end if cursor is None else max(cursor, end)
            want.append((item, pos, start, end))
    df = spark.createDataFrame(rows, "p bigint, item_no bigint, range_pos bigint, start_ms bigint, end_ms bigint, shot_ids array<string>")
    got = tl.dedupe_visuals(df.repartition(3), ["p"], width=width)
    assert sorted((r.item_no, r.range_pos, r.start_ms, r.end_ms) for r in got.collect()) == sorted(want)


def test_dedupe_in_waves_equals_one_wave(spark, monkeypatch):
    """Rows whose pictures an earlier wave keeps leave before any round; nulls and several keys a row make no difference."""
    rng = random.Random(12)
    rows = []
    for item in range(1, 200):
        for pos in range(1, 4):
            start = rng.randrange(0, 6) * 1_000
            ids = [f"s{rng.randrange(12)}" for _ in range(rng.choice([0, 1, 1, 2]))]
            rows.append((rng.choice([1, 2]), item, pos, start, start + rng.choice([20, 300, 700]), ids))
    rows += [(None, 1, 1, 0, 500, ["s1"]), (1, None, 1, 0, 500, ["s2"]), (2, 3, 9, None, 500, None), (2, 150, 9, 0, 500, ["new"])]
    df = spark.createDataFrame(rows, "p bigint, item_no bigint, range_pos bigint, start_ms bigint, end_ms bigint, shot_ids array<string>").repartition(3)
    walked, scan = [], tl.scan
    monkeypatch.setattr(tl, "scan", lambda d, *x, **y: walked.append(d.count()) or scan(d, *x, **y))
    found = lambda **x: sorted((r.p, r.item_no, r.range_pos, r.start_ms, r.end_ms, r.shot_ids) for r in tl.dedupe_visuals(df, ["p"], width=1_000, **x).collect())
    in_waves, most = found(wave=20), max(walked)
    assert in_waves == found() and (2, 150, 9, 0, 500, ["new"]) in in_waves
    assert most < 450 and max(walked) > 590  # before, all 600 entered the first round


def test_merge_is_idempotent_and_touching_merges(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 20, 20), (1, 30, 25), (1, 11, 12)], "m bigint, start_ms bigint, end_ms bigint")
    once = iv.merge_intervals(df, ["m"], width=4)
    twice = iv.merge_intervals(once.drop("members"), ["m"], width=4)
    shape = lambda d: sorted((r.start_ms, r.end_ms) for r in d.collect())
    assert shape(once) == shape(twice) == [(0, 9), (11, 12)]


def test_touching_intervals_do_not_overlap(spark):
    left = spark.createDataFrame([(1, 0, 10), (1, 10, 10)], "m bigint, a bigint, b bigint")
    right = spark.createDataFrame([(1, 10, 20), (1, 9, 30)], "m bigint, c bigint, d bigint")
    assert [(r.a, r.c) for r in iv.overlap_join(left, right, ["m"], ("a", "b"), ("c", "d"), bucket=4).collect()] == [(0, 9)]


def test_top_k_prefers_the_larger_index(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.1)], "k bigint, i bigint, v double")
    assert [r.i for r in runs.top_k(df, ["k"], "v", "i", 2).orderBy("rank").collect()] == [3, 2]


def test_keep_last_drops_blank_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("", 3, "z"), (None, 4, "w")], "k string, pos bigint, v string")
    assert [(r.k, r.v) for r in runs.last_per_key(df, ["k"], "pos").collect()] == [("a", "y")]


@pytest.mark.parametrize("width", [7, 1_000_000])
def test_totals_of_the_key(spark, width):
    """``total`` and ``most`` hold the row itself; rows without a key go, whether slices are carried or not."""
    rows = [(*r, None) for r in _rows(60)] + [(None, 3, 900, 1, None)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, i bigint, v bigint, w bigint")
    got = scan(df, ["k"], ["t", "i"], [total("s", "v"), most("m", "t"), total("n", F.lit(1)), sum_before("z", "w")], width=width).collect()
    present = [r for r in rows if r[0] is not None]
    assert sorted(r.i for r in got) == sorted(r[2] for r in present)
    for r in got:
        own = [x for x in present if x[0] == r.k]
        assert (r.s, r.m, r.n, r.z) == (sum(x[3] or 0 for x in own), max(x[1] for x in own), len(own), 0)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("Join")


def test_short_keys_share_one_shuffle(spark):
    """signals, runs, spans and neighbours of short segments follow from one shuffle, without a join."""
    rows = [(s, c, c, 10_000 * c, 10_000 * c + 900 * (1 + (s + c) % 9), 300 * (s % 4), s % 3, "hook") for s in range(50) for c in range(1 + s % 5)]
    schema = "seg_no bigint, clip_pos bigint, clip_index bigint, start_ms bigint, end_ms bigint, covered_ms bigint, subtitle_count bigint, text_role string"
    signals = au.initial_signals(spark.createDataFrame(rows, schema), ["seg_no"])
    smooth = au.smooth_roles(signals, ["seg_no"])
    assert _exchanges(smooth) == (1, 0)
    assert _exchanges(au.best_split(signals, ["seg_no"])) == (1, 0)
    sliced = au.smooth_roles(au.initial_signals(spark.createDataFrame(rows, schema), ["seg_no"], width=2), ["seg_no"], width=2)
    key = lambda df: sorted((r.seg_no, r.clip_pos, r.score, r.audio_role) for r in df.collect())
    assert key(smooth) == key(sliced) and len(key(smooth)) == len(rows)


def test_fitting_short_items_shares_one_shuffle(spark):
    """lengths of an item, shares and numbers of its clips follow from one shuffle, without a join."""
    rows = [(i, p, 100 * p, 100 * p + 40 + 17 * p, 30 * i) for i in range(20) for p in range(1 + i % 5)]
    df = spark.createDataFrame(rows, "item_no bigint, range_pos bigint, start_ms bigint, end_ms bigint, tts bigint")
    short = tl.allocate_clips(df, ["item_no"], "tts")
    assert _exchanges(short) == (1, 0)
    assert sorted(short.collect()) == sorted(tl.allocate_clips(df, ["item_no"], "tts", width=2).collect())
