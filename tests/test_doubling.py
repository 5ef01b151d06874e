"""Cuts and segments by pointer doubling and scenes by scans, beside the loops they stand for."""

from __future__ import annotations

import random

import pytest

from recut.operators import narration, shots


def spaced_by_hand(peaks, gap):
    last, kept = 0, []
    for at in sorted(peaks):
        if at - last >= gap:
            kept.append(at)
            last = at
    return kept


@pytest.mark.parametrize("width", [50, 100_000])
def test_select_cuts(spark, width):
    """Crowded peaks (long chains), sparse ones, and media of one kind only, in slices shorter than a chain."""
    rng = random.Random(2)
    media = {m: sorted(rng.sample(range(1_500), n)) for m, n in enumerate([0, 1, 5, 200, 700])}
    media[5] = list(range(0, 1_500, 2))  # every second frame: one chain
    rows = [(m, f, 1.0 if f in peaks else 0.0, "x") for m, peaks in ((m, set(p)) for m, p in media.items()) for f in range(1_500)]
    scores = spark.createDataFrame(rows, "m long, frame_no long, score double, label string").repartition(3)
    cutoffs = spark.createDataFrame([(m, 0.5) for m in media], "m long, cutoff double")
    got = shots.select_cuts(scores, cutoffs, ["m"], width=width).collect()
    want = {(m, at) for m, peaks in media.items() for at in spaced_by_hand(peaks, 9)}
    assert sorted((r.m, r.frame_no) for r in got) == sorted(want)


def scenes_by_hand(scenes, frames, min_frames=2):
    out = []
    for start, end in sorted(scenes):
        start, end = max(0, start), min(max(0, frames - 1), end)
        if end < start:
            continue
        if out and start <= out[-1][1]:
            out[-1][1] = end
        elif not out or end - start + 1 >= min_frames:
            out.append([start, end])
    return [tuple(x) for x in out] or [(0, max(0, frames - 1))]


@pytest.mark.parametrize("width", [7, 100_000])
def test_normalize_scenes(spark, width):
    rng = random.Random(6)
    media = {}
    for m in range(40):
        starts = rng.sample(range(-3, 60), rng.randint(1, 30))
        media[m] = [(s, s + rng.choice([-1, 0, 0, 0, 1, 2, 5])) for s in starts]
    rows = [(m, s, e, 55) for m, scenes in media.items() for s, e in scenes]
    df = spark.createDataFrame(rows, "m long, start_frame long, end_frame long, frame_count long").repartition(3)
    got = shots.normalize_scenes(df, ["m"], width=width).collect()
    want = {(m, *scene) for m, scenes in media.items() for scene in scenes_by_hand(scenes, 55)}
    assert {(r.m, r.start_frame, r.end_frame) for r in got} == want and len(got) == len(want)


def opened_by_hand(subtitles, pause, most):
    """Subtitle numbers that open a segment; subtitles are (number, start, end, shots) in order."""
    opened, shown, end_before = [], set(), None
    for no, start, end, own in subtitles:
        if end_before is None or start - end_before > pause or len(shown | own) > most:
            opened.append(no)
            shown = set()
        shown |= own
        end_before = end
    return opened


@pytest.mark.parametrize("most", [0, 1, 3, 6])
@pytest.mark.parametrize("width", [200, 1_000_000])
def test_capped_segments(spark, width, most):
    """Pauses, subtitles without or with too many shots, repeated shots, and a long stretch without any pause."""
    rng = random.Random(9)
    media = {}
    for m in range(6):
        at, told = 0, []
        for no in range([1, 5, 40, 40, 150, 300][m]):
            at += rng.choice([5, 20, 20, 90]) if m != 5 else 10
            own = {rng.randrange(no // 9, no // 9 + 4) for _ in range(rng.choice([0, 0, 1, 2, 9]))} if m % 2 else {no // 30}
            told.append((no, at, at + 8, own))
        media[m] = told
    rows = [(m, no, a, b, "t", sorted(own), "x") for m, told in media.items() for no, a, b, own in told]
    df = spark.createDataFrame(rows, "m long, sub_no long, start_ms long, end_ms long, text string, shots array<long>, other string").repartition(3)
    last = df.selectExpr("m", "sub_no", "lag(end_ms) over (partition by m order by start_ms, sub_no) p")
    flagged = df.join(last, ["m", "sub_no"]).selectExpr("m", "sub_no", "start_ms", "shots", "other", "coalesce(start_ms - p > 30, true) opens")
    got = narration._capped_opens(flagged, ["m"], ["start_ms", "sub_no"], most, width).collect()
    want = {(m, no) for m, told in media.items() for no in opened_by_hand(told, 30, most)}
    assert len(got) == len(rows) and {(r.m, r.sub_no) for r in got if r.opens} == want
