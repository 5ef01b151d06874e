"""Descriptor matching and normalisation at the sizes real features have."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recut.operators import similarity as sim

LOCAL = "project_id bigint, shot_no bigint, frame_pos bigint, kp_no bigint, x bigint, y bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint"


def descriptors(rng, shot, n):
    word = lambda: rng.getrandbits(64) - (1 << 63)
    return [(0, shot, 0, k, rng.randrange(500), rng.randrange(500), word(), word(), word(), word()) for k in range(n)]


def distance(a, b):
    return sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(a[6:], b[6:], strict=True))


@pytest.mark.parametrize("n", [0, 1, 2, 600])
def test_ratio_test_keeps_all_descriptors(spark, n):
    rng = random.Random(n)
    left = descriptors(rng, 1, 600 if n else 3)
    right = descriptors(rng, 2, n)
    for k in range(0, n, 3):  # copies with a few bits changed
        source = left[k % len(left)]
        right[k] = (*right[k][:6], source[6] ^ 1 << rng.randrange(60), *source[7:])
    frames = lambda rows: sim.pack_frames(spark.createDataFrame(rows, LOCAL), ["project_id"])
    pairs = spark.createDataFrame([(0, 1, 2)], "project_id bigint, ref_no bigint, movie_no bigint")
    got = sim.ratio_test_matches(pairs, frames(left), frames(right), ["project_id"]).select(F.inline("matches")).collect()
    want = []
    for a in left:
        ranked = sorted((distance(a, b), i) for i, b in enumerate(right))
        if len(ranked) > 1 and ranked[0][0] < sim.RATIO * ranked[1][0]:
            best = right[ranked[0][1]]
            want.append((best[4] - a[4], best[5] - a[5], ranked[0][0], ranked[1][0]))
    assert [tuple(r) for r in got] == want


def test_unit_of_long_vectors(spark):
    rng = random.Random(2)
    rows = [([rng.uniform(-1, 1) for _ in range(2176)],) for _ in range(100)] + [([0.0] * 4,)]
    got = [r.v for r in spark.createDataFrame(rows, "vec array<double>").select(sim.unit(F.col("vec")).alias("v")).collect()]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in got[:-1])
    assert got[-1] == [0.0] * 4
