"""Searches by blocks beside brute force: no row is copied for the blocks it meets, and hot hashes are not copied either."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from recut.operators import similarity as sim

KEYS = ["project_id"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bags(seed, numbers):
    rng = random.Random(seed)
    words = ["the", "of", *(f"w{i}" for i in range(60))]
    return [(0, n, w, c) for n in numbers for w, c in Counter(rng.choices(words, [30, 20] + [1] * 60, k=rng.randint(1, 40))).items()]


def weights_by_hand(counts, df, total):
    raw = {(s, h): math.log1p(n) * (math.log((total + 1) / (df.get(h, 0) + 1)) + 1) for _, s, h, n in counts}
    norms = Counter()
    for (s, _), w in raw.items():
        norms[s] += w * w
    return {(s, h): w / math.sqrt(norms[s]) for (s, h), w in raw.items()}


def test_tfidf_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sim, "OFTEN", 20)
    source, asked = bags(1, range(150)), [*bags(2, range(200, 230)), (0, 231, "unseen", 3), (0, 232, "unseen", 1), (0, 232, "of", 1)]
    schema = "project_id bigint, shot_no bigint, hash string, n bigint"
    a, b = spark.createDataFrame(source, schema), spark.createDataFrame(asked, schema)
    shots = spark.range(160).selectExpr("0L as project_id", "id as shot_no")
    idf = sim.inverse_frequencies(a, shots, KEYS)
    totals = spark.createDataFrame([(0, 160)], "project_id bigint, __total bigint")
    index, queries = sim.tfidf_weights(a, idf, KEYS, also=["df"]), sim.tfidf_weights(b, idf, KEYS, totals)
    assert "Generate" not in plan(index)  # no copies of the looked-up table
    df = Counter(h for _, _, h, _ in source)
    assert 0 < sum(n >= 20 for n in df.values()) < len(df)
    ours, theirs = weights_by_hand(source, df, 160), weights_by_hand(asked, df, 160)
    got = {(r.shot_no, r.hash): (r.weight, r.df) for r in index.collect()}
    assert got.keys() == ours.keys() and all(abs(w - ours[k]) < 1e-12 and n == df[k[1]] for k, (w, n) in got.items())

    best = sim.tfidf_top_k(queries, index, KEYS, 7, size=16)
    assert "CartesianProduct" in plan(best) and "Generate" not in plan(best)  # rows are not copied for each block
    scores = Counter()
    for (q, h), w in theirs.items():
        for n in range(150):
            scores[q, n] += w * ours.get((n, h), 0.0)
    want = set()
    for q in {q for q, _ in theirs}:
        found = sorted(((round(scores[q, n], 9), n) for n in range(150) if round(scores[q, n], 9) > 0), reverse=True)[:7]
        want |= {(q, n, rank, s) for rank, (s, n) in enumerate(found, 1)}
    assert {(r.ref_no, r.movie_no, r["rank"], round(r.score, 9)) for r in best.collect()} == want
    assert sim.tfidf_top_k(queries.limit(0), index, KEYS, 7).count() == sim.tfidf_top_k(queries, index.limit(0), KEYS, 7).count() == 0


def test_cosine_ties_over_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-1, 2, (90, 4)).astype(float)  # many equal scores
    rows = [(n % 2, n, [float(x) for x in v]) for n, v in enumerate(vectors)]
    movie = spark.createDataFrame(rows, "project_id bigint, movie_no bigint, vec array<double>")
    ref = movie.where("movie_no % 3 = 0").withColumnRenamed("movie_no", "ref_no")
    best = sim.cosine_top_k(ref.unionByName(ref.where("ref_no = 0")), movie, KEYS, 5, size=8)
    assert "CartesianProduct" in plan(best) and "Generate" not in plan(best)
    want = set()
    for r in range(3, 90, 3):
        ranked = sorted(((vectors[r] @ vectors[m], m) for m in range(r % 2, 90, 2)), reverse=True)[:5]
        want |= {(r % 2, r, m, rank, s) for rank, (s, m) in enumerate(ranked, 1)}
    rows = best.collect()
    assert {(x.project_id, x.ref_no, x.movie_no, x["rank"], x.score) for x in rows if x.ref_no} == want
    assert len([x for x in rows if x.ref_no == 0]) == 5


def test_votes_over_blocks(spark):
    """Near descriptors of several blocks, ties and repeats."""
    rng = random.Random(5)
    centre = [rng.getrandbits(64) - (1 << 63) for _ in range(4)]
    rows = []
    for shot in range(30):
        for desc in range(4):
            words = [w ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 11))) for w in centre]
            rows.append((0, shot, desc, *words))
    rows.append(rows[9])
    local = spark.createDataFrame(rows, "project_id bigint, shot_no bigint, desc_no bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
    votes = sim.ann_votes(local.where("shot_no % 5 = 0"), local.where("shot_no % 5 <> 0"), KEYS, size=4)
    assert "CartesianProduct" in plan(votes) and "Generate" not in plan(votes)
    want = Counter()
    for _, q, qd, *a in [r for r in rows if r[1] % 5 == 0]:
        near = sorted((sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True)), s, d) for _, s, d, *b in rows if s % 5)
        own = {}
        for dist, s, _ in near[: sim.VOTE_NEIGHBOURS]:
            if dist <= sim.VOTE_MAX_DISTANCE:
                own[s] = min(dist, own.get(s, dist))
        for s, dist in own.items():
            want[q, s] += (68 - dist) / 68
    got = {(r.ref_no, r.movie_no): r.votes for r in votes.collect()}
    assert got.keys() == want.keys() and want and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_bags_of_a_block_are_read_as_written(monkeypatch):
    """Numbered hashes, sorted once: matrices and lists in small pieces give the sums of products; a null hash has no score."""
    monkeypatch.setattr(sim, "DENSE_AT_ONCE", 3)
    monkeypatch.setattr(sim, "ROWS_AT_ONCE", 4)
    monkeypatch.setattr(sim, "MEETINGS_AT_ONCE", 40)
    monkeypatch.setattr(sim, "DENSE_FROM", 12)
    monkeypatch.setattr(sim, "BAG_ROWS", 10)
    rng = random.Random(8)

    def rows(count, first):
        return [(first + n, h, rng.random()) for n in range(count) for h in {*rng.sample(range(8), 3), *rng.sample(range(8, 90), rng.randint(0, 12))}]

    def table(rows):
        shot, hashes, weight = (list(c) for c in zip(*rows, strict=True))
        return sim.Bags.arrange(pa.table({"shot": pa.array(shot), "hash": pa.array(hashes, pa.int64()), "weight": pa.array(weight, pa.float64())}))

    left, right, more = rows(23, 0), rows(31, 100), rows(9, 200)
    left.append((0, None, 0.5))
    right.append((101, None, None))
    a, b = sim.Bags.read([table(left)]), sim.Bags.read([table(right), table(more)])
    got = np.concatenate([scores for _, scores in a.products(b)])
    assert got.shape == (23, 40)
    theirs = Counter()
    for s, h, w in right + more:
        theirs[s, h] = w
    for i, q in enumerate(a.ids):
        for j, n in enumerate(b.ids):
            want = 0.0 if (q, n) == (0, 101) else sum(w * theirs[n, h] for s, h, w in left if s == q and h is not None)
            assert abs(got[i, j] - want) < 1e-12
    assert (a.hashes[1:] > a.hashes[:-1]).all() and (b.hashes[1:] > b.hashes[:-1]).all()
