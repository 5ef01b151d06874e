"""Neighbour graph, lexical search and filter audit beside brute force, with odd rows."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recut.llm import audit, lexical, nearest, vamana
from recut.llm import queries as corpus
from tests.llm.fixtures import documents, prose

# 11


def nearest_by_hand(rows, asks, k):
    """Exact answers over (id, vector) rows that take part."""
    whole = [(i, np.array(v, dtype=float)) for i, v in rows]
    best: dict[int, dict[int, float]] = collections.defaultdict(dict)
    for i, v in whole:
        if asks(i):
            for j, w in whole:
                if j != i and len(v) == len(w):
                    score = 0.0
                    for a, b in zip(v, w, strict=True):
                        score += a * b
                    best[i][j] = max(score, best[i].get(j, -math.inf))
    return {i: sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k] for i, found in best.items()}


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, id long, dim int, vec string, ids string, place int, shard string, query string, score int"
    return spark.createDataFrame([(i, v, 1, 2, "x", "x", 3, "x", "x", 4) for i, v in rows], schema)


def answers(df):
    found = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        assert r["rank"] == len(found[r["query"]]) + 1
        found[r["query"]].append((r["id"], r["score"]))
    return dict(found)


def rounded(found):
    return {q: [(i, round(s, 6)) for i, s in x] for q, x in found.items()}


def test_small_shards_are_exact(spark):
    """Vectors of all lengths and norms, copies, repeated rows, one id with two vectors, shards smaller than the beam."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * 10.0 ** rng.integers(-2, 3)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [rows[3], rows[3], (20, rows[5][1]), (5000, [1.0, 2.0]), (5001, [0.5, -1.0])]
    odd = [(6000, None), (6001, []), (6002, [0.0] * 6), (6003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (6020, [float("nan")] * 6), (6040, [float("inf")] * 6), (None, [1.0] * 6)]
    df = vectors(spark, rows + odd)
    got = answers(nearest.nearest(df, F.col("vec_id") % 20 == 0, 5, shard=60, beam=96))
    want = nearest_by_hand(rows, lambda i: i % 20 == 0, 5)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    for q, x in got.items():
        assert [s for _, s in x] == pytest.approx([s for _, s in want[q]], rel=1e-12)


def test_few_vectors(spark):
    two = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert answers(nearest.nearest(two, F.col("vec_id") % 20 == 0)) == {0: [(1, 0.0)]}
    assert nearest.nearest(two.where("vec_id = 0"), F.lit(True)).count() == 0
    assert nearest.nearest(two.limit(0), F.lit(True)).count() == 0
    assert nearest.nearest(two, F.col("vec_id") > 1).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).round(3).tolist()) for i in range(200)]
    whole = rounded(answers(nearest.nearest(vectors(spark, rows), F.lit(True), 3, shard=50)))
    monkeypatch.setattr(nearest, "QUERIES", 40)
    assert rounded(answers(nearest.nearest(vectors(spark, rows), F.lit(True), 3, shard=50))) == whole
    want = nearest_by_hand([(i, [float(np.float32(x)) for x in v]) for i, v in rows], lambda i: True, 3)
    assert whole == rounded(want)


def test_recall_of_the_query(spark):
    """All of sf0.1: at least 0.9 of the true neighbours, scores as defined."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, matrix = np.array(table["vec_id"]), np.array(table["embedding"].to_pylist(), dtype=float)
    rows = corpus.queries()["op11_pruned_graph_neighbours"](spark, "/root/testdata/sf0.1").collect()
    got = collections.defaultdict(dict)
    for r in rows:
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    asked = ids[ids % 20 == 0]
    assert set(got) == set(asked) and all(sorted(x) == list(range(1, 21)) for x in got.values())
    hits = 0
    for q in asked:
        score = matrix @ matrix[ids == q][0]
        score[ids == q] = -np.inf
        hits += len({i for i, _ in got[q].values()} & set(ids[np.argsort(-score)[:20]]))
        assert all(s == pytest.approx(score[ids == i][0], rel=1e-9) for i, s in got[q].values())
    assert hits >= 0.95 * 20 * len(asked)


def test_every_node_is_reachable():
    """Tight groups far from each other, and one vector nearly repeated a thousand times."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 16)) * 50
    points = np.vstack([c + rng.normal(size=(300, 16)) * 1e-3 for c in centres] + [centres[0] + rng.normal(size=(1000, 16)) * 1e-6])
    graph = vamana.build(points)
    reached, front = {graph.start}, [graph.start]
    while front:
        front = [int(x) for x in np.unique(graph.edges[front]) if x < graph.size and int(x) not in reached]
        reached.update(front)
    assert len(reached) == graph.size == len(points)
    assert (graph.edges[: graph.size] < graph.size).sum(axis=1).max() <= vamana.ROOM


def test_pruning_keeps_diverse_edges():
    """Of two candidates on one side only the nearer stays; one on the other side stays as well."""
    unit = vamana.unit_vectors(np.array([[1.0, 0.0], [0.99, 0.14], [0.98, 0.199], [0.95, -0.31]]))
    kept = vamana.prune(unit, np.array([0], dtype=np.int32), np.array([[1, 2, 3]], dtype=np.int32))
    assert [x for x in kept[0] if x < 4] == [1, 3]


# 12


def terms_by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked_by_hand(docs, items, k):
    held = [(i, collections.Counter(terms_by_hand(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item or ""] |= set(terms_by_hand(text))
    rows = []
    for item, terms in wanted.items():
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        rows += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(rows, key=str)


ITEM_SCHEMA = "item_id string, text string, item string, block string, term string, id string"


def wanted_items(spark, rows):
    return spark.createDataFrame([r + ("x",) * 4 for r in rows], ITEM_SCHEMA)


LEXICON = "the of an Straße ÜBER über 漢字 ½ a1 naïve x".split()


def lexical_case():
    rng = random.Random(5)
    glue = [" ", ", ", "\n", "-", "_", "'", "\x00", " ", "  "]
    docs = [(i, "".join(rng.choice(LEXICON) + rng.choice(glue) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    docs += [(100 + i, docs[3][1]) for i in range(15)] + [docs[3], (None, docs[3][1]), (200, None), (201, ""), (202, " .,;_ "), (203, "the " * 30_000)]
    items = [("1", "The of THE"), ("2", "über-Straße ½"), ("2", "naïve"), ("3", None), ("4", ""), ("5", "nowhere"), (None, "漢字 x"), ("6", "ve nai Stra"), ("7", "a1 an an")]
    return docs, items


@pytest.mark.parametrize("postings", [lexical.POSTINGS, 3])
def test_ranked(spark, postings, monkeypatch):
    docs, items = lexical_case()
    monkeypatch.setattr(lexical, "CELLS", 64)
    df = documents(spark, docs).repartition(7)
    got = lexical.ranked(df, wanted_items(spark, items), k=4, postings=postings).collect()
    assert sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in got), key=str) == ranked_by_hand(docs, items, 4)


def test_ranked_without_rows(spark):
    docs, items = lexical_case()
    df, wanted = documents(spark, docs), wanted_items(spark, items)
    assert lexical.ranked(df.limit(0), wanted).count() == 0
    assert lexical.ranked(df, wanted.limit(0)).count() == 0
    assert lexical.ranked(df, wanted.where("item_id in ('3', '4', '5')")).count() == 0
    assert lexical.ranked(df.where("doc_id in (200, 201, 202)"), wanted).count() == 0


def test_folding_is_the_term_pattern():
    """Every byte and every character of two planes is a guard or not as the pattern says."""
    for at in [*range(0x800), *range(0x4E00, 0x4E10), 0x1F600, 0x2028]:
        text = f"a{chr(at)}B"
        line = lexical.folded(text.encode())
        assert line.decode().split(" ") == ["", *terms_by_hand(text), ""] or not terms_by_hand(chr(at))
        assert lexical.term_count(line) == len(terms_by_hand(text))


# 13


def masks_by_hand(docs, labels):
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        good, toxic = (any(j == i and marks[at] == 1 for j, *marks in labels) if i is not None else False for at in range(2))
        rows.append((lang or "", failed, good, toxic))
    return rows


def audit_by_hand(docs, labels):
    rows, out = masks_by_hand(docs, labels), []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley, lines = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                failing = sum(r[1][f] for r in mine)
                left = [r for r in left if not r[1][f]]
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                shapley[f] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(9)
    shouting, marked = prose(1, 120).upper(), "price $5 " + prose(2, 150)
    pool = [prose(k, rng.choice([20, 99, 100, 140])) for k in range(12)] + [shouting, marked, "a b " * 80, "", "é" * 50 + "ABCDEF", "a b " * 99, prose(3, 40_000)]
    docs = [(i, rng.choice([*pool, None]), rng.choice(["en", "de", None, ""])) for i in range(200)]
    docs += [docs[0], docs[0], (None, pool[0], "en"), (None, pool[0], "fr"), (900, pool[0], "fr"), (-1, pool[1], "es")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 250, 2)] + [(0, 1, 1), (1, None, None), (None, 1, 1)]
    names = ("id", "key", "part", "mask", "n", "digest", "good", "toxic", "least", "first", "side")
    schema = "doc_id long, text string, lang string" + "".join(f", {n} string" for n in names)
    df = spark.createDataFrame([d + ("x",) * len(names) for d in docs], schema).repartition(6)
    marks = spark.createDataFrame([r + ("x", "x") for r in labels], "doc_id long, quality int, toxic int, id string, good string")
    got = audit.audit(df, marks)
    assert [f.name for f in got.schema] == [n for n, _ in audit.SCHEMA]
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(docs, labels)
    assert audit.audit(df.limit(0), marks).count() == 0
    assert audit.audit(df, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order(n):
    letters = "ABCDEF"[:n]
    rng = random.Random(n)
    counts = {m: (rng.randint(0, 3), 0, 0) for m in range(1 << n) if rng.random() < 0.7}
    diagram = audit.Diagram(letters, counts)
    seen = {"".join(diagram.order)}
    for level in audit.adjacent_swaps(n):
        diagram.swap(level)
        seen.add("".join(diagram.order))
        left = counts
        for f, removed, kept in diagram.steps():
            bit = 1 << letters.index(f)
            assert removed[0] == sum(w[0] for m, w in left.items() if m & bit)
            left = {m: w for m, w in left.items() if not m & bit}
            assert kept[0] == sum(w[0] for w in left.values())
    assert len(seen) == math.factorial(n)
