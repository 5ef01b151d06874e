"""Similar texts by shared words against a comparison of all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from recut.operators.wordbags import similar_texts


def by_hand(left, right, least):
    bags = lambda rows: [(i, Counter(re.findall(r"[^\W_]+", (t or "").lower()))) for i, t, *_ in rows]
    out = set()
    for i, a in bags(left):
        for j, b in bags(right):
            shared, total = (a & b).total(), a.total() + b.total()
            if shared and 2.0 * shared / total >= least:
                out.add((i, j, shared, a.total(), b.total()))
    return out


@pytest.mark.parametrize("least", [0.05, 0.3, 0.5, 0.65, 1.0])
def test_equals_all_pairs(spark, least):
    """Repeated words, texts of frequent words only, near copies, equal texts, empty and null ones, one very long one."""
    rng = random.Random(4)
    common, rare = ["the", "of", "a"], [f"w{k}" for k in range(60)]
    text = lambda: " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(1, 25)))
    left = [(i, text(), "x") for i in range(40)] + [(90, None, "x"), (91, "", "x"), (92, "the the the", "x"), (93, " --- ", "x")]
    right = [(i, text(), 1) for i in range(80)] + [(100 + i, t.upper() + " the", 1) for i, t, _ in left[:20]] + [(i + 200, t, 1) for i, t, _ in left[:5]]
    right += [(300, None, 1), (301, "The the", 1), (302, "word " * 30_000 + text(), 1), (303, text() + " the" * 500, 1)]
    a = spark.createDataFrame(left, "i long, text string, word string").repartition(3)
    b = spark.createDataFrame(right, "j long, text string, n int").repartition(3)
    got = [tuple(r) for r in similar_texts(a, b, "i", "j", least=least).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(left, right, least)


def test_empty_tables(spark):
    a = spark.createDataFrame([(1, "one two")], "i long, text string")
    none = a.limit(0).withColumnRenamed("i", "j")
    assert similar_texts(a, none, "i", "j").count() == 0
    with pytest.raises(ValueError):
        similar_texts(a, none, "i", "j", least=0)


def test_what_cannot_be_similar_is_not_written(spark, monkeypatch):
    """Texts too long or too short for the other side leave at once, words of one side only before the bags are built."""
    from recut.operators import wordbags

    written, write = [], wordbags.cut_lineage
    monkeypatch.setattr(wordbags, "cut_lineage", lambda df: written.append(write(df)) or written[-1])
    left = [(i, f"the of a x{i} y{i} z{i}") for i in range(10)]
    long_ones = [(i, " ".join(f"the of w{k}" for k in range(200))) for i in range(50)]
    others = [(100 + i, " ".join(f"q{i}r{k}" for k in range(8)) + " the") for i in range(50)]
    right = [*long_ones, *others, (200, "the of x3 y3 z3 a"), (201, "the")]
    a, b = spark.createDataFrame(left, "i long, text string"), spark.createDataFrame(right, "j long, text string")
    got = {tuple(r) for r in similar_texts(a, b, "i", "j", least=0.5).collect()}
    assert got == by_hand(left, right, 0.5) and (3, 200, 6, 6, 6) in got
    counts = [df.count() for df in written]
    assert max(counts) <= 50 * 9 + 6 and counts[-1] == 1 and sum(counts) <= 50 * 9 + 6 + 100


def test_texts_of_one_id_count_as_one(spark):
    left = [(1, "one two two"), (None, "one two two"), (2, "five")]
    right = [(7, "one two"), (7, "two"), (8, "one two two"), (None, "one two two"), (9, None), (9, "five"), (10, "five"), (10, "six " * 9)]
    a, b = spark.createDataFrame(left, "i long, text string"), spark.createDataFrame(right, "j long, text string")
    got = {tuple(r) for r in similar_texts(a, b, "i", "j", least=0.5).collect()}
    assert got == {(1, 7, 3, 3, 3), (1, 8, 3, 3, 3), (2, 9, 1, 1, 1)}
