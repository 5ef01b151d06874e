"""Near copies beside brute-force Jaccard of five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
from recut.llm import overlap, simhash
from tests.llm.fixtures import documents, prose


def shingles_by_hand(text: str | None) -> set:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_by_hand(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles_by_hand(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def edited(rng: random.Random, words: list[str], n: int) -> str:
    words = words[:]
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(spark, monkeypatch):
    """Copies on both sides of the limit, chains, a passage in every document, short and blank texts."""
    monkeypatch.setattr(overlap, "COMMON", 8)
    rng = random.Random(3)
    passage = prose(99, 30)
    texts: dict[int, str | None] = {1: None, 2: "", 3: " \n", 4: "one", 5: "One", 6: "a b c d", 7: "a b c d e"}
    for base in range(6):
        words = prose(base, rng.randint(60, 300)).split()
        for n in range(20):
            texts[len(texts) + 1] = f"{edited(rng, words, rng.randint(0, len(words) // 30))} {passage}"
    for n in range(12):  # a chain: each is near the next, the ends are not near
        texts[len(texts) + 1] = " ".join(prose(500, 400).split()[n * 20 : n * 20 + 200])
    want = groups_by_hand(texts)
    assert 5 < len(set(want.values())) < len(texts) - 20
    docs = documents(spark, list(texts.items())).repartition(5)
    rows = overlap.near_copies(docs).collect()
    least: dict[int, int] = {}
    for r in rows:
        least[r.component] = min(least.get(r.component, r.id), r.id)
    assert {r.id: least[r.component] for r in rows} == want
    stage = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert stage.columns == docs.columns
    assert sorted(r.doc_id for r in stage.collect()) == sorted(set(want.values()))


def test_repeated_ids(spark):
    """Only rows that repeat id and text are one document."""
    a, b = prose(1, 80), prose(2, 80)
    docs = documents(spark, [(1, a), (1, a), (1, b), (2, b), (2, prose(3, 80)), (None, a), (None, a)])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a), (1, b), (2, prose(3, 80)), (0, a), (0, a)])


def test_fingerprints_propose_links(spark, monkeypatch):
    """The stage's first links come from op10's Golay keys: with no prefix of shingles to go by, they alone are found."""
    rng = random.Random(8)
    words = prose(7, 3000).split()
    texts = {1: " ".join(words), 2: prose(8, 200), 3: edited(rng, words, 1), 4: " ".join(words).upper(), 5: edited(rng, prose(9, 60).split(), 2), 6: prose(9, 60)}
    fps = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    assert 0 < (fps[1] ^ fps[3]).bit_count() <= 2 < ((fps[5] ^ fps[6]) % 2**64).bit_count()
    asked = []
    monkeypatch.setattr(overlap, "near_links", lambda fps: asked.append(1) or simhash.near_links(fps))
    stage = lambda: sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, list(texts.items())), "").collect())
    whole = sorted(set(groups_by_hand(texts).values()))
    assert stage() == whole and asked
    monkeypatch.setattr(overlap, "shared_shingles", lambda signed: signed.selectExpr("0L as hash", "node", "n", "1 as place", "1L as weight").limit(0))
    assert 3 not in stage() and 1 in stage()
