"""Registered queries beside their SQL twins, or a brute-force version, over the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import zlib
from array import array

import duckdb
import public_tokenizers
import pytest
import xxhash

from recut.llm import queries as corpus
from tests.oracle import connect, rows_of

ROOT = "/root/testdata/sf0.001"
QUERIES = corpus.queries()
TWINS = corpus.oracle_sql()


def result(spark, number: int) -> list[dict]:
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    return [r.asDict() for r in QUERIES[name](spark, ROOT).collect()]


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{ROOT}/documents.parquet'").fetchall())


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 14))
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", list(TWINS))
def test_twin(spark, name):
    got = QUERIES[name](spark, ROOT)
    cursor = connect(ROOT).execute(TWINS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, cursor.fetchall())


def test_rule_ensemble(spark, texts):
    labels = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    name = next(n for n in QUERIES if n.startswith("op1_"))
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95


def test_token_counts(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = result(spark, 5)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == {i: (len(t.encode()), len(library.encode(t))) for i, t in texts.items()}
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)


def remove_by_hand(texts: dict[int, bytes], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for i in sorted(texts):
        text = texts[i]
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            window = text[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[i] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings(spark, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result(spark, 6)}
    assert got == remove_by_hand({i: t.encode() for i, t in texts.items()})


def check_packing(rows: list[dict], texts: dict[int, str], capacity: int = 2048) -> int:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    total = 0
    for i, text in texts.items():
        ids = array("I", [*library.encode(text, add_special_tokens=False).ids, 0])
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids)
        total += at
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert len(sequences) <= -(-total // capacity) * 1.03 + 2
    return len(sequences)


def test_packing(spark, texts):
    check_packing(result(spark, 7), texts)


def fingerprint_by_hand(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints: dict[int, int], distance: int = 2) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in prints}


def test_near_duplicates(spark, texts):
    prints = {i: fingerprint_by_hand(t) for i, t in texts.items()}
    groups = components_by_hand(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, 10)}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}
