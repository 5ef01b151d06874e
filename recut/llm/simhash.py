"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of at most 23 bits.  Two fingerprints within two bits agree wholly in one
segment at least (pigeonhole), and in each other segment they differ by two bits at most.  A segment is decoded,
together with all its one-bit neighbours, to the nearest words of the perfect [23, 12, 7] Golay code; segments
within two bits have a neighbour in common and therefore a codeword index in common.  A key is (which segment
agrees, its bits, a codeword index of the next segment), one to six for each of the three segments.  Fingerprints
that share a key are joined; a candidate is then verified by its midpoints: two fingerprints are within two bits
exactly when some value lies within one bit of both, so all that share a midpoint are linked to the smallest of
them.  No group is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recut.llm.common import components
from recut.session import cut_lineage

SHINGLE = 3
SEED = 42
#: (first bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: Shingles whose bits are counted at once.
BLOCK = 8192


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 4,096 messages, and for each of the 2,048 remainders the error of at most three bits."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    messages = np.array([remainder(m << 11) for m in range(1 << 12)], dtype=np.uint32)
    single = [remainder(1 << b) for b in range(23)]
    errors = np.zeros(1 << 11, dtype=np.uint32)
    for i in range(23):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return messages, errors


def codeword_indices(segment: np.ndarray, bits: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each segment a row of the sorted codeword indices of itself and its neighbours, repeats included."""
    messages, errors = tables
    flips = np.array([0, *(1 << b for b in range(bits))], dtype=np.uint32)
    words = segment.astype(np.uint32)[:, None] ^ flips[None, :]
    decoded = words ^ errors[messages[words >> 11] ^ (words & 0x7FF)]
    return np.sort(decoded >> 11, axis=1)


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), BLOCK):
        hashes = [digest(line[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)]
        octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(first))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): 64-bit fingerprints as signed longs.  Null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(run, "id long, fp long")


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): the Golay keys of each distinct fingerprint, at most 18."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [(fp.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << bits) - 1) for at, bits in SEGMENTS]
            for which in range(3):
                near = (which + 1) % 3
                found = codeword_indices(parts[near], SEGMENTS[near][1], tables)
                new = np.ones(found.shape, dtype=bool)
                new[:, 1:] = found[:, 1:] != found[:, :-1]
                row, col = np.nonzero(new)
                key = (np.uint64(which) << np.uint64(34)) | (parts[which][row] << np.uint64(12)) | found[row, col].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints within two bits, enough to connect all that are linked."""
    keys = cut_lineage(fuzzy_keys(fps))
    shared = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    candidates = keys.join(shared.select("key"), "key").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    middles = candidates.select("fp", F.explode(flips).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"), "fp"
    )
    middles = cut_lineage(middles)
    stars = middles.groupBy("middle").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    links = middles.join(stars, "middle").where("fp <> low")
    return links.select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): one row per row of ``docs``; component is the smallest id reachable by links.

    Repeated rows give repeated results.  A null id gets a component but never names one, unless all ids of the
    component are null.  Null, empty and blank texts have fingerprint zero and are linked like any other.
    """
    signed = cut_lineage(fingerprints(docs, id_col, text_col))
    distinct = cut_lineage(signed.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(near_links(distinct)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut_lineage(rooted)
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = cut_lineage(rooted.join(named, "root").select("fp", "component"))
    return signed.join(classes, "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of each component whose doc_id names it, whole; components without any id lose nothing.

    Rows that repeat an id are one document, of which one row stays.
    """
    found = cut_lineage(near_duplicates(docs))
    names = cut_lineage(found.where("id = component").groupBy("id").agg(F.count("*").alias("n")))
    # The names grow with the corpus: a merge join, whatever they measure today.
    kept = docs.join(names.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    if names.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
