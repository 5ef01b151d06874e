"""Removal of repeated byte strings by suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes (a window) that also starts earlier in the corpus.

1. Every window has an anchor: its gram of ``GRAM`` bytes with the smallest hash, the first of equal ones.  Equal
   windows have equal anchors at equal places.  Windows that follow each other and share an anchor form a block.
2. Anchors that occur once in the corpus have only first windows; they are counted away.  Of the other blocks, equal
   ones are combined and the first is kept.
3. Anchors with several different blocks: the bytes of these blocks meet by anchor, in batches of bounded size, and
   are suffix-sorted in two stages.  Suffixes that are smaller than their successor are sorted directly; the others
   follow by scanning buckets of the first byte in order, each suffix putting its predecessor next.  Neighbours in
   the order with a common prefix of ``LENGTH`` bytes are equal windows, of which the first stays.  An anchor with
   more than ``GROUP`` different blocks is dealt to several batches, and what is first in these is compared once
   more by the digest of the window.
4. Windows in blocks with repeated anchors that are not among the first ones mark what is removed.

Only hashes, places and the bytes of contested blocks are shuffled by content; counts and minima are combined before
each shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recut.session import cut_lineage

LENGTH = 100
GRAM = 32
#: Bytes handled at once: short texts together, long ones in pieces.
CHUNK = 1 << 18
#: Different blocks of one anchor that meet in one batch, and bytes of a batch.
GROUP = 10_000
BATCH = 1 << 20
PLACE_BITS = 24

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _byte_values() -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(b"byte values").digest(8 * 256), dtype="<u8").astype(np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n, step = x.size - width + 1, 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


class Blocks:
    """Anchors and blocks of texts, found with whole-array operations."""

    def __init__(self) -> None:
        self.values = _byte_values()
        size = 2 * CHUNK + 2 * LENGTH
        self.powers, self.inverses = _powers(_BASE, size), _powers(_INVERSE, size)

    def pieces(self, ids: list, texts: list[bytes]) -> Iterator[tuple[list, list, list[bytes]]]:
        """(ids, first places, bytes): groups of about CHUNK bytes; a long text in pieces that overlap by a window."""
        who: list = []
        at: list[int] = []
        data: list[bytes] = []
        size = 0
        for name, text in zip(ids, texts, strict=True):
            for begin in range(0, len(text) - LENGTH + 1, CHUNK):
                piece = text[begin : begin + CHUNK + LENGTH - 1]
                if size and size + len(piece) > CHUNK + LENGTH:
                    yield who, at, data
                    who, at, data, size = [], [], [], 0
                who.append(name)
                at.append(begin)
                data.append(piece)
                size += len(piece)
        if data:
            yield who, at, data

    def find(self, data: list[bytes], whole: bool) -> tuple[np.ndarray, ...]:
        """(text number, anchor hash, first window, last window, block hash); the last two of each are wanted if whole."""
        sizes = np.array([len(d) for d in data])
        ends = np.cumsum(sizes)
        raw = self.values[np.frombuffer(b"".join(data), dtype=np.uint8)]
        gram, step = raw, 1
        while step < GRAM:
            power = self.powers[step]
            gram = gram[:-step] * power + gram[step:]
            step *= 2
        gram = _mixed(gram)
        place = np.arange(gram.size, dtype=np.uint64)
        keyed = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place
        anchor = (_sliding_min(keyed, LENGTH - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        n = anchor.size
        text = np.repeat(np.arange(len(data)), sizes)[:n]
        inside = np.arange(n) + LENGTH <= ends[text]
        change = np.empty(n, dtype=bool)
        change[0] = True
        change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(change & inside)
        stops = np.flatnonzero(np.append(change[1:] | ~inside[1:], True) & inside)
        text, anchor = text[first], anchor[first]
        if not whole:
            return (gram[anchor],)
        low, high = first, stops
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * self.powers[: raw.size], dtype=np.uint64)))
        content = (prefix[high + LENGTH] - prefix[low]) * self.inverses[low]
        shape = ((anchor - low) * 128 + (high - low)).astype(np.uint64)
        block = _mixed(content ^ _mixed(shape + np.uint64(1)))
        begins = (ends - sizes)[text]
        return text, gram[anchor], low - begins, high - begins, block


def two_stage_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Wanted positions of ``text`` in the order of the suffixes that begin there, compared over LENGTH bytes or more.

    ``text`` holds bytes plus one; zeros end its strings, and the last value is one.  A position is small if its
    suffix is smaller than its successor's.  Small ones are sorted directly.  Then buckets are scanned by first
    value: a bucket holds first the large suffixes, already put there by their successors, then the small ones; each
    member puts its predecessor, if that is large, at the end of what its bucket holds so far.
    """
    n = text.size
    step = np.sign(np.append(text[1:], 0).astype(np.int16) - text)
    known = np.where(step != 0, np.arange(n), n - 1)
    known = np.minimum.accumulate(known[::-1])[::-1]
    small = (step[known] > 0) & (text != 0)
    # A large suffix is put by its successor: go on to the first small or ending position after each wanted one.
    stop = np.where(small | (text == 0), np.arange(n), n - 1)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, np.flatnonzero(wanted), 1)
    np.add.at(edge, stop[wanted] + 1, -1)
    needed = np.cumsum(edge[:n]) > 0
    large = needed & ~small & (text != 0)

    direct = _sorted_by_content(text, np.flatnonzero(needed & small))
    heads = text[direct]
    bounds = np.searchsorted(heads, np.arange(258))
    put: list[list[np.ndarray]] = [[] for _ in range(257)]
    put[0].append(np.flatnonzero(needed & (text == 0)))
    order = []
    for head in range(257):
        run = np.concatenate(put[head]) if put[head] else np.empty(0, np.int64)
        own = [run]
        while run.size:  # predecessors with the same first value are large as well and follow in this bucket
            run = run[run > 0] - 1
            run = run[large[run] & (text[run] == head)]
            own.append(run)
        bucket = np.concatenate((*own, direct[bounds[head] : bounds[head + 1]]))
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[large[before] & (text[before] > head)]
        by = text[before]
        ranked = np.argsort(by, kind="stable")
        before, by = before[ranked], by[ranked]
        cuts = np.flatnonzero(np.diff(by)) + 1
        for group in np.split(before, cuts) if before.size else []:
            put[text[group[0]]].append(group)
    found = np.concatenate(order)
    return found[wanted[found]]


def _words(text: np.ndarray) -> np.ndarray:
    """At each position the next four values, nine bits each, as one number."""
    padded = np.concatenate((text.astype(np.uint64), np.zeros(7, np.uint64)))
    pairs = (padded[:-1] << np.uint64(9)) | padded[1:]
    fours = (pairs[:-2] << np.uint64(18)) | pairs[2:]
    return fours[: text.size]


def _sorted_by_content(text: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Positions sorted by the LENGTH values from there: by four or more at a time, only among those still equal."""
    words = _words(text)
    eights = (words[: text.size].astype(np.uint64), np.append(words[4:], np.zeros(4, np.uint64)))
    n = text.size
    if positions.size < 2:
        return positions
    rank = np.lexsort((eights[1][positions], eights[0][positions]))
    positions = positions[rank]
    a, b = eights[0][positions], eights[1][positions]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    for depth in range(8, LENGTH, 8):
        group = np.cumsum(new)
        tied = ~(new & np.append(new[1:], True))
        at = np.flatnonzero(tied)
        if not at.size:
            break
        here = positions[at]
        far = np.minimum(here + depth, n - 1)
        a, b, g = eights[0][far], eights[1][far], group[at]
        rank = np.lexsort((b, a, g))
        positions[at] = here[rank]
        a, b, g = a[rank], b[rank], g[rank]
        new[at] = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (g[1:] != g[:-1]))
    return positions


def first_windows(contexts: list[bytes]) -> np.ndarray:
    """For contexts in corpus order, which of their windows are the first of their content, all in one array.

    A context of m bytes has m - LENGTH + 1 windows.
    """
    joined = np.frombuffer(b"".join(c + b"\0" for c in contexts), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1) - 1
    text = joined.astype(np.int16) + 1
    text[ends] = 0
    owner = np.repeat(np.arange(sizes.size), sizes + 1)
    wanted = np.arange(text.size) + LENGTH <= ends[owner]
    order = two_stage_order(text, wanted)
    # Neighbours with a common prefix of LENGTH bytes.
    words = _words(text)
    same = np.ones(max(order.size - 1, 0), dtype=bool)
    for depth in range(0, LENGTH, 4):
        left = np.flatnonzero(same)
        same[left] = words[order[left] + depth] == words[order[left + 1] + depth]
    first = np.zeros(text.size, dtype=bool)
    if order.size:
        first[np.minimum.reduceat(order, np.flatnonzero(np.append(True, ~same)))] = True
    return first[wanted]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of each run of true flags."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for batch in batches:
            for _, _, data in blocks.pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (anchor,) = blocks.find(data, whole=False)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])

    return docs.select("uid", "text").mapInArrow(run, "anchor long")


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for batch in batches:
            for who, at, data in blocks.pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, anchor, low, high, block = blocks.find(data, whole=True)
                begin = np.array(at)[text]
                columns = [anchor.view(np.int64), block.view(np.int64), np.array(who)[text], low + begin, high + begin]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "block", "uid", "low", "high"])

    return docs.select("uid", "text").mapInArrow(run, "anchor long, block long, uid long, low long, high long")


def _contexts(docs: DataFrame, variants: DataFrame) -> DataFrame:
    """(anchor, part, parts, uid, low, bytes) of the blocks that differ from others of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "part", "parts", "uid", "low", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for uid, text, picked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(x["anchor"], x["part"], x["parts"], uid, x["low"], text[x["low"] : x["high"] + LENGTH]) for x in picked]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts = F.ceil(F.col("kinds") / GROUP)
    picked = variants.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("uid", "low"), F.col("parts")))
    picked = picked.groupBy("uid").agg(F.collect_list(F.struct("anchor", "part", "parts", "low", "high")).alias("picked"))
    joined = docs.select("uid", "text").join(picked, "uid").select("uid", "text", "picked")
    return joined.mapInArrow(run, "anchor long, part long, parts long, uid long, low long, bytes binary")


def _firsts(contexts: DataFrame) -> DataFrame:
    """(uid, low, high, digest): runs of windows that are the first of their batch; single windows with their digest
    where the anchor was dealt to several batches."""

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[3], r[4]))
        flags = first_windows([r[5] for r in rows])
        out, at = [], 0
        for _, _, parts, uid, low, content in rows:
            n = len(content) - LENGTH + 1
            for a, b in zip(*(x.tolist() for x in _runs(flags[at : at + n])), strict=True):
                if parts == 1:
                    out.append((uid, low + a, low + b, None))
                else:
                    out += [(uid, low + k, low + k, hashlib.blake2b(content[k : k + LENGTH], digest_size=16).digest()) for k in range(a, b + 1)]
            at += n
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["uid", "low", "high", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH and row[:2] != held[-1][:2]:  # whole groups only
                    yield sort(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield sort(held)

    dealt = contexts.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(run, "uid long, low long, high long, digest binary")


def _removed(docs: DataFrame, places: DataFrame) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def one(text: bytes, contested: list | None, first: list | None) -> tuple[int, int, bytes]:
        if not contested:
            return 0, 0, text
        marks = np.zeros(len(text) + 1, dtype=np.int32)
        for spans, sign in ((contested, 1), (first or [], -1)):
            low = np.array([s["low"] for s in spans], dtype=np.int64)
            high = np.array([s["high"] for s in spans], dtype=np.int64)
            np.add.at(marks, low, sign)
            np.add.at(marks, high + 1, -sign)
        repeated = np.cumsum(marks) > 0
        low, high = _runs(repeated)
        cover = np.zeros(len(text) + 1, dtype=np.int32)
        np.add.at(cover, low, 1)
        np.add.at(cover, high + LENGTH, -1)
        gone = np.cumsum(cover)[: len(text)] > 0
        return int(gone.sum()), len(_runs(gone)[0]), np.frombuffer(text, np.uint8)[~gone].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text, contested, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, spans, kept = one(text, contested, first)
                out.append((name, len(text), n, spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    joined = docs.join(places, "uid", "left").select("id", "text", "contested", "first")
    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, text): uid orders the corpus.  It is the id where ids are present and differ; else rows are numbered
    in order of id (missing ones last) and text, in a written table."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    repeats = plain.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").limit(1).count()
    if not repeats:
        return plain.withColumn("uid", F.col("id"))
    order = [F.col("id").asc_nulls_last(), F.col("text").asc()]
    ranged = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn("uid", F.monotonically_increasing_id()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): one row per row of ``docs``.

    "Earlier" goes by id, then place.  A null text is empty; texts shorter than a window lose nothing and take
    nothing from others.  Of rows with one id, or without, the order is that of their texts; equal rows count one
    after the other.
    """
    texts = numbered(docs, id_col, text_col)
    counted = _anchors(texts).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(counted.select("anchor"))
    contested = cut_lineage(_blocks(texts).join(shared, "anchor"))
    # Equal blocks are combined; the first keeps its place.
    distinct = contested.groupBy("anchor", "block").agg(F.min(F.struct("uid", "low", "high")).alias("at"))
    distinct = cut_lineage(distinct.select("anchor", "at.*"))
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"))
    told = cut_lineage(distinct.join(kinds, "anchor"))
    alone = told.where("kinds = 1").select("uid", "low", "high")
    compared = cut_lineage(_firsts(_contexts(texts, told.where("kinds > 1"))))
    merged = compared.where("digest is not null").groupBy("digest").agg(F.min(F.struct("uid", "low", "high")).alias("at")).select("at.*")
    first = alone.unionByName(compared.where("digest is null").drop("digest")).unionByName(merged)
    marked = contested.select("uid", "low", "high", F.lit(True).alias("all")).unionByName(first.withColumn("all", F.lit(False)))
    span = F.struct("low", "high")
    places = marked.groupBy("uid").agg(
        F.collect_list(F.when(F.col("all"), span)).alias("contested"), F.collect_list(F.when(~F.col("all"), span)).alias("first")
    )
    return _removed(texts, cut_lineage(places))
