"""Best-fit packing of token sequences with exact-complement hashing.

Texts become pieces of at most ``CAPACITY`` tokens.  Only how many pieces there are of each length decides how they
are packed, so the plan is made from a table of at most ``CAPACITY`` counts: for each length, from the longest down,
the gap it leaves is looked up among single lengths, then sums of two, then sums of three that are still available,
and exact combinations are taken as often as their supply allows; what is left is packed best-fit, longest first, a
whole group of equal sequences at a time.  The plan is a list of slots (length, ranks from, sequences from, offset),
whose size depends on the capacity and not on the corpus.  Each piece finds its slot by its rank among the pieces of
its length, which Spark counts in two steps, within tasks and then across them.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recut.llm.tokens import encoder
from recut.session import cut_lineage

CAPACITY = 2048
END = 0


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth): cut texts; nth counts a task's pieces of that length.

    A text is its ids and the end id; a null text is empty and has the end id alone.  Only texts longer than the
    capacity are cut, and there the first piece takes what whole pieces leave over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder()
        seen = [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            for name, text, task in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = ids_of(text or "")
                ids.append(END)
                if sys.byteorder == "big":
                    ids.byteswap()
                octets, n = memoryview(ids).cast("B"), len(ids)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((name, k, a, b - a, zlib.crc32(octets[4 * a : 4 * b]), task, seen[b - a]))
                    seen[b - a] += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            )

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("task"))
    return picked.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


@dataclass
class Pattern:
    lengths: tuple[int, ...]
    times: int


class Complements:
    """Which sums of one, two or three available lengths fill a gap exactly."""

    def __init__(self, supply: np.ndarray) -> None:
        self.supply = supply
        self.stale = True

    def _pair(self, total: int) -> tuple[int, int] | None:
        """The pair with the longest member."""
        if total < 2:
            return None
        have = self.supply[1:total] > 0
        both = have & have[::-1]
        if total % 2 == 0 and self.supply[total // 2] < 2:
            both[total // 2 - 1] = False
        at = np.flatnonzero(both)
        return (int(at[-1]) + 1, total - int(at[-1]) - 1) if at.size else None

    def _index(self) -> None:
        """Sums of pairs that were available when the index was made: a superset of those that still are."""
        have = (self.supply > 0).astype(np.float64)
        self.sums = np.rint(np.fft.irfft(np.fft.rfft(have, 2 * have.size) ** 2, 2 * have.size))[: have.size] > 0
        self.stale = False

    def find(self, gap: int, parts: int) -> tuple[int, ...] | None:
        """Lengths that fill the gap, ``parts`` of them."""
        if parts == 1:
            return (gap,) if self.supply[gap] > 0 else None
        if parts == 2:
            return self._pair(gap)
        if self.stale:
            self._index()
        firsts = np.flatnonzero((self.supply[1:gap] > 0) & self.sums[gap - 1 : 0 : -1]) + 1
        for first in firsts[::-1].tolist():
            self.supply[first] -= 1
            pair = self._pair(gap - first)
            self.supply[first] += 1
            if pair:
                return (first, *pair)
        return None


def exact_fills(supply: np.ndarray, capacity: int, most: int) -> list[Pattern]:
    """Take combinations that fill the capacity while they last: a length with one other, then with two, then three,
    up to ``most``.  ``supply`` is used up."""
    found: list[Pattern] = []
    if supply[capacity]:
        found.append(Pattern((capacity,), int(supply[capacity])))
        supply[capacity] = 0
    index = Complements(supply)
    for parts in range(1, most + 1):
        for length in range(capacity - 1, 0, -1):
            index.stale = True
            while supply[length]:
                supply[length] -= 1
                rest = index.find(capacity - length, parts)
                supply[length] += 1
                if rest is None:
                    break
                lengths = (length, *rest)
                times = min(int(supply[x]) // lengths.count(x) for x in lengths)
                for x in lengths:
                    supply[x] -= times
                found.append(Pattern(lengths, times))
    return found


def best_fit(supply: np.ndarray, capacity: int) -> list[Pattern]:
    """Longest first, each into the fullest sequence that has room, groups of equal sequences at a time."""
    done: list[Pattern] = []
    groups: dict[int, list[Pattern]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: Pattern) -> None:
        if gap == 0:
            done.append(pattern)
            return
        if not groups.get(gap):
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append(pattern)

    for length in range(capacity, 0, -1):
        left = int(supply[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, Pattern((length,) * each, left // each))
                if left % each:
                    put(capacity - (left % each) * length, Pattern((length,) * (left % each), 1))
                left = 0
                break
            gap = gaps[at]
            group = groups[gap].pop()
            if not groups[gap]:
                gaps.pop(at)
            each = min(gap // length, max(left, 1))
            times = min(group.times, left // each)
            if times < group.times:
                put(gap, Pattern(group.lengths, group.times - times))
            put(gap - each * length, Pattern(group.lengths + (length,) * each, times))
            left -= times * each
        supply[length] = 0
    return done + [p for patterns in groups.values() for p in patterns]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots (length, rank from, sequence from, offset), sorted; ranks run to the next slot of the length."""
    supply = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        supply[length] = n

    def packed(most: int) -> list[Pattern]:
        left = supply.copy()
        return exact_fills(left, capacity, most) + best_fit(left, capacity)

    # Long combinations use up short lengths that might have filled other gaps: the fewest sequences win.
    patterns = min((packed(most) for most in (3, 2, 1, 0)), key=lambda ps: sum(p.times for p in ps))
    slots, used, sequence = [], [0] * (capacity + 1), 0
    for pattern in patterns:
        offset = 0
        for length in pattern.lengths:
            slots.append((length, used[length], sequence, offset))
            used[length] += pattern.times
            offset += length
        sequence += pattern.times
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    Repeated rows and ids are packed as often as they come; null ids stay null; an empty table gives no rows.
    """
    cut = cut_lineage(pieces(docs, id_col, text_col, capacity))
    groups = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = cut_lineage(groups.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r.length: r.n for r in based.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = plan(counts, capacity)
    keys = (slots[:, 0] << 44) | slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            placed = [slots[at, 2] + rank - slots[at, 1], slots[at, 3]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *(pa.array(p, pa.int64()) for p in placed)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut.join(based, ["length", "task"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
