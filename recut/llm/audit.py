"""How filters act on each other, read from count-weighted decision diagrams.

Every text is judged by all filters at once; its failure mask is one path through a diagram with one level for each
filter.  A node weighs what lies below it, so in the order of the levels the path on which all filters pass tells, step
by step, what each removes and what stays.  One diagram is built for each part.  Swapping two adjacent levels rewrites
only those levels, and a chain of such swaps visits every order once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: What a node weighs: documents, those labelled good, those labelled toxic.
WEIGHTS = ("docs", "good", "toxic")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))
NOTHING = (0, 0, 0)


class Diagram:
    """A decision diagram of failure masks: (variable, pass, fail) nodes, equal ones shared, weights at the leaves."""

    def __init__(self, filters: str, counts: dict[int, tuple[int, int, int]]):
        self.order = list(filters)
        self.nodes: dict[tuple, tuple] = {}
        self.weights: dict[int, tuple[int, int, int]] = {}
        self.root = self._grown(0, 0, counts)

    def _grown(self, level: int, mask: int, counts: dict) -> tuple:
        if level == len(self.order):
            return self._leaf(counts.get(mask, NOTHING))
        passed = self._grown(level + 1, mask, counts)
        return self._node(self.order[level], passed, self._grown(level + 1, mask | 1 << level, counts))

    def _leaf(self, weight: tuple[int, int, int]) -> tuple:
        leaf = self.nodes.setdefault(("", weight), ("", weight))
        self.weights[id(leaf)] = weight
        return leaf

    def _node(self, variable: str, passed: tuple, failed: tuple) -> tuple:
        key = (variable, id(passed), id(failed))
        if key not in self.nodes:
            self.nodes[key] = (variable, passed, failed)
            self.weights[id(self.nodes[key])] = tuple(a + b for a, b in zip(self.weigh(passed), self.weigh(failed), strict=True))
        return self.nodes[key]

    def weigh(self, node: tuple) -> tuple[int, int, int]:
        return self.weights[id(node)]

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the next one; nodes below are used as they are."""
        upper, lower = self.order[level], self.order[level + 1]
        done: dict[int, tuple] = {}

        def rewritten(node: tuple, depth: int) -> tuple:
            if id(node) not in done:
                _, passed, failed = node
                if depth < level:
                    done[id(node)] = self._node(node[0], rewritten(passed, depth + 1), rewritten(failed, depth + 1))
                else:
                    (_, pp, pf), (_, fp, ff) = passed, failed
                    done[id(node)] = self._node(lower, self._node(upper, pp, fp), self._node(upper, pf, ff))
            return done[id(node)]

        self.root = rewritten(self.root, 0)
        self.order[level], self.order[level + 1] = lower, upper

    def steps(self) -> list[tuple[str, tuple, tuple]]:
        """(variable, removed, kept) along the path on which all filters pass."""
        found, node = [], self.root
        while node[0]:
            found.append((node[0], self.weigh(node[2]), self.weigh(node[1])))
            node = node[1]
        return found

    def only(self) -> dict[str, int]:
        """Documents that fail this filter alone: from its failing edge on, all others pass."""
        found, node = {}, self.root
        while node[0]:
            end = node[2]
            while end[0]:
                end = end[1]
            found[node[0]] = self.weigh(end)[0]
            node = node[1]
        return found


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next, one after another, to come through all orders of n once."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        level = next(inner, None)
        if level is None:
            return
        # The last variable rests at the front after a way down, behind the others after a way up.
        yield level + 1 if down else level
        down = not down


def interactions(filters: str, counts: dict[int, tuple[int, int, int]]) -> Iterator[dict]:
    """One row for each order and step; ``counts`` maps masks (bit i: filter i fails) to weights."""
    diagram = Diagram(filters, counts)
    fails = {f: sum(w[0] for mask, w in counts.items() if mask >> i & 1) for i, f in enumerate(filters)}
    only = diagram.only()
    orders = [("".join(diagram.order), diagram.steps())]
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        orders.append(("".join(diagram.order), diagram.steps()))
    total = dict.fromkeys(filters, 0)
    for _, steps in orders:
        for f, removed, _ in steps:
            total[f] += removed[0]
    for order, steps in orders:
        for step, (f, removed, kept) in enumerate(steps, 1):
            yield {
                "filter_order": order, "step": step, "kept": kept[0], "removed": removed[0], "redundant": fails[f] - removed[0],
                "unique_fails": only[f], "good_lost": removed[1], "toxic_lost": removed[2], "shapley": total[f],
            }


def failures(text: bytes) -> int:
    """The mask of the filters that look at one text alone: A, B, C, D."""
    words = text.split()  # bytes split at \x20 and \x09-\x0D, no others
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, CONTINUED)))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < 100)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * capitals > 10 * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask, digest): the four masks of whole texts and the SHA-256 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column(2):
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                masks.append(failures(text))
                digests.append(hashlib.sha256(text).digest())
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "mask", "digest"])

    picked = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("binary").alias("text")
    )
    return picked.mapInArrow(run, "id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents of each part have each failure mask.

    Rows are first summed by text, part, id and labels.  Within a text only the rows of its smallest id pass filter E;
    one partially aggregated minimum and a window over those sums find them, so no copy meets another.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    known = judged(docs, id_col, text_col, part_col).join(marks.where("id is not null"), "id", "left").na.fill(0, ["good", "toxic"])
    kind = ["part", "mask", "good", "toxic"]
    # The rows of one text that share a kind: how many, their smallest id, and how many rows have it.
    same = known.groupBy("digest", *kind, "id").agg(F.count("*").alias("n")).groupBy("digest", *kind)
    same = same.agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("nameless"), F.min_by("n", "id").alias("at_least"))
    first = same.groupBy("digest").agg(F.min("least").alias("first"))
    split = same.join(first, "digest").select(
        *kind, "n", (F.coalesce("nameless", F.lit(0)) + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)).alias("passing")
    )
    sides = F.array(F.struct(F.col("mask"), F.col("passing").alias("docs")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("docs")))
    rows = split.select("part", "good", "toxic", F.explode(sides).alias("side")).select("part", "side.*", "good", "toxic").where("docs > 0")
    return rows.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), F.sum(F.expr("docs * good")).alias("good"), F.sum(F.expr("docs * toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step.

    Null texts are empty, null parts the empty string.  Every row of ``docs`` counts, repeated ones too.  A row without
    an id never fails E nor makes another fail; rows that share the smallest id of a text all pass it.  A document is
    good (toxic) if any of its label rows says so; labels of no document are not counted.  A table without rows gives
    none.  Other columns are not read.
    """
    counts = mask_counts(docs, labels, id_col, text_col, part_col)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = interactions(FILTERS, {r["mask"]: tuple(r[w] for w in WEIGHTS) for r in rows})
        return pa.Table.from_pylist([{"part": rows[0]["part"]} | row for row in found], pa.schema(SCHEMA))

    text = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counts.groupBy("part").applyInArrow(run, text)


SCHEMA = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [
    (name, pa.int64()) for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
]
