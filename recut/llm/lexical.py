"""Ranked lexical search: texts are scanned by an automaton of all terms of the items; there is no index of documents.

The terms of the items, each between two guards, form an Aho-Corasick automaton.  In a text all that is not a term
becomes guards, so a guarded term is found exactly where it stands as a whole term.  A first scan counts documents,
terms, and for each item term the documents that hold it.  A second scan counts occurrences again, maps the outputs to
the items that hold the term, scores each document, and keeps the best of each item per task; the best of all tasks are
ranked.  Items whose terms would make the automaton larger than a stated bound are dealt to several, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recut.session import cut_lineage

#: Results of an item; (item, term) pairs that one automaton takes, about.
BEST, POSTINGS = 10, 200_000
#: Texts scored at once, in (text, item) cells.
CELLS = 2_000_000
GUARD = 0x20
#: Bytes as terms see them: digits, lower-case letters and all beyond ASCII stay, A-Z go to a-z, others are guards.
FOLDED = bytes(
    b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else GUARD for b in range(256)
)


def folded(text: bytes) -> bytes:
    return b" " + text.translate(FOLDED) + b" "


def term_count(line: bytes) -> int:
    """Terms of a folded text: places where one begins."""
    inside = np.frombuffer(line, dtype=np.uint8) != GUARD
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


@dataclass(frozen=True)
class Items:
    """The terms of one block of items: ``holders[bounds[t]:bounds[t + 1]]`` are the items that hold ``terms[t]``."""

    terms: list[bytes]
    bounds: np.ndarray
    holders: np.ndarray
    count: int

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for at, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", at)  # one character a byte, so places and lengths are those of UTF-8
        found.make_automaton()
        return found

    def counts(self, line: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(term, occurrences) in a folded text, terms ascending."""
        if not self.terms:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hits = np.fromiter((at for _, at in self.automaton.iter(line.decode("latin-1"))), dtype=np.int64)
        return np.unique(hits, return_counts=True)


def item_blocks(items: DataFrame, id_col: str, text_col: str, postings: int) -> tuple[DataFrame, int]:
    """(block, item, term) without repeats, and the number of blocks; an item is in one block whole."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)))
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.explode(terms).alias("term")).distinct()
    rows = cut_lineage(rows)
    blocks = max(1, -(-rows.count() // postings))
    return rows.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item", "term"), blocks


def loaded(rows: DataFrame) -> tuple[Items, list[str | None]]:
    """One block on the driver, which it fits by its size, and the names of its items."""
    pairs = rows.select("item", F.encode("term", "UTF-8").alias("term")).toArrow()
    names, item = np.unique([x or "" for x in pairs["item"].to_pylist()], return_inverse=True) if len(pairs) else (np.empty(0, str), np.empty(0, np.int64))
    terms, term = np.unique(np.array(pairs["term"].to_pylist(), dtype=object), return_inverse=True) if len(pairs) else (np.empty(0, object), np.empty(0, np.int64))
    order = np.lexsort((item, term))
    bounds = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms)))))
    return Items([bytes(t) for t in terms], bounds.astype(np.int64), item[order].astype(np.int64), len(names)), names.tolist()


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")


def corpus_counts(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each item term the documents that hold it.

    Each task gives its own sums: two rows and one for each item term it has seen.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        holding = np.zeros(len(items.terms) + 2, dtype=np.int64)
        for batch in batches:
            for value in batch.column(1):
                line = folded(value.as_buffer().to_pybytes())
                if n := term_count(line):
                    holding[items.counts(line)[0]] += 1
                    holding[-2:] += (1, n)
        seen = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(holding[seen])], ["term", "n"])

    sums = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = np.zeros(len(items.terms) + 2, dtype=np.int64)
    for row in sums.collect():  # at most one row for each term of the block
        found[row.term] = row.n
    return int(found[-2]), int(found[-1]), found[:-2]


def best_rows(item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each item: highest score, then smallest id, rows without an id last."""
    order = np.lexsort((doc, ~known, -score, item))
    item = item[order]
    return order[np.arange(len(order)) - np.searchsorted(item, item) < k]


def scored(docs: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): of each task the k best documents for each item, by place of the item in the block."""
    shared = docs.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        sizes = np.diff(items.bounds)
        at_once = max(1, CELLS // max(1, items.count))
        top = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]  # item, score, id, known

        def take(rows: list[tuple]) -> None:
            nonlocal top
            ids, known = np.array([r[0] or 0 for r in rows], dtype=np.int64), np.array([r[0] is not None for r in rows])
            cells = np.zeros(len(rows) * items.count, dtype=np.int64)
            doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
            term, gain = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
            # One add for each (document, term, item that holds the term).
            for some in np.array_split(np.arange(len(term)), max(1, int(sizes[term].sum()) // CELLS)):
                counts = sizes[term[some]]
                place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                holder = items.holders[np.repeat(items.bounds[term[some]], counts) + place]
                np.add.at(cells, np.repeat(doc[some], counts) * items.count + holder, np.repeat(gain[some], counts))
            cells = cells.reshape(len(rows), items.count)
            least = np.zeros(items.count, dtype=np.int64)
            last = np.bincount(top[0], minlength=items.count) == k
            np.minimum.at(lowest := np.full(items.count, np.iinfo(np.int64).max), top[0], top[1])
            least[last] = lowest[last]
            row, item = np.nonzero((cells > 0) & (cells >= least))
            new = [item, cells[row, item], ids[row], known[row]]
            merged = [np.concatenate(pair) for pair in zip(top, new, strict=True)]
            keep = best_rows(*merged, k)
            top = [x[keep] for x in merged]

        rows: list[tuple] = []
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                line = folded(value.as_buffer().to_pybytes())
                term, tf = items.counts(line)
                if len(term):
                    m = 100 - 90 + (90 * term_count(line) * n_docs) // n_terms
                    rows.append((key, term, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))))
                if len(rows) == at_once:
                    take(rows)
                    rows = []
        if rows:
            take(rows)
        ids = pa.array(top[2], mask=~top[3])
        yield pa.RecordBatch.from_arrays([pa.array(top[0]), ids, pa.array(top[1])], ["item", "id", "score"])

    return docs.mapInArrow(run, "item long, id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", postings: int = POSTINGS
) -> DataFrame:
    """(item, rank, id, score): the k documents of highest score above 0 for each item; ``item`` is its id as text.

    Every row of ``docs`` is a document, repeated ones too; a row without an id ranks after its equals.  Null and empty
    texts hold no term.  Rows of ``items`` that share an id are one item with the terms of all; the null id is the
    item with an empty name.  An item without terms, or with none that a document holds, has no rows; empty tables give
    none.  Equal scores rank by smaller id.  Other columns are not read.
    """
    texts = texts_of(docs, id_col, text_col)
    pairs, blocks = item_blocks(items, item_col, item_text, postings)
    out = []
    for block in range(blocks):
        terms, names = loaded(pairs.where(F.col("block") == block))
        n_docs, n_terms, df = corpus_counts(texts, terms)
        weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        found = scored(texts, terms, weights, n_docs, max(1, n_terms), k)
        labels = docs.sparkSession.createDataFrame(list(enumerate(names)), "item long, name string")
        out.append(cut_lineage(found).join(labels, "item").select(F.col("name").alias("item"), "id", "score"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "id", "score")
