"""Near copies by the Jaccard similarity of their shingle sets, exactly.

A document is the set of its shingles' 64-bit hashes.  Equal sets are one node.  Shingles have one order for all
documents; two sets of similarity p/q or more share one of the first n - ceil(n p/q) + 1 of each (prefix filtering), so
no such pair is missed, whatever the order.  The order puts shingles that a sample finds common last, which keeps a
common passage out of the prefixes.

The first links are those of ``simhash``: the Golay keys of the fingerprints propose which texts lie within two bits, and
those are compared as whole sets.  Near copies that differ by more bits are found by their shingles.  One shuffle of
(shingle, node) finds the shared shingles; all later steps read only those.  What a prefix holds and the
other set does not is missing for good, so a pair must share a certain number of prefix shingles (``needed``); pairs that
may are compared as whole sets.  In a few rounds the nodes of a shared shingle are paired with two of them alone,
which joins large groups of near copies.  Then every two nodes of different components meet, in blocks of bounded size,
in those shared shingles that no similar pair can do without, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recut.llm.common import components
from recut.llm.simhash import fingerprint, near_links
from recut.session import Scratch, cut_lineage

SHINGLE = 5
#: Least similarity, as numerator and denominator.
LEAST = (4, 5)
SEED = 42
#: Documents looked at for common shingles, how many of them make a shingle common, and how many shingles may be so.
#: They decide the order of shingles and with it the work, not the result.
SAMPLE, COMMON, MOST_COMMON = 20_000, 4, 100_000
#: Rows of one Arrow batch of sets.
ROWS = 256
#: Rounds of pairs with two nodes a shingle, at most; they decide the work that is left, not the result.
ROUNDS = 3
#: Nodes of one shingle that are paired with as many others by one task.
BLOCK = 1_000


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The sorted hashes of the shingles; a text of fewer words is one shingle, a blank one none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(first))
    return np.unique(hashes.view(np.int64))


def common_shingles(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """Sorted hashes of shingles that many different texts of a sample hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                sets = [shingle_set(t, size) for t in whole.column(0).slice(at, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["hash"])

    n = docs.count()
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    texts = texts.sample(min(1.0, SAMPLE / max(n, 1)), seed=SEED).dropDuplicates(["text"])
    found = texts.mapInArrow(run, "hash long").groupBy("hash").count().where(F.col("count") >= COMMON)
    found = found.orderBy(F.desc("count"), "hash").limit(MOST_COMMON).select("hash")
    return np.sort(np.array([r.hash for r in found.collect()], dtype=np.int64))


def copy_of(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("binary"), F.lit("").cast("binary")))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, least: tuple[int, int]) -> DataFrame:
    """(id, copy, fp, node, n, prefix): one row per row of ``docs``; ``copy`` is the digest of the text itself, ``fp`` its SimHash."""
    common = common_shingles(docs, text_col, size)
    p, q = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, prefixes, fps = [], [], [], []
            for text in batch.column(2).to_pylist():
                fps.append(fingerprint(text))
                s = shingle_set(text, size)
                at = np.searchsorted(common, s)
                late = np.zeros(len(s), dtype=bool)
                late[at < len(common)] = common[at[at < len(common)]] == s[at < len(common)]
                prefixes.append(np.concatenate((s[~late], s[late]))[: len(s) - -(-len(s) * p // q) + 1])
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                counts.append(len(s))
            nodes = np.array(nodes, dtype=np.uint64).view(np.int64)
            sets = [pa.array(nodes), pa.array(counts, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), *sets], ["id", "copy", "fp", "node", "n", "prefix"])

    text = F.col(text_col)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), copy_of(text).alias("copy"), text.cast("binary").alias("text"))
    return picked.mapInArrow(run, "id long, copy string, fp long, node long, n int, prefix array<long>")


def shared_shingles(signed: DataFrame) -> DataFrame:
    """(hash, node, n, place, weight): the prefix shingles that several nodes hold.

    Copies are one node before shingles are dealt.  ``place`` numbers the shared shingles of a node, those of most nodes
    first; ``weight`` is how often its shingles are held in all, highest for the middle of a group.
    """
    nodes = signed.select("node", "n", "prefix").dropDuplicates(["node"])
    keys = nodes.select(F.explode("prefix").alias("hash"), "node", "n")
    several = keys.withColumn("held", F.count("*").over(Window.partitionBy("hash"))).where("held > 1")
    own = Window.partitionBy("node")
    return several.select(
        "hash", "node", "n", F.row_number().over(own.orderBy(F.desc("held"), "hash")).alias("place"), F.sum("held").over(own).alias("weight")
    )


def near_fingerprints(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): nodes whose SimHash fingerprints are equal or linked by Golay keys, each with one node of the other fingerprint."""
    nodes = scratch.table(signed.select("fp", "node").distinct())
    firsts = scratch.table(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    links = near_links(firsts)
    same = nodes.join(firsts.hint("merge"), "fp").select(F.col("node").alias("x"), F.col("first").alias("y"))
    one, other = (firsts.select(F.col("fp").alias(s), F.col("first").alias(name)).hint("merge") for s, name in (("a", "x"), ("b", "y")))
    pairs = same.unionByName(links.join(one, "a").join(other, "b").select("x", "y")).where("x <> y")
    pairs = scratch.table(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    scratch.drop(nodes, firsts)
    return pairs


def needed(c: Column, least: tuple[int, int]) -> Column:
    """Whether c common prefix shingles can do for sets of n_a and n_b shingles.

    Similar sets share at least p (n_a + n_b) / (p + q) shingles.  The set whose prefix ends first in the order lacks
    for good each of its prefix shingles that the other prefix does not hold.
    """
    p, q = least
    beyond = F.greatest(*(F.ceil(F.col(n) * p / q) for n in ("n_a", "n_b")))
    sizes = F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p
    return sizes & ((c - 1 + beyond) * (p + q) >= (F.col("n_a") + F.col("n_b")) * p)


def with_two(rooted: DataFrame, turn: int, least: tuple[int, int]) -> DataFrame:
    """(a, b): each node of a shingle with the first and the last of them, if they share enough such shingles.

    First of all the heaviest comes first, the likely middle of a group; later the order differs by turn.
    """
    by_hash = Window.partitionBy("hash")
    rank = F.struct((F.lit(0) if turn else -F.col("weight")).alias("heavy"), F.xxhash64("node", F.lit(turn)).alias("at"), "node", "n", "root")
    both = F.array(F.min(rank).over(by_hash), F.max(rank).over(by_hash))
    rows = rooted.withColumn("both", both).select("node", "n", "root", F.explode("both").alias("end")).where("root <> end.root")
    first = F.col("node") < F.col("end.node")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    met = rows.select(pick("node", "end.node", "a"), pick("end.node", "node", "b"), pick("n", "end.n", "n_a"), pick("end.n", "n", "n_b"))
    return met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("c")).where(needed(F.col("c"), least)).select("a", "b")


def across(rooted: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b): every two nodes in different components that may be similar enough, none left out.

    Two nodes that share c shingles share one that stands at place c or later with both: the one of fewest nodes.  So
    they meet only where their places allow as many as they need, hardly ever in a shingle of many.
    """
    by_hash = Window.partitionBy("hash")
    mixed = rooted.withColumn("mixed", F.min("root").over(by_hash) < F.max("root").over(by_hash)).where("mixed")
    placed = mixed.withColumn("block", F.floor((F.row_number().over(by_hash.orderBy("node")) - 1) / BLOCK)).withColumn("last", F.max("block").over(by_hash))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("n", "place", "root")]
    one = placed.select("hash", F.explode(F.sequence("block", "last")).alias("j"), F.col("block").alias("i"), F.col("node").alias("a"), *side("a"))
    two = placed.select("hash", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), F.col("node").alias("b"), *side("b"))
    met = one.join(two, ["hash", "i", "j"]).where("a < b and root_a <> root_b").where(needed(F.least("place_a", "place_b"), least))
    return met.select("a", "b").distinct()


def alike(pairs: DataFrame, signed: DataFrame, docs: DataFrame, text_col: str, size: int, least: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Those pairs (a, b) of nodes whose whole sets are similar enough."""
    p, q = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                sets = pa.array([shingle_set(t, size) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "hashes"])

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = signed.select("node", "copy").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("copy").alias("copy"))
    # Copies are dropped before texts are moved; the wanted ones grow with the corpus, so it is a merge join at every size.
    texts = docs.select(copy_of(F.col(text_col)).alias("copy"), F.col(text_col).cast("binary").alias("text")).dropDuplicates(["copy"])
    texts = texts.join(wanted.hint("merge"), "copy").select("node", "text")
    sets = scratch.table(texts.mapInArrow(run, "node long, hashes array<long>"))
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"s_{x}")).hint("merge") for x in "ab")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    met = pairs.join(left, "a").join(right, "b").where(shared * (p + q) >= (F.size("s_a") + F.size("s_b")) * p)
    links = scratch.table(met.select("a", "b"))
    scratch.drop(sets)
    return links


def similar_sets(signed: DataFrame, docs: DataFrame, text_col: str, size: int, least: tuple[int, int], scratch: Scratch) -> DataFrame:
    """(node, root) of the nodes that are linked to another: first by fingerprints, then by the shingles they share."""
    proposed = near_fingerprints(signed, scratch)
    links = [alike(proposed, signed, docs, text_col, size, least, scratch)]
    scratch.drop(proposed)
    roots = components(links[0])
    shared = scratch.table(shared_shingles(signed))
    turn = 0
    while turn <= ROUNDS:
        rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = scratch.table(across(rooted, least) if turn == ROUNDS else with_two(rooted, turn, least))
        more = None if pairs.isEmpty() else alike(pairs, signed, docs, text_col, size, least, scratch)
        scratch.drop(pairs)
        if more is not None and not more.isEmpty():
            links.append(more)
            roots = components(reduce(DataFrame.unionByName, links))
            turn += 1
        else:
            turn = max(turn + 1, ROUNDS)  # no more links this way: all that are left, or the end
    return roots


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST
) -> DataFrame:
    """(id, copy, component): one row per row of ``docs``; the component is a node that all documents linked with it share.

    Blank and null texts have the empty set and are copies of each other.
    """
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.table(signatures(docs, id_col, text_col, shingle, least))
        roots = similar_sets(signed, docs, text_col, shingle, least, scratch)
        found = signed.select("id", "copy", "node").join(roots, "node", "left")
        return cut_lineage(found.select("id", "copy", F.coalesce("root", "node").alias("component")))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """The row with the smallest doc_id of each component, whole; rows without an id stay.

    Rows that repeat both id and text are one document; rows that repeat an id with another text are judged apart.
    """
    found = near_copies(docs, "doc_id", "text", shingle, least).where("id is not null")
    names = cut_lineage(found.groupBy("component").agg(F.min(F.struct("id", "copy")).alias("best")).select("best.*"))
    # The names grow with the corpus: a merge join, whatever they measure today.
    names = names.select(F.col("id").alias("doc_id"), F.col("copy").alias("copy_")).hint("merge")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), copy_of(F.col("text")).alias("copy_"))
    kept = keyed.join(names, ["doc_id", "copy_"], "left_semi")
    if found.groupBy("id", "copy").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "copy_"])
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))
