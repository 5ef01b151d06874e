"""Picture similarity: pooled vectors, block-wise exact top-k, inverted index, local feature checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from recut.operators.ordered import ORDINAL_SLICE, first_after, lag, last_before, scan, sum_before
from recut.operators.runs import top_k
from recut.session import cut_lineage, settled

# Byte pairs of a 32-byte descriptor hashed by each of the six tables, and their size.
HASH_BYTE_PAIRS = ((0, 7), (4, 25), (8, 15), (11, 18), (16, 27), (22, 29))
HASH_BUCKETS = 4096
# Fixed values of the nearest-neighbour vote and of the ratio test.
VOTE_NEIGHBOURS, VOTE_MAX_DISTANCE, VOTE_ZERO_DISTANCE = 6, 60, 68
RATIO = 0.75
# Fixed weights of the local verification score.
ENOUGH_INLIERS, ENOUGH_MATCHES = 35, 50
DISPLACEMENT_PX = 5
# Scores are compared at this many decimals, so equal pictures tie whatever the summation order.
SCORE_DECIMALS = 9
WORDS = ("w0", "w1", "w2", "w3")

VECTOR_BLOCK = 2_048
DESCRIPTOR_BLOCK = 1_024
# Shots of a block of weighted hashes, and how many of them are scored at once.
BAG_BLOCK, BAG_ROWS = 4_096, 512
POOL_CHUNK = 1_024
# Small source blocks meet a reference block together, up to so many bytes.
TILE_BYTES = 500_000
# How often at least a hash must meet, as a share of all pairs (1 in so many), to be multiplied as a matrix, and how many such hashes are at once.
DENSE_FROM, DENSE_AT_ONCE = 256, 1_024
# Reference shots whose other hashes are followed along their lists at once, and about how many meetings.
ROWS_AT_ONCE, MEETINGS_AT_ONCE = 32, 4_000_000
# Stands for a null hash in a block.
NO_HASH = -(2**63)

#: (row of the reference side, score, ids of the source side...)
Found = tuple[np.ndarray, ...]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def unit(vec: Column) -> Column:
    """L2-normalised vector; a vector of almost no length is left as it is."""

    def divided(norm: Column) -> Column:
        short = F.transform(vec, lambda x: x.cast("double"))
        return F.when(norm < 1e-8, short).otherwise(F.transform(vec, lambda x: x.cast("double") / norm))

    # As the variable of an outer array the norm is computed once, not once for every element.
    return F.transform(F.array(F.sqrt(dot(vec, vec))), divided)[0]


def _sum_vectors(vectors: Column) -> Column:
    zero = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    return F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))


def mean_pool(frames: DataFrame, keys: Sequence[str], pos: str, vec: str) -> DataFrame:
    """Normalised mean of the frame vectors of each shot.

    Frames are summed in chunks of bounded size first, so a shot with very many frames is spread over
    tasks and only one vector per chunk meets in the final step.
    """
    chunked = frames.groupBy(*keys, F.floor(F.col(pos) / POOL_CHUNK).alias("__chunk")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(vec).alias("v")))), lambda s: s.v
        ).alias("__vs")
    )
    partial = chunked.select(*keys, "__chunk", _sum_vectors(F.col("__vs")).alias("__sum"), F.size("__vs").alias("__n"))
    pooled = partial.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "__sum"))), lambda s: s["__sum"]).alias("__sums"),
        F.sum("__n").alias("__n"),
    )
    mean = F.transform(_sum_vectors(F.col("__sums")), lambda x: x / F.col("__n"))
    return pooled.withColumn("__mean", mean).select(*keys, unit(F.col("__mean")).alias("vec"))


def _blocks(df: DataFrame, keys: Sequence[str], unit_id: Column, size: int, out: str) -> DataFrame:
    """Spread the units of each key over blocks of about ``size``, by hash."""
    counts = df.groupBy(*keys).agg(F.count_distinct(unit_id).alias("__units"))
    blocks = F.greatest(F.ceil(F.col("__units") / size).cast("bigint"), F.lit(1))
    return df.join(F.broadcast(counts), list(keys)).withColumn(out, F.pmod(F.xxhash64(unit_id), blocks)).drop("__units")


def _packed(
    df: DataFrame, keys: Sequence[str], unit_id: str, size: int, out: str, arrange: Callable[[pa.Table], pa.Table] | None = None
) -> DataFrame:
    """(keys, out): one row for each block, its rows, arranged once, as an Arrow stream, written to the shared folder.

    The files are many enough for all cores to take part in what reads them.
    """
    columns = [c for c in df.columns if c not in keys]

    def pack(table: pa.Table) -> pa.Table:
        rows = table.select(columns) if arrange is None else arrange(table.select(columns))
        for at, c in enumerate(rows.column_names):
            if pa.types.is_string(rows.schema.field(c).type):
                rows = rows.set_column(at, c, rows[c].dictionary_encode())
        rows = rows.combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_table(rows)
        return table.slice(0, 1).select(keys).append_column(out, pa.array([sink.getvalue().to_pybytes()], pa.binary()))

    typed = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, T.BinaryType())])
    files = 4 * df.sparkSession.sparkContext.defaultParallelism
    dealt = _blocks(df, keys, F.col(unit_id), size, "__block").repartition(files, *keys, "__block")
    return cut_lineage(dealt.groupBy(*keys, "__block").applyInArrow(pack, typed))


def _best_of(held: Found | None, found: Found, k: int) -> Found:
    """The ``k`` best of each row: the larger score, then the larger ids; sorted by row and rank."""
    both = found if held is None else tuple(np.concatenate(x) for x in zip(held, found, strict=True))
    row, score, *ids = both
    order = np.lexsort((*(-x for x in reversed(ids)), -score, row))
    row = row[order]
    first = order[np.arange(len(row)) - np.searchsorted(row, row, side="left") < k]
    return tuple(x[first] for x in both)


def _least_to_beat(held: Found | None, rows: int, k: int) -> np.ndarray:
    """The score of the ``k``-th best of each row; minus infinity where there are fewer."""
    least = np.full(rows, -np.inf)
    if held is not None:
        row, score, *_ = held
        last = np.arange(len(row)) - np.searchsorted(row, row, side="left") == k - 1
        least[row[last]] = score[last]
    return least


def _promising(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a score matrix that may be among the ``k`` best once scores are rounded."""
    if scores.shape[1] > k and np.isneginf(least).any():
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    return np.nonzero(scores >= (least - 10.0**-SCORE_DECIMALS)[:, None])


def block_join(
    ref: DataFrame,
    movie: DataFrame,
    keys: Sequence[str],
    ref_unit: str,
    movie_unit: str,
    prepare: Callable[[list[pa.Table]], Any],
    kernel: Callable[[Any, Any, np.ndarray], Found],
    finish: Callable[[Any, Found], list[np.ndarray]],
    schema: str,
    k: int,
    *,
    size: int,
    arrange: Callable[[pa.Table], pa.Table] | None = None,
) -> DataFrame:
    """The ``k`` best of every (reference block, source block) of a key, by a scoring ``kernel``.

    Each side is written once, a row for each block.  The tasks of a Cartesian product read their blocks from there, so
    no row is copied through a shuffle; a task holds one reference block, the source blocks it meets, and the best so
    far, and forwards at most ``k`` rows for each row of a reference block.

    ``arrange`` orders the rows of a block before they are written; ``prepare`` reads the rows of blocks of either side into something that has a length; ``kernel`` returns (row of the
    reference side, score, ids of the source side...) of what reaches the scores to beat; ``finish`` the columns of ``schema``.
    """
    keys = list(keys)
    left = _packed(ref, keys, ref_unit, size, "__ref", arrange)
    right = _packed(movie, keys, movie_unit, size, "__movie", arrange)
    pairs = left.join(right.hint("shuffle_replicate_nl"), keys)
    fields = T._parse_datatype_string(schema).fields
    typed = T.StructType([ref.schema[c] for c in keys] + fields)
    key_types, names = [ref.schema[c].dataType for c in keys], typed.names

    def read(rows: list[bytes]) -> Any:
        return prepare([pa.ipc.open_stream(r).read_all() for r in rows])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, list[bytes]]]:
        """(key, reference block, source blocks): neighbouring pairs of one reference block, small blocks together."""
        key, ours, theirs, held = None, None, [], 0
        for batch in batches:
            for at, name in enumerate(zip(*(batch.column(c).to_pylist() for c in keys), strict=True)):
                a, b = batch.column("__ref")[at].as_py(), batch.column("__movie")[at].as_py()
                if theirs and (name != key or a != ours or held + len(b) > TILE_BYTES):
                    yield key, ours, theirs
                    theirs, held = [], 0
                key, ours, held = name, a, held + len(b)
                theirs.append(b)
        if theirs:
            yield key, ours, theirs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(key: tuple, ours: Any, best: Found) -> pa.RecordBatch:
            columns = [pa.array(c).cast(to_arrow_type(f.dataType)) for c, f in zip(finish(ours, best), fields, strict=True)]
            named = [pa.array([v] * len(best[0]), to_arrow_type(t)) for t, v in zip(key_types, key, strict=True)]
            return pa.RecordBatch.from_arrays([*named, *columns], names)

        key, block, ours, best = None, None, None, None
        for name, a, theirs in met(batches):
            if name != key or a != block:
                if best is not None:
                    yield rows_of(key, ours, best)
                key, block, ours, best = name, a, read([a]), None
            found = kernel(ours, read(theirs), _least_to_beat(best, len(ours), k))
            best = _best_of(best, found, k)
        if best is not None:
            yield rows_of(key, ours, best)

    return pairs.select(*keys, "__ref", "__movie").mapInArrow(run, typed)


@dataclass
class Vectors:
    """Rows of a block: their ids and their vectors as a matrix."""

    ids: np.ndarray
    matrix: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


def cosine_top_k(ref: DataFrame, movie: DataFrame, keys: Sequence[str], k: int, *, size: int = VECTOR_BLOCK) -> DataFrame:
    """Exact best ``k`` source shots per reference shot by dot product of unit vectors.

    Inputs: ref_no, vec and movie_no, vec.  Output: ref_no, movie_no, score, rank.
    """

    def prepare(blocks: list[pa.Table]) -> Vectors:
        rows = pa.concat_tables(blocks).combine_chunks()
        return Vectors(rows.column(0).to_numpy(), np.stack(rows.column(1).to_pandas().to_numpy()).astype(np.float64))

    def kernel(a: Vectors, b: Vectors, least: np.ndarray) -> Found:
        scores = a.matrix @ b.matrix.T
        r, c = _promising(scores, least, k)
        return r, np.round(scores[r, c], SCORE_DECIMALS), b.ids[c]

    best = block_join(
        ref.select(*keys, "ref_no", "vec"),
        movie.select(*keys, "movie_no", "vec"),
        keys,
        "ref_no",
        "movie_no",
        prepare,
        kernel,
        lambda a, best: [a.ids[best[0]], best[2], best[1]],
        "ref_no bigint, movie_no bigint, score double",
        max(1, k),
        size=size,
    )
    return top_k(best, [*keys, "ref_no"], "score", "movie_no", k)


def descriptor_byte(index: int) -> Column:
    """Byte ``index`` of a 32-byte descriptor held as four big-endian words."""
    word = F.col(WORDS[index // 8])
    return F.shiftrightunsigned(word, 56 - 8 * (index % 8)).bitwiseAND(F.lit(255).cast("bigint"))


def descriptor_hashes(local: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash counts per shot: each descriptor enters six tables, by one byte and four bits of another."""
    hashes = [
        descriptor_byte(left) * 16 + descriptor_byte(right).bitwiseAND(F.lit(15).cast("bigint")) + table * HASH_BUCKETS
        for table, (left, right) in enumerate(HASH_BYTE_PAIRS)
    ]
    return (
        local.select(*keys, "shot_no", F.explode(F.array(*hashes)).alias("hash"))
        .groupBy(*keys, "shot_no", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: A hash held by so many shots is looked up by a broadcast: at most one in so many of all (shot, hash) rows.
OFTEN = 10_000


def _looked_up(rows: DataFrame, idf: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join of the idf table onto rows, most of which hold a few hashes: only the others are shuffled."""
    often, seldom = F.col("df") >= OFTEN, F.col("df") < OFTEN
    near = rows.join(F.broadcast(idf.where(often).select(*on, *values, F.lit(True).alias("__often"))), list(on), "left")
    far = near.where("__often is null").select(*rows.columns).join(idf.where(seldom).select(*on, *values), list(on), "left")
    columns = [*rows.columns, *values]
    return near.where("__often").select(*columns).unionByName(far.select(*columns))


def inverse_frequencies(counts: DataFrame, shots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, hash, hash_no, df, idf) over the source shots of a key, written once; shots without features count too.

    ``hash_no`` is a number of the hash, any but its own.
    """
    totals = shots.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    frequency = counts.groupBy(*keys, "hash").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("__total") + 1.0) / (F.col("df") + 1.0)) + 1.0
    return cut_lineage(frequency.join(totals, list(keys)).select(*keys, "hash", F.monotonically_increasing_id().alias("hash_no"), "df", idf.alias("idf")))


def tfidf_weights(
    counts: DataFrame, idf: DataFrame, keys: Sequence[str], totals: DataFrame | None = None, also: Sequence[str] = ()
) -> DataFrame:
    """log1p(count) * idf, normalised per shot; ``also`` names columns of ``idf`` to keep.

    Queries may hold hashes the index never saw: with ``totals`` (key, __total) these get the idf of a
    hash found in no shot.
    """
    joined = _looked_up(counts, idf, [*keys, "hash"], ["idf", *also])
    if totals is not None:
        joined = joined.join(F.broadcast(totals), list(keys)).withColumn(
            "idf", F.coalesce("idf", F.log(F.col("__total") + 1.0) + 1.0)
        )
    weighted = joined.select(*keys, "shot_no", "hash", *also, (F.log1p("n") * F.col("idf")).alias("w"))
    # A window shuffles the rows once; sums joined back would shuffle them twice and look them up twice.
    squares = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys, "shot_no"))
    normed = weighted.withColumn("norm", F.sqrt(squares))
    scaled = F.when(F.col("norm") > 1e-6, F.col("w") / F.col("norm")).otherwise(F.col("w"))
    return normed.select(*keys, "shot_no", "hash", scaled.alias("weight"), *also)


def _along(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of lists one after the other, each from its start on."""
    ends = np.cumsum(lengths)
    return np.arange(lengths.sum()) + np.repeat(starts - (ends - lengths), lengths)


class Bags:
    """Weighted hashes of the shots of a block, in lists by hash: (row of the shot, weight)."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, hashes: np.ndarray, weight: np.ndarray):
        """Rows come sorted by hash."""
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
        self.ids, self.row, self.weight = ids, row, weight
        self.hashes, self.starts, self.lengths = hashes[first], first, np.diff(np.append(first, len(hashes)))

    def __len__(self) -> int:
        return len(self.ids)

    @staticmethod
    def arrange(rows: pa.Table) -> pa.Table:
        """(shot, hash, weight) sorted by hash, so that a block is read as it is, however many blocks it meets."""
        shot, hashes, weight = (rows.column(c).combine_chunks() for c in range(3))
        hashes = pc.fill_null(hashes.cast(pa.int64()), NO_HASH)
        order = np.argsort(hashes.to_numpy(), kind="stable")
        shots = pc.dictionary_encode(shot, null_encoding="encode")
        return pa.table([shots.take(order), hashes.take(order), weight.take(order)], names=rows.column_names)

    @staticmethod
    def read(blocks: list[pa.Table]) -> Bags:
        rows = pa.concat_tables(blocks).unify_dictionaries().combine_chunks()
        shots, hashes, weight = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
        ids, row = shots.dictionary.to_numpy(zero_copy_only=False), shots.indices.to_numpy()
        hashes, weight = hashes.to_numpy(), weight.to_numpy(zero_copy_only=False)
        if len(blocks) > 1:
            order = np.argsort(hashes, kind="stable")
            row, hashes, weight = row[order], hashes[order], weight[order]
        return Bags(ids, row, hashes, weight)

    @cached_property
    def by_row(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of the hash, weight), sorted by row."""
        order = np.argsort(self.row, kind="stable")
        return self.row[order].astype(np.int64), np.repeat(np.arange(len(self.hashes)), self.lengths)[order], self.weight[order]

    def products(self, other: Bags) -> Iterator[tuple[int, np.ndarray]]:
        """(first shot, scores of a piece of the shots with all of the other block).

        Hashes that many shots of both hold are multiplied as matrices, the others along their lists.
        """
        rows, cols = len(self), len(other)
        at = np.minimum(np.searchsorted(other.hashes, self.hashes), max(0, len(other.hashes) - 1))
        shared = other.hashes[at] == self.hashes if len(other.hashes) else np.zeros(len(self.hashes), bool)
        unweighed = np.isnan(other.weight)  # of a null hash: what meets there has no score
        if unweighed.any():
            plain = np.bincount(np.repeat(np.arange(len(other.hashes)), other.lengths)[unweighed], minlength=len(other.hashes)) == 0
        else:
            plain = np.ones(len(other.hashes), bool)
        theirs = np.zeros(len(self.hashes), np.int64)
        theirs[shared] = other.lengths[at[shared]]
        dense = self.lengths * theirs * DENSE_FROM > rows * cols
        dense[shared] &= plain[at[shared]]
        frequent = np.flatnonzero(dense)
        rights = [(few, other._matrix(at[few])) for few in np.split(frequent, range(DENSE_AT_ONCE, len(frequent), DENSE_AT_ONCE))]
        column = np.full(len(self.hashes), -1)
        column[frequent] = np.arange(len(frequent))

        row, place, weight = self.by_row
        for start in range(0, rows, BAG_ROWS):
            end = min(start + BAG_ROWS, rows)
            here = slice(*np.searchsorted(row, (start, end)))
            r, p, w = row[here] - start, place[here], weight[here]
            scores = np.zeros((end - start, cols))
            c = column[p]
            for n, (few, right) in enumerate(rights):
                mine = (c >= n * DENSE_AT_ONCE) & (c < n * DENSE_AT_ONCE + len(few))
                cell = r[mine] * len(few) + c[mine] - n * DENSE_AT_ONCE
                scores += np.bincount(cell, w[mine], (end - start) * len(few)).reshape(end - start, -1) @ right
            listed = shared[p] & (c < 0)
            other._add_lists(scores, r[listed], at[p[listed]], w[listed])
            if unweighed.any():
                scores[np.isnan(scores)] = 0.0
            yield start, scores

    def _matrix(self, places: np.ndarray) -> np.ndarray:
        """The lists of some hashes as rows of a matrix."""
        cols, lengths = len(self), self.lengths[places]
        along = _along(self.starts[places], lengths)
        cell = np.repeat(np.arange(len(places)) * cols, lengths) + self.row[along]
        return np.bincount(cell, self.weight[along], len(places) * cols).reshape(-1, cols)

    def _add_lists(self, scores: np.ndarray, row: np.ndarray, place: np.ndarray, weight: np.ndarray) -> None:
        """Add to the scores of rows, which come sorted, what they have in common with the lists at ``place``."""
        cols = len(self)
        starts, lengths = self.starts[place], self.lengths[place]
        met = np.append(0, np.cumsum(lengths))
        first = np.searchsorted(row, np.arange(len(scores) + 1))
        start = 0
        while start < len(scores):
            enough = np.searchsorted(met[first], met[first[start]] + MEETINGS_AT_ONCE)
            end = min(start + ROWS_AT_ONCE, len(scores), max(start + 1, enough))
            piece = slice(first[start], first[end])
            along = _along(starts[piece], lengths[piece])
            cell = np.repeat((row[piece] - start) * cols, lengths[piece]) + self.row[along]
            product = np.repeat(weight[piece], lengths[piece]) * self.weight[along]
            scores[start:end] += np.bincount(cell, product, (end - start) * cols).reshape(-1, cols)
            start = end


def _numbered(queries: DataFrame, index: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with numbers for hashes; only hashes the index holds can meet."""
    if isinstance(index.schema["hash"].dataType, T.IntegralType):
        return queries, index
    numbers = cut_lineage(index.select(*keys, "hash").distinct().withColumn("hash_no", F.monotonically_increasing_id()))

    def told(side: DataFrame) -> DataFrame:
        met = reduce(and_, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in [*keys, "hash"]])
        named = numbers.select(*[F.col(c).alias(f"__{c}") for c in [*keys, "hash"]], "hash_no")
        return side.join(named, met).select(*keys, "shot_no", F.col("hash_no").alias("hash"), "weight")

    return told(queries), told(index)


def tfidf_top_k(
    queries: DataFrame, index: DataFrame, keys: Sequence[str], k: int, *, size: int = BAG_BLOCK
) -> DataFrame:
    """Exact best ``k`` source shots per reference shot by shared weighted hashes.

    Blocks of shots meet with their sparse rows, so a hash found in every shot costs no list of pairs.  A task keeps
    the best so far and looks no closer at what cannot beat them.  Hashes are numbers, or are numbered first.
    Source shots sharing nothing are left out: they score zero.
    """

    # Blocks are counted first, so the weights would be computed twice.
    queries, index = map(settled, _numbered(queries.select(*keys, "shot_no", "hash", "weight"), index.select(*keys, "shot_no", "hash", "weight"), list(keys)))

    def kernel(a: Bags, b: Bags, least: np.ndarray) -> Found:
        pieces = []
        for start, scores in a.products(b):
            r, c = _promising(scores, least[start : start + len(scores)], k)
            score = np.round(scores[r, c], SCORE_DECIMALS)
            pieces.append((r[score > 0] + start, score[score > 0], b.ids[c[score > 0]]))
        return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))

    best = block_join(
        queries.select(*keys, F.col("shot_no").alias("ref_no"), "hash", "weight"),
        index.select(*keys, F.col("shot_no").alias("movie_no"), "hash", "weight"),
        keys,
        "ref_no",
        "movie_no",
        Bags.read,
        kernel,
        lambda a, best: [a.ids[best[0]], best[2], best[1]],
        "ref_no bigint, movie_no bigint, score double",
        max(1, k),
        size=size,
        arrange=Bags.arrange,
    )
    return top_k(best, [*keys, "ref_no"], "score", "movie_no", k)


def tfidf_pair_scores(pairs: DataFrame, queries: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index score of given (ref_no, movie_no) pairs only; zero where nothing is shared."""
    keys = list(keys)
    wanted = pairs.select(*keys, "ref_no", "movie_no").distinct()
    q = queries.select(*keys, F.col("shot_no").alias("ref_no"), "hash", F.col("weight").alias("__q"))
    m = index.select(*keys, F.col("shot_no").alias("movie_no"), "hash", F.col("weight").alias("__m"))
    shared = (
        wanted.join(q, [*keys, "ref_no"])
        .join(m, [*keys, "movie_no", "hash"])
        .groupBy(*keys, "ref_no", "movie_no")
        .agg(F.sum(F.col("__q") * F.col("__m")).alias("local_raw"))
    )
    return wanted.join(shared, [*keys, "ref_no", "movie_no"], "left").fillna(0.0, ["local_raw"])


def pad_with_latest(best: DataFrame, refs: DataFrame, movies: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Fill short candidate lists with zero-score source shots, the largest index first."""
    keys = list(keys)
    latest = Window.partitionBy(*keys).orderBy(F.col("movie_no").desc())
    spare = (
        movies.select(*keys, "movie_no").withColumn("__r", F.row_number().over(latest)).where(F.col("__r") <= 2 * k).drop("__r")
    )
    found = best.groupBy(*keys, "ref_no").agg(F.count(F.lit(1)).alias("__found"))
    short = (
        refs.select(*keys, "ref_no")
        .join(found, [*keys, "ref_no"], "left")
        .fillna(0, ["__found"])
        .where(F.col("__found") < k)
    )
    fill = short.join(spare, keys).join(best.select(*keys, "ref_no", "movie_no"), [*keys, "ref_no", "movie_no"], "left_anti")
    order = Window.partitionBy(*keys, "ref_no").orderBy(F.col("movie_no").desc())
    fill = fill.withColumn("rank", (F.row_number().over(order) + F.col("__found")).cast("bigint")).where(F.col("rank") <= k)
    return best.select(*keys, "ref_no", "movie_no", "score", "rank").unionByName(
        fill.select(*keys, "ref_no", "movie_no", F.lit(0.0).alias("score"), "rank")
    )


@dataclass
class Descriptors:
    """Rows of a block: their owners, their numbers and their four words."""

    shot: np.ndarray
    desc: np.ndarray
    words: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.shot)


def ann_votes(
    ref: DataFrame, movie: DataFrame, keys: Sequence[str], *, size: int = DESCRIPTOR_BLOCK
) -> DataFrame:
    """Votes of a reference shot's descriptors for the owners of their nearest source descriptors.

    Exact six nearest by bit distance; neighbours beyond the distance limit do not vote, an owner gets
    one vote per descriptor, its nearest.  Inputs: shot_no, desc_no, w0..w3.
    """
    keys = list(keys)
    spread = F.xxhash64(*[F.col(k) for k in keys], F.col("shot_no"), F.col("desc_no"))

    def prepare(blocks: list[pa.Table]) -> Descriptors:
        frames = [b.to_pandas() for b in blocks]
        words = np.concatenate([f[list(WORDS)].to_numpy(dtype=np.int64) for f in frames]).view(np.uint64)
        shot, desc = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("shot_no", "desc_no"))
        return Descriptors(shot, desc, list(words.T.copy()))

    def kernel(a: Descriptors, b: Descriptors, least: np.ndarray) -> Found:
        distance = np.zeros((len(a), len(b)), dtype=np.int16)
        for x, y in zip(a.words, b.words, strict=True):
            distance += np.bitwise_count(x[:, None] ^ y[None, :])
        # A neighbour beyond the limit has no vote, whatever its rank.
        r, c = np.nonzero(distance <= np.minimum(-least, VOTE_MAX_DISTANCE).astype(np.int16)[:, None])
        return r, -distance[r, c].astype(np.float64), -b.shot[c], -b.desc[c]

    columns = [*keys, "shot_no", "desc_no", *WORDS]
    near = block_join(
        ref.select(*columns).withColumn("__u", spread),
        movie.select(*columns).withColumn("__u", spread),
        keys,
        "__u",
        "__u",
        prepare,
        kernel,
        lambda a, best: [a.shot[best[0]], a.desc[best[0]], -best[2], -best[3], -best[1].astype(np.int64)],
        "ref_no bigint, desc_no bigint, movie_no bigint, near_no bigint, distance bigint",
        VOTE_NEIGHBOURS,
        size=size,
    )
    nearest = Window.partitionBy(*keys, "ref_no", "desc_no").orderBy("distance", "movie_no", "near_no")
    return (
        near.withColumn("__r", F.row_number().over(nearest))
        .where((F.col("__r") <= VOTE_NEIGHBOURS) & (F.col("distance") <= VOTE_MAX_DISTANCE))
        .groupBy(*keys, "ref_no", "desc_no", "movie_no")
        .agg(F.min("distance").alias("distance"))
        .groupBy(*keys, "ref_no", "movie_no")
        .agg(F.sum((VOTE_ZERO_DISTANCE - F.col("distance")) / float(VOTE_ZERO_DISTANCE)).alias("votes"))
    )


def pack_frames(local: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """One row per frame with all its descriptors; with a ``limit``, evenly subsampled to at most so many."""
    from recut.operators.runs import even_subsample

    kept = local if limit is None else even_subsample(local, [*keys, "shot_no", "frame_pos"], ["kp_no"], limit)
    return kept.groupBy(*keys, "shot_no", "frame_pos").agg(
        F.array_sort(F.collect_list(F.struct("kp_no", "x", "y", *WORDS))).alias("descs")
    )


def _hamming(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[w].bitwiseXOR(b[w])) for w in WORDS), F.lit(0))


def ratio_test_matches(pairs: DataFrame, ref_frames: DataFrame, movie_frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Descriptor matches of every frame pair of the given shot pairs, by the two-nearest ratio test.

    Frames are bounded arrays, so the search is an array expression inside the row: nothing is
    exploded or shuffled per descriptor pair.
    """
    keys = list(keys)
    left = ref_frames.select(*keys, F.col("shot_no").alias("ref_no"), F.col("frame_pos").alias("ref_frame"), F.col("descs").alias("__a"))
    right = movie_frames.select(*keys, F.col("shot_no").alias("movie_no"), F.col("frame_pos").alias("movie_frame"), F.col("descs").alias("__b"))
    joined = pairs.select(*keys, "ref_no", "movie_no").distinct().join(left, [*keys, "ref_no"]).join(right, [*keys, "movie_no"])

    none = F.lit(None).cast("int")
    place = F.lit(None).cast("bigint")
    unseen = F.struct(none.alias("d1"), none.alias("d2"), place.alias("x"), place.alias("y"))

    def nearest(a: Column) -> Column:
        """One pass over the other frame that carries the two smallest distances and the place of the first."""
        measured = F.transform(
            F.col("__b"), lambda b: F.struct(_hamming(a, b).cast("int").alias("d"), b["x"].cast("bigint").alias("x"), b["y"].cast("bigint").alias("y"))
        )

        def step(best: Column, b: Column) -> Column:
            closer = F.struct(b["d"].alias("d1"), best["d1"].alias("d2"), b["x"].alias("x"), b["y"].alias("y"))
            second = F.struct(best["d1"].alias("d1"), b["d"].alias("d2"), best["x"].alias("x"), best["y"].alias("y"))
            return (
                F.when(best["d1"].isNull() | (b["d"] < best["d1"]), closer)
                .when(best["d2"].isNull() | (b["d"] < best["d2"]), second)
                .otherwise(best)
            )

        shift = lambda best: F.struct(
            (best["x"] - a["x"]).alias("dx"), (best["y"] - a["y"]).alias("dy"), best["d1"].alias("d1"), best["d2"].alias("d2")
        )
        return F.aggregate(measured, unseen, step, shift)

    matches = F.filter(F.transform("__a", nearest), lambda m: m["d1"] < RATIO * m["d2"])
    return joined.select(*keys, "ref_no", "movie_no", "ref_frame", "movie_frame", matches.alias("matches"))


def geometry_consensus(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best frame pair of each shot pair by agreeing displacement, then by matches; with its score."""
    keys = list(keys)
    pair = [*keys, "ref_no", "movie_no"]
    frame = [*pair, "ref_frame", "movie_frame"]
    bucket = lambda c: F.floor(F.col("m")[c] / DISPLACEMENT_PX)
    votes = (
        matches.where(F.size("matches") > 0)
        .select(*frame, F.size("matches").alias("good"), F.explode("matches").alias("m"))
        .groupBy(*frame, "good", bucket("dx").alias("bx"), bucket("dy").alias("by"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .groupBy(*frame, "good")
        .agg(F.max("votes").alias("agree"))
    )
    inliers = F.when(F.col("good") >= 4, F.col("agree")).otherwise(F.lit(0)).cast("bigint")
    best = votes.groupBy(*pair).agg(F.max(F.struct(inliers.alias("i"), F.col("good").cast("bigint").alias("g"))).alias("b"))
    scored = matches.select(*pair).distinct().join(best, pair, "left").select(
        *pair,
        F.coalesce(F.col("b.i"), F.lit(0)).cast("bigint").alias("inliers"),
        F.coalesce(F.col("b.g"), F.lit(0)).cast("bigint").alias("good_matches"),
    )
    score = 0.75 * F.least(F.col("inliers") / ENOUGH_INLIERS, F.lit(1.0)) + 0.25 * F.least(
        F.col("good_matches") / ENOUGH_MATCHES, F.lit(1.0)
    )
    return scored.withColumn("geometry", score)


def pack_vectors(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frame vectors of a shot as one array, in frame order; a shot keeps a small sample of frames."""
    return frames.groupBy(*keys, "shot_no").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("frame_pos", "vec"))), lambda s: s.vec
        ).alias("frames")
    )


def duration_ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b)


def fine_score(clip: Column, a: Column, b: Column, durations: Column) -> Column:
    """Pooled similarity, mean of best frame matches in both directions, and duration agreement."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    add = lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["n"] + 1).alias("n"))
    mean = lambda xs: F.aggregate(xs, start, add, lambda s: s["sum"] / s["n"])
    rows = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y))))
    cols = F.transform(b, lambda y: F.array_max(F.transform(a, lambda x: dot(x, y))))
    return 0.45 * clip + 0.45 * ((mean(rows) + mean(cols)) / 2.0) + 0.10 * durations


def expand_candidates(
    local: DataFrame, global_: DataFrame, refs: DataFrame, keys: Sequence[str], radius: int, *, own_local: int, own_global: int = 15, borrowed: int = 5
) -> DataFrame:
    """Candidate pairs: a reference shot's own best, and the few best of its neighbours."""
    keys = list(keys)
    own = local.where(F.col("rank") <= own_local).select(*keys, "ref_no", "movie_no").unionByName(
        global_.where(F.col("rank") <= own_global).select(*keys, "ref_no", "movie_no")
    )
    lent = (
        local.where(F.col("rank") <= borrowed)
        .select(*keys, "ref_no", "movie_no")
        .unionByName(global_.where(F.col("rank") <= borrowed).select(*keys, "ref_no", "movie_no"))
        .withColumn("ref_no", F.explode(F.sequence(F.col("ref_no") - radius, F.col("ref_no") + radius)))
        .join(refs.select(*keys, "ref_no"), [*keys, "ref_no"], "left_semi")
    )
    return own.unionByName(lent).distinct()


def sequence_support(preliminary: DataFrame, refs: DataFrame, movies: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """Support a confident neighbour lends to source shots around its own match."""
    keys = list(keys)
    offsets = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    lent = (
        preliminary.where(F.col("inliers") >= 10)
        .select(*keys, F.col("ref_no").alias("__near"), F.col("movie_no").alias("__centre"))
        .withColumn("__step", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
        .where(F.col("__step") != 0)
        .withColumn("ref_no", F.col("__near") + F.col("__step"))
        .withColumn("__offset", offsets)
        .withColumn("movie_no", F.col("__centre") + F.col("__offset"))
        .withColumn("__bonus", (0.18 / F.abs("__step")) * (1.0 - 0.2 * F.abs("__offset")))
    )
    return (
        lent.groupBy(*keys, "ref_no", "movie_no")
        .agg(F.sum("__bonus").alias("support"))
        .join(refs.select(*keys, "ref_no"), [*keys, "ref_no"], "left_semi")
        .join(movies.select(*keys, "movie_no"), [*keys, "movie_no"], "left_semi")
    )


def banded_nearest_frame(
    ref: DataFrame, clip: DataFrame, keys: Sequence[str], difference: Callable[[Column, Column], Column], *, radius: int, threshold: float | None = None, value: str = "score"
) -> DataFrame:
    """Per reference frame the least different clip frame within ``radius``, the band clipped to the clip.

    Ties prefer the same frame, then one ahead, one behind, and so on.  With a threshold, frames
    without any match below it keep their own number and are flagged as fallback.
    """
    keys = list(keys)
    banded = ref.select(*keys, "frame_no", F.col(value).alias("__a")).withColumn(
        "clip_frame", F.explode(F.sequence(F.col("frame_no") - radius, F.col("frame_no") + radius))
    )
    other = clip.select(*keys, F.col("frame_no").alias("clip_frame"), F.col(value).alias("__b"))
    shift = F.col("clip_frame") - F.col("frame_no")
    tie = F.when(shift > 0, 2 * shift - 1).otherwise(-2 * shift)
    best = (
        banded.join(other, [*keys, "clip_frame"])
        .withColumn("__d", difference(F.col("__a"), F.col("__b")))
        .groupBy(*keys, "frame_no")
        .agg(F.min(F.struct(F.col("__d").alias("d"), tie.alias("t"), F.col("clip_frame").alias("c"))).alias("b"))
    )
    matched = ref.select(*keys, "frame_no").join(best, [*keys, "frame_no"], "left")
    fails = F.col("b").isNull() if threshold is None else F.col("b").isNull() | (F.col("b.d") >= threshold)
    return matched.select(
        *keys,
        "frame_no",
        F.when(fails, F.col("frame_no")).otherwise(F.col("b.c")).alias("clip_frame"),
        fails.alias("is_fallback"),
    )


def fps_resample_map(frames: DataFrame, keys: Sequence[str], *, clip_rate: tuple[int, int], ref_rate: tuple[int, int], frame: str = "frame_idx") -> DataFrame:
    """Clip frame to reference frame across frame rates, with the repeats and the frames to delete again."""
    (cn, cd), (rn, rd) = clip_rate, ref_rate
    mapped = frames.select(*keys, F.col(frame), F.floor(F.col(frame) * (cd * rn) / F.lit(cn * rd)).cast("bigint").alias("ref_frame"))
    seen = scan(mapped, keys, [frame], [lag("__prev", "ref_frame")], width=ORDINAL_SLICE)
    flagged = seen.withColumn("duplicate", F.coalesce(F.col("ref_frame") == F.col("__prev"), F.lit(False)))
    counted = scan(flagged, keys, [frame], [sum_before("__before", F.col("duplicate").cast("bigint"))], width=ORDINAL_SLICE)
    return counted.withColumn(
        "deletion", F.when(F.col("duplicate"), F.col("ref_frame") + F.col("__before") + 1)
    ).drop("__prev", "__before")


def hash_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0)


def histogram_similarity(a: Column, b: Column) -> Column:
    """Correlation of two histograms mapped to [0, 1]."""
    n = F.size(a).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v.cast("double"))
    cov = dot(a, b) - total(a) * total(b) / n
    var = (dot(a, a) - total(a) * total(a) / n) * (dot(b, b) - total(b) * total(b) / n)
    corr = F.when(var > 0, cov / F.sqrt(var)).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (corr + 1.0) / 2.0))


def shot_pair_scores(pairs: DataFrame, ref: DataFrame, movie: DataFrame, keys: Sequence[str], *, local: str | None = None) -> DataFrame:
    """Shot similarity from the scores of all pairs of their key frames.

    Frames carry dhash and hist; with ``local`` a per-frame-pair local score column of ``pairs`` joins in.
    Scores have four decimals at every step, so they are whole numbers of ten-thousandths.
    """
    keys = list(keys)
    left = ref.select(*keys, F.col("shot_no").alias("ref_no"), F.col("frame_pos").alias("ref_frame"), F.col("dhash").alias("__ha"), F.col("hist").alias("__a"))
    right = movie.select(*keys, F.col("shot_no").alias("movie_no"), F.col("frame_pos").alias("movie_frame"), F.col("dhash").alias("__hb"), F.col("hist").alias("__b"))
    differing = F.bit_count(F.col("__ha").bitwiseXOR(F.col("__hb"))).cast("bigint")
    hashed = F.floor(((64 - differing) * 10_000 + 32) / 64)
    histogram = F.floor(histogram_similarity(F.col("__a"), F.col("__b")) * 10_000 + 0.5)
    if local is None:
        score = F.floor((hashed * 55 + histogram * 45 + 50) / 100)
    else:
        score = F.floor((hashed * 45 + histogram * 35 + F.floor(F.col(local) * 10_000 + 0.5) * 20 + 50) / 100)
    compared = (
        pairs.join(left, [*keys, "ref_no"] + (["ref_frame"] if "ref_frame" in pairs.columns else []))
        .join(right, [*keys, "movie_no"] + (["movie_frame"] if "movie_frame" in pairs.columns else []))
        .select(*keys, "ref_no", "movie_no", "ref_frame", "movie_frame", score.cast("bigint").alias("s"))
    )
    best = Window.partitionBy(*keys, "ref_no", "movie_no").orderBy(F.col("s").desc(), "ref_frame", "movie_frame")
    ranked = compared.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 3)
    n, top, total = F.count(F.lit(1)), F.max("s"), F.sum("s")
    return ranked.groupBy(*keys, "ref_no", "movie_no").agg(
        F.floor((top * 6 * n + total * 4 + n * 5) / (n * 10)).cast("bigint").alias("score_e4"),
        F.min_by("ref_frame", "r").alias("best_ref_frame"),
        F.min_by("movie_frame", "r").alias("best_movie_frame"),
    )


def nearest_clip_fill(items: DataFrame, keys: Sequence[str], order: Sequence[str], clip: str, *, width: float = ORDINAL_SLICE) -> DataFrame:
    """Items without a clip borrow the first clip of the next item that has one, else of the previous."""
    near = scan(items, keys, order, [first_after("__next", clip), last_before("__prev", clip)], width=width)
    return near.withColumn("filled", F.coalesce(F.col(clip), F.col("__next"), F.col("__prev"))).drop("__next", "__prev")
