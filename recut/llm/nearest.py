"""Approximate nearest neighbours by largest inner product: one robustly pruned graph for each shard of vectors.

Equal vectors are one node, which carries the smallest of their ids: as many as a result can show.  Nodes are dealt by
hash to shards of about SHARD, each built by one task and written.  Queries are dealt to blocks of about QUERIES, and
every block runs a beam search in every shard; the products of what the beam holds are then taken on the original
vectors, and the best of all shards are ranked.  Every row is in the index.  A shard no larger than the beam is
searched whole, so its results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recut.llm import vamana
from recut.session import cut_lineage

#: Nodes of a shard and queries of a block, about; neighbours asked for; width of the beam.
SHARD, QUERIES, NEIGHBOURS, BEAM = 8_192, 8_192, 20, 96
#: Parts in which the ids of one vector are first ranked.
SALTS = 16
#: Queries searched at once.
AT_ONCE = 512


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, vec) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("id is not null and size(vec) > 0").where(~odd & F.exists("vec", lambda x: x != 0))
    return rows.select("id", F.size("vec").alias("dim"), "vec")


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(dim, vec, ids): each vector with its ``ids`` smallest ids.  Ids of one vector are first ranked in salted parts."""
    salted = Window.partitionBy("vec", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    first = rows.distinct().withColumn("place", F.row_number().over(salted)).where(F.col("place") <= ids)
    listed = F.slice(F.sort_array(F.collect_list("id")), 1, ids)
    return first.groupBy("dim", "vec").agg(listed.alias("ids"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.chunked_array([c.flatten() for c in column.chunks], column.type.value_type)
    return flat.to_numpy().reshape(-1, dim)


def build_graphs(nodes: DataFrame, shards: int) -> DataFrame:
    """The index: one row a node with its shard, its place there, its out-edges as places, and the shard's start."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors = matrix(table["vec"], key[0].as_py())
        order = np.lexsort(vectors.T)  # whatever order the rows come in, the graph is the same
        table, vectors = table.take(pa.array(order)), vectors[order]
        graph = vamana.build(vectors)
        edges = graph.edges[: graph.size]
        sizes = np.concatenate(([0], np.cumsum((edges < graph.size).sum(axis=1)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(edges[edges < graph.size]))
        return pa.table({
            "dim": table["dim"], "shard": table["shard"], "place": pa.array(np.arange(graph.size, dtype=np.int32)),
            "start": pa.array(np.full(graph.size, graph.start, dtype=np.int32)), "vec": table["vec"], "ids": table["ids"], "edges": lists,
        })

    dealt = nodes.select("dim", F.pmod(F.xxhash64("vec"), F.lit(shards)).alias("shard"), "vec", "ids")
    schema = "dim int, shard long, place int, start int, vec array<double>, ids array<long>, edges array<int>"
    return dealt.groupBy("dim", "shard").applyInArrow(run, schema)


def loaded(table: pa.Table, vectors: np.ndarray) -> vamana.Graph:
    """The graph of one shard's rows, in the order of their places."""
    lists = table["edges"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    edges = np.full((len(table) + 1, vamana.ROOM), len(table), dtype=np.int32)
    rows = np.repeat(np.arange(len(table)), counts)
    edges[rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)] = lists.flatten().to_numpy()
    return vamana.Graph(vamana.unit_vectors(vectors), edges, table["start"][0].as_py())


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products over the last axis in double precision, component after component."""
    total = np.zeros(np.broadcast_shapes(left.shape, right.shape)[:-1])
    for i in range(left.shape[-1]):
        total += left[..., i] * right[..., i]
    return total


def directions(queries: np.ndarray) -> np.ndarray:
    """float32 unit vectors, zero in the component that only indexed vectors have."""
    wide = queries / np.abs(queries).max(axis=1, keepdims=True)
    wide /= np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return np.column_stack([wide, np.zeros(len(wide))]).astype(np.float32)


def search(graphs: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int, beam: int) -> DataFrame:
    """(query, id, score): the k best of each shard for each query."""

    def run(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        found = {"query": [], "id": [], "score": []}
        if len(table) and len(asked):
            dim = key[0].as_py()
            table = table.sort_by("place")
            vectors, wanted = matrix(table["vec"], dim), matrix(asked["vec"], dim)
            graph, names = loaded(table, vectors), asked["id"].to_numpy()
            lists = table["ids"].combine_chunks()
            first, members = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            for at in range(0, len(wanted), AT_ONCE):
                some, name = wanted[at : at + AT_ONCE], names[at : at + AT_ONCE]
                nodes = vamana.beam_search(graph, directions(some), max(beam, k + 1))[0]
                row, col = np.nonzero(nodes < graph.size)
                node = nodes[row, col]
                score = products(some[row], vectors[node])
                counts = first[node + 1] - first[node]
                row, score = np.repeat(row, counts), np.repeat(score, counts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                ids = members[np.repeat(first[node], counts) + place]
                other = ids != name[row]
                row, score, ids = row[other], score[other], ids[other]
                order = np.lexsort((ids, -score, row))
                row, score, ids = row[order], score[order], ids[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                for column, values in (("query", name[row]), ("id", ids), ("score", score)):
                    found[column].append(values[top])
        types = {"query": np.int64, "id": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate([np.empty(0, types[c]), *found[c]]) for c in types})

    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1).cast("long"))
    index = graphs.withColumn("block", F.explode(every(blocks)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("shard", F.explode(every(shards)))
    keys = ("dim", "shard", "block")
    return index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query long, id long, score double")


def nearest(
    df: DataFrame, asks: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, beam: int = BEAM
) -> DataFrame:
    """(query, rank, id, score): for each row where ``asks`` is true its k nearest other ids found, nearest first.

    Nearness is the inner product in double precision; ties go to the smaller id; a query with fewer candidates gets
    them all.  Rows with a null id, or a vector that is null, empty, zero or holds null or non-finite components take no
    part.  Vectors meet only those of as many components.  Repeated rows count once; an id with several vectors asks
    with each and answers with the best.  Other columns are not read.
    """
    rows = usable(df, id_col, vector_col)
    nodes = cut_lineage(distinct_vectors(rows, k + 1))
    shards = max(1, -(-nodes.count() // shard))
    queries = cut_lineage(usable(df.where(asks), id_col, vector_col).distinct())
    blocks = max(1, -(-queries.count() // QUERIES))
    graphs = cut_lineage(build_graphs(nodes, shards))
    found = cut_lineage(search(graphs, queries, shards, blocks, k, beam))
    best = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query", "rank", "id", "score")
