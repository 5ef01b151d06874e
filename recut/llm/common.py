"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recut.session import Scratch, cut_lineage, ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``row``, so that no column of it can clash with what an operator adds."""
    return docs.select(F.struct("*").alias("row"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only; plain ASCII texts take the built-in, which is the same there and quicker."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def positions(count: Column) -> Column:
    """0 .. count-1, empty where count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node reachable.

    Alternating large and small stars.  Every round is two partially aggregated minima and two joins by node, which
    Spark splits for a hub; each round is a written table, so lost executors only repeat the current one.  Tables of
    finished rounds are dropped.  Nodes without an edge to another node are not returned.
    """
    with Scratch(edges.sparkSession) as scratch:
        edges = scratch.table(edges.where("a <> b").distinct())
        before = None
        while True:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            large = scratch.table(large)
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            after = scratch.table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
            scratch.drop(edges, large)
            edges = after
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == before:
                rooted = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
                return cut_lineage(rooted.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
            before = now
