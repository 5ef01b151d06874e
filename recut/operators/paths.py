"""Rows reached by following a successor table, by pointer doubling instead of a left-to-right loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recut.session import cut_lineage


def reached(nodes: DataFrame, jumps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, __at) of the heads among ``nodes`` (keys, __at, __head) and of all that lies on the paths from them.

    ``jumps`` (keys, __at, __to) holds at most one successor of a node.  Jumps of 1, 2, 4, ... steps are joined until no
    path is that long; then the reached ones jump, longest jumps first.
    """
    keys = list(keys)
    doubled = []
    jumps = cut_lineage(jumps)
    while not jumps.isEmpty():
        doubled.append(jumps)
        onward = jumps.select(*keys, F.col("__at").alias("__to"), F.col("__to").alias("__further"))
        jumps = cut_lineage(jumps.join(onward, [*keys, "__to"]).select(*keys, "__at", F.col("__further").alias("__to")))
    found = nodes.where("__head").select(*keys, "__at")
    for jumps in reversed(doubled):
        found = found.unionByName(found.join(jumps, [*keys, "__at"]).select(*keys, F.col("__to").alias("__at"))).distinct()
    return found
