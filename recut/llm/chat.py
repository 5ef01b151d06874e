"""Chat formatting with cumulative-snapshot collapse.

A logger that writes a conversation again after every turn leaves many conversations that are prefixes of longer
ones.  Each turn gets a rolling hash of all turns up to it; a conversation whose hash at its last turn is the hash
of a longer one at an inner turn is a snapshot and goes (an anti-join); of equal conversations the smallest id
stays.  The others are rendered.

Turns are numbered and hashed in slices of turn numbers: within a slice by a window, across slices from one summary
row each, so a conversation of any length is spread over many tasks.  The rolling hash is the exclusive or of two
64-bit hashes of position, role and text, which is the same however the turns are sliced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recut.session import cut_lineage

#: Turn numbers in a slice, and turns in a rendered part.
SLICE = 256
PART = 256


def rolling(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, slice, position, role, text, h1, h2): hashes of all turns up to and with this one."""
    turns = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    ).where("conv is not null")
    turns = turns.distinct().withColumn("slice", F.floor(F.col("turn") / SLICE))
    key = ["conv", "slice"]

    def earlier(df: DataFrame, **sums: Column) -> DataFrame:
        """For each slice, the totals of the slices before it."""
        before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        whole = {name: c for name, c in sums.items()}
        totals = df.groupBy(*key).agg(*(c.alias(name) for name, c in whole.items()))
        add = {"n": F.sum, "h1": F.bit_xor, "h2": F.bit_xor}
        return totals.select(*key, *(F.coalesce(add[name](name).over(before), F.lit(0).cast("long")).alias(f"{name}_before") for name in whole))

    def same_slice(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("conv").alias("c"), F.col("slice").alias("s"), *(x for x in b.columns if x not in key))
        return a.join(b, (F.col("conv") == F.col("c")) & F.col("slice").eqNullSafe(F.col("s"))).drop("c", "s")

    turns = cut_lineage(turns)
    inside = Window.partitionBy(*key).orderBy("turn", "role", "text")
    placed = same_slice(turns.withColumn("nth", F.row_number().over(inside)), earlier(turns, n=F.count("*")))
    placed = placed.withColumn("position", (F.col("n_before") + F.col("nth")).cast("long"))
    # Hashing a null leaves a hash unchanged, so nulls are told from empty values by a flag.
    said = (F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    placed = placed.withColumn("h1", F.xxhash64("position", *said)).withColumn("h2", F.xxhash64(F.lit("second"), *said, "position"))
    placed = cut_lineage(placed.select(*key, "position", "role", "text", "h1", "h2"))
    so_far = Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("h1", F.bit_xor("h1").over(so_far)).withColumn("h2", F.bit_xor("h2").over(so_far))
    hashed = same_slice(summed, earlier(placed, h1=F.bit_xor("h1"), h2=F.bit_xor("h2")))
    return hashed.select(
        *key, "position", "role", "text", F.col("h1").bitwiseXOR(F.col("h1_before")).alias("h1"), F.col("h2").bitwiseXOR(F.col("h2_before")).alias("h2")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n): conversations that are no prefix of a longer one, the smallest id of equal ones."""
    ends = turns.groupBy("conv").agg(F.max(F.struct("position", "h1", "h2")).alias("e")).select("conv", "e.*")
    one = ends.groupBy("position", "h1", "h2").agg(F.min("conv").alias("conv"))
    lengths = ends.select("conv", F.col("position").alias("n"))
    inner = turns.join(lengths, "conv").where("position < n").select("position", "h1", "h2").distinct()
    return one.join(inner, ["position", "h1", "h2"], "left_anti").select("conv", F.col("position").alias("n"))


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template; a missing role is the user's, a missing text is empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def collapse(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, part, n_turns, turns, text): maximal conversations, rendered in parts of at most PART turns.

    The parts of a conversation, in order, are its text.  Turns go by number, then role and text; equal rows of a
    conversation are one turn, missing numbers come first, and rows without a conversation are left out.  An empty
    table gives no rows.
    """
    turns = cut_lineage(rolling(conversations, id_col, turn_col, role_col, text_col))
    kept = cut_lineage(maximal(turns))
    parted = turns.join(kept, "conv").select(
        "conv", "n", F.floor((F.col("position") - 1) / PART).alias("part"), F.struct("position", render(F.col("role"), F.col("text")).alias("said")).alias("turn")
    )
    return parted.groupBy("conv", "part").agg(F.max("n").alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("turns")).select(
        "conv", "part", "n_turns", F.size("turns").cast("long").alias("turns"), F.array_join(F.col("turns.said"), "").alias("text")
    )
