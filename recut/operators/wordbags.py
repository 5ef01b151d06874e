"""Similarity of texts as bags of words: exact, without comparing texts that cannot be similar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recut.session import cut_lineage

WORD = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def similar_texts(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, *, left_text: str = "text", right_text: str = "text", least: float = 0.65
) -> DataFrame:
    """(left id, right id, shared, left_words, right_words) of all pairs with 2 x shared / (left + right) >= ``least``.

    Words count with their repeats: the k-th occurrence of a word is an element of its own, so bags are sets.  Two sets
    that reach ``least`` share an element among the first of both in any common order, once only as many are left out
    as both must have in common.  The order has elements of one side only first, which meet nothing, then those that
    bring few pairs together, so frequent words hardly ever do.  Texts too short or too long for any of the other side
    are not taken apart; what meets early enough for the lengths of both is compared whole, once a pair.

    ``least`` lies above 0 and up to 1.  Ids are not null; texts of one id count as one text.  A null text, or one
    without a word, is similar to none; an empty table gives no rows.  Other columns are not looked at.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0 and be at most 1")
    left_words = _words(left, left_id, left_text)
    theirs = cut_lineage(_counted(_in_reach(_words(right, right_id, right_text), left_words, least)))
    ours = cut_lineage(_counted(_in_reach(left_words, theirs, least)))
    most = lambda counted, out: counted.groupBy("word").agg(F.max("times").alias(out))
    both = most(ours, "ours").join(most(theirs, "theirs"), "word").select("word", F.least("ours", "theirs").cast("int").alias("most"))
    both = cut_lineage(both)
    a_parts, b_parts = _parts(ours, both), _parts(theirs, both)
    held = lambda parts, out: parts.groupBy("word", "k").agg(F.count(F.lit(1)).alias(out))
    elements = held(a_parts, "ours").join(held(b_parts, "theirs"), ["word", "k"])
    elements = cut_lineage(elements.select("word", "k", (F.col("ours") * F.col("theirs")).alias("meetings"), F.monotonically_increasing_id().alias("element")))
    a = cut_lineage(_bags(a_parts, elements, least).select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("elements").alias("a_elements"), F.col("telling").alias("a_telling")))
    b = cut_lineage(_bags(b_parts, elements, least).select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("elements").alias("b_elements"), F.col("telling").alias("b_telling")))
    meets = _first(a, "a").join(_first(b, "b"), "element")
    common = _at_least((F.col("a_n") + F.col("b_n")) * F.lit(least / 2))
    early = (F.col("a_at") <= F.col("a_n") - common) & (F.col("b_at") <= F.col("b_n") - common)
    pairs = meets.where(early).select("a", "b").distinct()
    shared = F.size(F.array_intersect("a_elements", "b_elements")).cast("bigint")
    whole = pairs.join(a.drop("a_telling"), "a").join(b.drop("b_telling"), "b").withColumn("shared", shared)
    return whole.where(2.0 * F.col("shared") / (F.col("a_n") + F.col("b_n")) >= least).select(
        F.col("a").alias(left_id), F.col("b").alias(right_id), "shared", F.col("a_n").alias("left_words"), F.col("b_n").alias("right_words")
    )


def _at_least(share: Column) -> Column:
    """The whole number of elements that ``share`` of them comes to."""
    return F.ceil(share - 1e-9)


def _words(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, words) of each text with a word."""
    whole = texts.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.concat_ws("\n", F.collect_list(text_col)).alias("text"))
    words = whole.select("id", words_of(F.col("text")).alias("words"))
    return words.select("id", F.size("words").cast("bigint").alias("n"), "words").where("n > 0")


def _in_reach(texts: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """The texts whose length does not rule out a similar one among those of ``others``."""
    shortest, longest = others.agg(F.min("n"), F.max("n")).first()
    nearest = F.greatest(F.least("n", F.lit(longest).cast("bigint")), F.lit(shortest).cast("bigint"))
    reach = F.lit(shortest).isNotNull() & (2.0 * F.least("n", nearest) / (F.col("n") + nearest) >= least)
    return texts.where(reach)


def _counted(words: DataFrame) -> DataFrame:
    """(id, n, word, times)"""
    return words.select("id", "n", F.explode("words").alias("word")).groupBy("id", "n", "word").agg(F.count(F.lit(1)).alias("times"))


def _parts(counted: DataFrame, both: DataFrame) -> DataFrame:
    """(id, n, word, k) for the k-th occurrences that some text of either side has."""
    return counted.join(both, "word").select("id", "n", "word", F.explode(F.sequence(F.lit(1), F.least(F.col("times").cast("int"), "most"))).alias("k"))


def _bags(parts: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """(id, n, elements, telling): the elements both sides have, those of few meetings first, and how many of them a similar text must touch."""
    by_text = parts.join(elements, ["word", "k"]).groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("meetings", "element"))).alias("bag"))
    # A set of n elements shares at least least / (2 - least) x n of them with any similar set.
    common = F.greatest(_at_least(F.col("n") * F.lit(least / (2 - least))), F.lit(1))
    return by_text.select("id", "n", F.col("bag.element").alias("elements"), (F.size("bag") - common + 1).cast("int").alias("telling")).where("telling > 0")


def _first(bags: DataFrame, side: str) -> DataFrame:
    """(side, side_n, element, side_at): the telling elements and how many elements of the text come before each."""
    first = F.slice(f"{side}_elements", F.lit(1), F.col(f"{side}_telling"))
    alone = F.col(f"{side}_n") - F.size(f"{side}_elements")
    placed = bags.select(side, f"{side}_n", alone.alias("__alone"), F.posexplode(first).alias("__at", "element"))
    return placed.select(side, f"{side}_n", "element", (F.col("__alone") + F.col("__at")).alias(f"{side}_at"))
