"""Benchmark decontamination by winnowing.

Of every run of ``SPAN - GRAM + 1`` neighbouring word grams the smallest hash is kept as a fingerprint, on both
sides.  A span of ``SPAN`` shared words holds the same run of grams on both sides, so it shares a fingerprint: no
such span is missed.  Texts that share a fingerprint are read again, the windows of words around each shared
fingerprint are compared as text with the windows of the benchmark, and the words they cover are marked.  Items
shorter than the span are compared whole, by a hash of all their words.

Only DataFrame functions are used.  Texts are keyed by their digest, so copies are examined once and repeated or
missing ids do no harm.  No text meets another: both joins go from a hash or a window to its few benchmark rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recut.llm.common import ascii_lower, let, packed, positions
from recut.session import cut_lineage

SPAN = 10
GRAM = 7
#: Everything in ASCII but digits and small letters parts words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def grams(hashes: Column, size: int) -> Column:
    """A hash of each run of ``size`` words, from an array of word hashes."""
    return F.transform(
        positions(F.size(hashes) - size + 1),
        lambda i: F.xxhash64(F.lit(size), *(F.get(hashes, i + k) for k in range(size))),
    )


def winnowed(hashes: Column, window: int) -> Column:
    """The smallest hash of each run of ``window`` hashes, distinct; of all hashes where there are fewer."""
    if window == 1:
        return F.array_distinct(hashes)
    smallest = F.transform(
        positions(F.size(hashes) - window + 1), lambda i: F.least(*(F.get(hashes, i + k) for k in range(window)))
    )
    return F.array_distinct(smallest)


def fingerprints(words: Column, short: list[int]) -> Column:
    """Fingerprints of an array of words: winnowed grams, and a hash at each place for each short length."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(hs: Column) -> Column:
        parts = [let(grams(hs, GRAM), lambda g: winnowed(g, SPAN - GRAM + 1))]
        parts += [F.array_distinct(grams(hs, n)) for n in short]
        return F.array_distinct(F.concat(*parts)) if short else parts[0]

    return let(hashes, of)


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, n, window): the windows of each item as text, n words each."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    items = items.where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(SPAN))
    starts = positions(F.size("words") - size + 1)
    return items.select(
        "item", size.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("words"), i + 1, size), " "))).alias("window")
    ).distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, key (digest of the text), n_words, n_hit, n_items, items (sorted as strings) and spans.

    ``spans`` are the maximal covered runs as (first word, end word).  A null or empty text has no words and no
    hits; so has every text where the benchmark is empty.  An item without words has no window; one without an id
    marks words but is not listed.  Repeated items count once; repeated documents give repeated rows.
    """
    windows = cut_lineage(benchmark_windows(benchmark, item_col, item_text_col))
    # At most SPAN - 1 rows: the lengths of items that are shorter than the span.
    short = sorted(r.n for r in windows.where(F.col("n") < SPAN).select("n").distinct().collect())
    known = windows.select(F.explode(fingerprints(F.split("window", " "), short)).alias("print")).distinct()
    known = cut_lineage(known)

    keyed = docs.select(
        F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("key"),
        F.col(text_col).alias("text"),
    )
    prints = keyed.select("key", F.explode(fingerprints(words_of(F.col("text")), short)).alias("print"))
    shared = cut_lineage(prints.join(known, "print").groupBy("key").agg(F.collect_set("print").alias("prints")))

    # The texts with shared fingerprints, once each, as words.
    again = keyed.select("key", "text").join(shared.select("key"), "key", "left_semi")
    again = again.groupBy("key").agg(F.first("text").alias("text")).join(shared, "key")
    again = cut_lineage(again.select("key", "prints", words_of(F.col("text")).alias("words")))
    hashed = again.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))

    def places(size: int) -> Column:
        """Where a gram of this size has a shared fingerprint."""
        return let(
            grams(F.col("hashes"), size),
            lambda g: F.filter(positions(F.size(g)), lambda i: F.array_contains(F.col("prints"), F.get(g, i))),
        )

    def around(at: Column) -> Column:
        """First words of the spans that hold the gram at this place."""
        low = F.greatest(at - (SPAN - GRAM), F.lit(0))
        high = F.least(at, F.size("words") - SPAN)
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    long_starts = F.array_distinct(F.flatten(F.transform(places(GRAM), around)))

    def sized(starts: Column, n: int) -> Column:
        return F.transform(starts, lambda s: F.struct(s.alias("s"), F.lit(n).alias("n")))

    starts = [sized(long_starts, SPAN), *(sized(places(n), n) for n in short)]
    spans = hashed.select("key", "words", F.explode(F.concat(*starts)).alias("at")).select(
        "key", "at.s", "at.n", F.array_join(F.slice("words", F.col("at.s") + 1, F.col("at.n")), " ").alias("window")
    )
    hits = cut_lineage(spans.join(windows.select("window", "n").distinct(), ["window", "n"]))

    def widen(runs: Column, span: Column) -> Column:
        """Add a span, in order of its start, to the covered runs so far."""
        last = F.get(runs, F.size(runs) - 1)
        grown = F.concat(
            F.slice(runs, 1, F.size(runs) - 1),
            F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], span["e"]).alias("e"))),
        )
        return F.when((F.size(runs) > 0) & (last["e"] >= span["s"]), grown).otherwise(F.array_append(runs, span))

    cover = hits.groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct(F.col("s"), (F.col("s") + F.col("n")).alias("e")))).alias("spans")
    )
    cover = cover.select(
        "key", F.aggregate("spans", F.array().cast("array<struct<s:int,e:int>>"), widen).alias("spans")
    )
    listed = hits.select("key", "window", "n").distinct().join(windows, ["window", "n"])
    listed = listed.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = cut_lineage(cover.join(listed, "key"))

    counted = keyed.select("id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, r: a + (r["e"] - r["s"]))
    return counted.join(found, "key", "left").select(
        "id",
        "key",
        "n_words",
        F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, whole."""
    hit = cut_lineage(decontaminate(docs, benchmark).where("n_hit > 0").select("key").distinct())
    keyed = packed(docs).withColumn("key", F.md5(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")))
    return keyed.join(hit.hint("merge"), "key", "left_anti").select("row.*")
