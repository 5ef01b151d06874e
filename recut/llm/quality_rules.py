"""Quality rules with risk-controlled thresholds.

Each rule rejects texts whose statistic exceeds a cutoff.  The cutoffs are not set by hand: for each stratum (the
language) and each statistic, fixed cutoffs are tried from lenient to strict on the labelled good texts of the
stratum, and the strictest one is taken for which, and for all more lenient ones, an exact binomial test shows that
at most ``RISK`` of good texts would be rejected.  Cutoffs of one statistic are tested in a fixed order that stops
at the first failure; the error level is divided by the number of statistics and strata (Bonferroni).  Where a
stratum has too few labels to show it, the rule is not used there.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recut.llm.common import let, packed, positions
from recut.session import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
#: Largest share of good texts a rule may reject in a stratum, and the probability of exceeding it anywhere.
RISK = 0.02
ERROR = 0.05
#: Statistics and the cutoffs tried, from lenient to strict: fixed before any label is seen.
RULES = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1),
    "capital_runs_per_word": (1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeated_share": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "duplicate_line_share": (0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "chars_per_word": (40.0, 30.0, 20.0, 15.0, 12.0, 10.0),
}


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""
    windows = F.transform(
        positions(F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
    )

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(ranked: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(ranked, j)["h"] == x["h"], F.lit(False))
            return F.filter(ranked, lambda x, j: same(x, j - 1) | same(x, j + 1))

        starts = F.sort_array(F.transform(let(placed, twice), lambda x: x["i"]))
        begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        total = F.aggregate(
            starts,
            begin,
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total)

    return let(windows, covered)


def measures(text: Column) -> Column:
    """A struct of the counts of one text; words and lines are split once."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column, n: Column) -> Column:
        fields = {
            "n_words": F.size(w),
            "word_chars": F.char_length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_lines": F.size(n),
            "n_dup_lines": F.size(n) - F.size(F.array_distinct(n)),
            "n_repeat_words": repeated_words(w),
            "n_capital_runs": F.regexp_count(text, F.lit("[A-Z]{2,}")),
        }
        return F.struct(*(c.cast("long").alias(name) for name, c in fields.items()))

    return let(words, lambda w: let(lines, lambda n: counts(w, n)))


def plain(text_col: str, stratum: Column | None) -> tuple[Column, Column]:
    """Text and stratum without nulls."""
    stratum = F.col("lang") if stratum is None else stratum
    return F.coalesce(F.col(text_col), F.lit("")), F.coalesce(stratum.cast("string"), F.lit(""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """(id, stratum, m): one row per row of ``docs``; a null text is empty."""
    text, part = plain(text_col, stratum)
    return docs.select(F.col(id_col).alias("id"), part.alias("stratum"), measures(text).alias("m"))


def ratios(m: Column) -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.when(m[b] > 0, m[a] / m[b]).otherwise(0.0)

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "capital_runs_per_word": share("n_capital_runs", "n_words"),
        "repeated_share": share("n_repeat_words", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "chars_per_word": share("word_chars", "n_words"),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def kept(m: Column, cutoffs: Column) -> Column:
    """Neither the base rule nor a cutoff of the text's stratum rejects it."""
    over = [F.coalesce(c > F.get(cutoffs, F.lit(i)), F.lit(False)) for i, c in enumerate(ratios(m).values())]
    return ~reduce(lambda a, b: a | b, over, base_failed(m))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed in logarithms from the ratio of neighbouring terms; 1 from the mean on.

    Only the smallness of the tail is asked for, and from the mean on it is about one half or more.
    """
    first = F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))

    def add(state: Column, i: Column) -> Column:
        log = state["log"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        return F.struct(log.alias("log"), (state["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(terms, first, add, lambda s: s["sum"]))


def thresholds(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(stratum, cutoffs): for each stratum an array of the cutoffs in the order of RULES, null where none is shown.

    Counts of good texts and of those each cutoff would reject come from one aggregation over all labelled rows.
    """
    good = labels.where(F.col(quality) == 1).select(F.col(label_id).alias("id")).where("id is not null").distinct()
    m = F.col("m")
    judged = stats.where(~base_failed(m)).join(good, "id", "left_semi").select("stratum", *(c.alias(n) for n, c in ratios(m).items()))
    counts = judged.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *(
            F.array(*(F.count_if(F.col(name) > cut) for cut in cuts)).alias(name)
            for name, cuts in RULES.items()
        ),
    )
    counts = cut_lineage(counts)
    level = ERROR / len(RULES) / max(counts.count(), 1)

    def chosen(name: str) -> Column:
        shown = F.transform(F.col(name), lambda k: binomial_tail(k, F.col("n"), RISK) <= level)
        failed = F.array_position(shown, False)
        last = F.when(failed == 0, len(RULES[name])).otherwise(failed - 1).cast("int")
        return F.get(F.array(*(F.lit(c) for c in RULES[name])), last - 1)

    return counts.select("stratum", F.array(*(chosen(n) for n in RULES)).alias("cutoffs"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, stratum, m (counts), base_failed, kept.

    A null or empty text has no words and fails the base rule.  Without labels, or in a stratum without enough, the
    base rule decides alone.  Repeated labels count once; repeated documents give repeated rows.
    """
    stats = cut_lineage(statistics(docs, id_col, text_col, stratum))
    cut = cut_lineage(thresholds(stats, labels))
    m = F.col("m")
    return stats.join(cut, "stratum", "left").select(
        "id", "stratum", "m", base_failed(m).alias("base_failed"), kept(m, F.col("cutoffs")).alias("kept")
    )


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, whole.

    The texts are read twice, for the thresholds and for the verdicts, so that none has to be shuffled.  The verdict
    is one expression that binds the counts, because a filter is moved below projections with all it refers to.
    """
    cut = thresholds(cut_lineage(statistics(docs)), labels)
    text, part = plain("row.text", F.col("row.lang"))
    judged = packed(docs).withColumn("stratum", part).join(cut_lineage(cut), "stratum", "left")
    return judged.where(let(measures(text), lambda m: kept(m, F.col("cutoffs")))).select("row.*")
