"""Quality classifier: a sparse ensemble of rules (rule fit).

A random forest is grown over statistics of the labelled texts; every path from a root to a node is a conjunctive
rule ("symbols per word > 0.4 and capital runs <= 0.1").  A lasso logistic regression over the rules and the
clipped statistics gives most of them weight zero.  The rest are compiled into one column expression, which scores
the whole corpus without a model object.  Statistics are taken once from every text and written; training and
scoring read that table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recut.llm.common import let
from recut.llm.quality_rules import SPACES, repeated_words
from recut.session import cut_lineage

TREES = 24
DEPTH = 3
SEED = 11
LASSO = 0.002
#: Labelled rows to a partition while training.
ROWS_A_TASK = 50_000

STATISTICS = (
    "words", "chars_per_word", "symbols_per_word", "bars_per_word", "shouts_per_word", "capital_runs_per_word",
    "digit_runs_per_word", "stops_per_word", "addresses_per_word", "distinct_share", "short_share", "repeated_share",
    "words_per_line", "duplicate_line_share",
)


def statistics(text: Column) -> Column:
    """An array of the STATISTICS of one text, all zero for an empty one."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def measured(w: Column, n: Column) -> Column:
        per_word = lambda c: c / F.greatest(F.size(w), F.lit(1))
        count = lambda pattern: per_word(F.regexp_count(text, F.lit(pattern)))
        per_line = lambda c: c / F.greatest(F.size(n), F.lit(1))
        return F.array(
            F.log1p(F.size(w)),
            per_word(F.char_length(F.array_join(w, ""))),
            count(r"[#*$%&<>]"),
            count(r"\|"),
            count(r"!"),
            count(r"[A-Z]{2,}"),
            count(r"[0-9]+"),
            count(r"[.,;:?]"),
            count(r"@|://"),
            per_word(F.size(F.array_distinct(w))),
            per_word(F.size(F.filter(w, lambda x: F.char_length(x) <= 3))),
            per_word(repeated_words(w)),
            per_line(F.size(w)),
            per_line(F.size(n) - F.size(F.array_distinct(n))),
        )

    return let(words, lambda w: let(lines, lambda n: measured(w, n))).cast("array<double>")


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics, (statistic, above, bound), all of which hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, values: Column) -> Column:
        condition = F.lit(True)
        for at, above, bound in self.terms:
            value = F.get(values, F.lit(at))
            condition = condition & (value > bound if above else value <= bound)
        return condition

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[i]} {'>' if above else '<='} {bound:.4g}" for i, above, bound in self.terms)


@dataclass
class RuleModel:
    """An intercept, weighted rules and weighted clipped statistics (statistic, low, high, weight)."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[int, float, float, float]] = field(default_factory=list)

    def score(self, values: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.holds(values), weight).otherwise(0.0)
        for at, low, high, weight in self.linear:
            total = total + weight * clipped(values, at, low, high)
        return 1 / (1 + F.exp(-total))


def clipped(values: Column, at: int, low: float, high: float) -> Column:
    """A statistic between its low and high values, as 0 to 1."""
    value = F.least(F.greatest(F.get(values, F.lit(at)), F.lit(low)), F.lit(high))
    return (value - low) / ((high - low) or 1.0)


def paths(tree) -> list[Rule]:
    """The path to each node of a fitted tree but the root, later bounds on a statistic replacing wider ones."""
    found: list[Rule] = []

    def walk(node, terms: dict[tuple[int, bool], float]) -> None:
        if terms:
            found.append(Rule(tuple((i, above, bound) for (i, above), bound in sorted(terms.items()))))
        if node.numDescendants() == 0:
            return
        at, bound = node.split().featureIndex(), node.split().threshold()
        walk(node.leftChild(), {**terms, (at, False): bound})
        walk(node.rightChild(), {**terms, (at, True): bound})

    walk(tree._java_obj.rootNode(), {})
    return found


def fit(training: DataFrame) -> RuleModel:
    """Fit to rows (label 0 or 1, values).  With labels of one kind or none, the score is their share, or one half."""
    counts = {r.label: r.n for r in training.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        share = next(iter(counts), 0.5)
        return RuleModel({0.0: -20.0, 1.0: 20.0}.get(share, 0.0))
    rows = training.repartition(-(-sum(counts.values()) // ROWS_A_TASK))
    rows = cut_lineage(rows).select("label", "values")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", minInstancesPerNode=5
    ).fit(rows.select("label", array_to_vector("values").alias("features")))
    rules = list(dict.fromkeys(rule for tree in forest.trees for rule in paths(tree)))
    bounds = rows.select(
        *(F.percentile_approx(F.get("values", F.lit(i)), [0.02, 0.98], 1000).alias(str(i)) for i in range(len(STATISTICS)))
    ).first()
    values = F.col("values")
    inputs = [F.when(rule.holds(values), 1.0).otherwise(0.0) for rule in rules]
    inputs += [clipped(values, i, *bounds[i]) for i in range(len(STATISTICS))]
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False)
    fitted = lasso.fit(rows.select("label", array_to_vector(F.array(*inputs)).alias("features")))
    weights = fitted.coefficients.toArray().tolist()
    return RuleModel(
        float(fitted.intercept),
        [(rule, w) for rule, w in zip(rules, weights, strict=False) if w],
        [(i, *bounds[i], w) for i, w in enumerate(weights[len(rules) :]) if w],
    )


def held_out(doc_id: Column) -> Column:
    """One row in five, by the CRC of the id; a row without an id is not held out, and has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", quality: str = "quality"
) -> DataFrame:
    """(id, held_out, score): one row per row of ``docs``, fitted to all labelled rows that are not held out.

    A null text is empty; an empty one is scored by its zero statistics.  Labels other than 0 and 1 are left out,
    and so are documents whose labels disagree; repeated rows of a document give repeated results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    measured = cut_lineage(docs.select(F.col(id_col).alias("id"), statistics(text).alias("values")))
    marked = labels.where(F.col(quality).isin(0, 1)).groupBy(F.col(label_id).alias("id"))
    agreed = marked.agg(F.min(quality).alias("low"), F.max(quality).alias("high")).where("low = high")
    training = measured.where(~held_out(F.col("id"))).join(agreed, "id").select(F.col("low").cast("double").alias("label"), "values")
    model = fit(cut_lineage(training))
    return measured.select("id", held_out(F.col("id")).alias("held_out"), model.score(F.col("values")).alias("score"))
