"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

A rule fits its host and all subdomains where the path starts with the rule's; the longest rule that fits decides.
All other addresses are judged by a model trained from a small labelled table of addresses.  Parsing, n-grams,
training and scoring are DataFrame operations; the model is the same few thousand weights at every size.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recut.llm.common import ascii_lower, positions
from recut.session import cut_lineage

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
GRAMS = (3, 4)
BUCKETS = 1 << 12
#: Words that label addresses for training.
UNWANTED = (
    "adult", "ads", "bets", "betting", "bonus", "casino", "clickbait", "escort", "jackpot", "loans", "lottery", "malware",
    "pharmacy", "phishing", "pills", "poker", "porn", "replica", "slots", "spam", "spyware", "viagra", "warez", "xxx",
)
WANTED = (
    "archive", "books", "cooking", "courses", "garden", "health", "history", "journal", "language", "library", "maps", "math",
    "museum", "music", "nature", "news", "recipes", "school", "science", "sports", "theatre", "travel", "weather", "wiki",
)
#: Words that hold an unwanted one of up to four letters and mean something else.
HARMLESS = ("alphabets", "beads", "downloads", "heads", "leads", "roads", "threads", "uploads")
#: Labelled addresses used for training, at most; those with the smallest hashes.
LABELLED = 5_000
RIDGE = 0.001


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, number sign or the end; empty where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null where none does."""
    chosen = None
    for verdict, at, begins in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begins)
        found = F.struct(F.lit(at + begins).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, found) if chosen is None else chosen.when(fits, found)
    return chosen


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host$`` and ``^path$``, marked by where they come from."""
    def cut(mark: str, value: Column, n: int) -> Column:
        framed = F.concat(F.lit("^"), value, F.lit("$"))
        starts = positions(F.char_length(framed) - n + 1)
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(framed, i + 1, F.lit(n))))

    return F.concat(*(cut(mark, value, n) for mark, value in (("h", host), ("p", path)) for n in GRAMS))


def featured(parsed: DataFrame) -> DataFrame:
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True)
    return hashing.transform(parsed.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")


def parse(pages: DataFrame, url_col: str) -> DataFrame:
    return pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))


def labelled_sample(pages: DataFrame, url_col: str = "url", most: int = LABELLED) -> DataFrame:
    """(url, label): a small labelled table, 1 wanted and 0 unwanted.

    Addresses for each word of UNWANTED, WANTED and HARMLESS, with the word in the host and in the path of a wanted
    host, alone and within a part, and a bounded sample of the addresses at hand, those with the smallest hashes.  One of these is
    unwanted where host or path has an unwanted word as a part, or one of more than four letters within a part.  An
    address with nothing but a shorter one within a part ("uploads") may be either and is left out.  The model answers
    for all the others.
    """
    known = []
    for words, label in ((UNWANTED, 0.0), (WANTED, 1.0), (HARMLESS, 1.0)):
        for at, word in enumerate(words):
            good = WANTED[at - 1]
            forms = (f"www.{word}.test/", f"my{word}24.test/", f"www.{good}.test/{word}/", f"www.{good}.test/a-{word}s/1")
            known += [("http://" + form, label) for form in forms]
    sample = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct().orderBy(F.xxhash64("url"), "url").limit(most)
    said = ascii_lower(F.concat_ws("/", host_of(F.col("url")), path_of(F.col("url"))))
    whole = F.arrays_overlap(F.split(said, "[^a-z0-9]+"), F.array(*(F.lit(w) for w in UNWANTED)))
    within = said.rlike("|".join(w for w in UNWANTED if len(w) > 4))
    unclear = said.rlike("|".join(w for w in UNWANTED if len(w) <= 4))
    label = F.when(whole | within, 0.0).when(~unclear, 1.0)
    fixed = pages.sparkSession.createDataFrame(known, "url string, label double")
    return fixed.unionByName(sample.select("url", label.alias("label")).where("label is not null"))


def train(labelled: DataFrame) -> LogisticRegressionModel | None:
    """Fit to a small table (url, label 0 or 1), both labels of equal weight; None where it does not hold both."""
    rows = cut_lineage(featured(parse(labelled, "url")).select("label", "features"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    model = LogisticRegression(regParam=RIDGE, maxIter=40, standardization=False, weightCol="weight")
    return model.fit(rows.withColumn("weight", weight))


def judge_urls(
    pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES
) -> DataFrame:
    """(id, host, path, rule, verdict, score): one row per row of ``pages``.

    ``score`` is the model's probability that an address is wanted; from 0.5 on it is allowed.  It is 0.5 where no
    model could be trained, and where host and path are empty (a null address, one without a scheme), since there is
    nothing to hold against them: these are allowed.  Repeated rows give repeated results.
    """
    model = train(labelled)
    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    judged = parse(picked, "url").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if model is None:
        scored = judged.withColumn("score", F.lit(0.5))
    else:
        nothing = (F.col("host") == "") & (F.col("path") == "")
        wanted = F.when(nothing, 0.5).otherwise(vector_to_array("probability")[1])
        scored = model.transform(featured(judged)).withColumn("score", wanted)
    by_model = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    return scored.select("id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_model).alias("verdict"), "score")
