"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for credentials by three patterns, and for other long random-looking tokens.  All values
found are counted over the whole corpus, by digest, with the distinct owners and repositories that hold them.  A value
that many owners or many repositories hold is a copied example; another one that one owner holds is that owner's and,
where it looks live, an unnamed token becomes a finding too.  Only DataFrame functions are used.

Places are code points, ends exclusive.  Texts are keyed by their digest, so copies are judged alike and missing or
repeated ids do no harm; only digests of values, never values or texts, are written or shuffled for the counts, after
distinct combinations of digest, owner and repository are formed, so a value in a third of all texts costs a row for
each repository.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recut.llm.common import packed
from recut.session import cut_lineage


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int
    least: int


#: Base kinds, in the order in which equal starts are listed.
BASE = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs are maximal, so asking for the length in the pattern finds the same and passes over ordinary words.
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Tokens without a telling name or form; a finding only where they belong to one owner and look live.
OWNED = Kind("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
KINDS = (*BASE, OWNED)
#: A value that so many owners hold is a copied example, and so is one in so many repositories, be they one owner's.
WIDE_OWNERS = 3
WIDE_REPOSITORIES = 4
#: A live-looking value has so many different characters, a digit, a letter and no placeholder word.
VARIETY = 10
PLACEHOLDERS = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|1234"

FOUND = "struct<rank:int,s:int,e:int,value:string>"
SPAN = "struct<rank:int,s:int,e:int,digest:string>"


def located(text: Column, kind: Kind) -> Column:
    """All leftmost, non-overlapping matches with their places; those that are too short are left out.

    Splitting at the pattern gives what lies between the matches, so lengths add up to places.
    """
    parts = F.split(text, kind.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        low = state["at"] + F.length(x["0"])
        high = low + F.length(x["1"])
        span = F.struct(F.lit(KINDS.index(kind)).alias("rank"), low.alias("s"), high.alias("e"), x["2"].alias("value"))
        kept = F.when(F.length(x["2"]) >= kind.least, F.array_append(state["found"], span)).otherwise(state["found"])
        return F.when(x["1"].isNull(), state).otherwise(F.struct(high.alias("at"), kept.alias("found")))

    walked = F.aggregate(F.arrays_zip(parts, whole, value), start, step, lambda state: state["found"])
    return F.when(text.rlike(kind.pattern), walked).otherwise(F.array().cast(f"array<{FOUND}>"))


def by_place(spans: Column) -> Column:
    """In order of start, then kind."""
    return F.array_sort(
        spans, lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"])
    )


def live_looking(value: Column) -> Column:
    varied = F.size(F.array_remove(F.array_distinct(F.split(value, "")), "")) >= VARIETY
    return varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDERS)


def digested(found: Column) -> Column:
    """Matches with the digest of their value in its place."""
    return F.transform(
        found, lambda x: F.struct(x["rank"].alias("rank"), x["s"].alias("s"), x["e"].alias("e"), F.sha2(x["value"].cast("binary"), 256).alias("digest"))
    )


def scan(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """(id, key, owner, repository, base, other): matches of each text, without the text and without their values."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(
        F.col(id_col).alias("id"),
        F.md5(text.cast("binary")).alias("key"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.concat(*(located(text, k) for k in BASE)).alias("ranked"),
        located(text, OWNED).alias("other"),
    )
    clear = F.filter("other", lambda o: ~F.exists("base", lambda b: (b["s"] < o["e"]) & (o["s"] < b["e"])) & live_looking(o["value"]))
    return plain.withColumn("base", digested(by_place(F.col("ranked")))).drop("ranked").withColumn("other", digested(clear))


def ownership(scanned: DataFrame) -> DataFrame:
    """(digest, owners, repositories, held): how many distinct ones hold each value, over the whole corpus.

    A repository is one of its owner's: equal names under two owners are two.  ``held`` is "copied" from WIDE_OWNERS
    owners or WIDE_REPOSITORIES repositories on, "owned" for one owner's other values, "shared" for the rest.
    """
    places = scanned.select("owner", "repository", F.explode(F.concat("base", "other")["digest"]).alias("digest"))
    by_owner = places.distinct().groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
    counted = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    copied = (F.col("owners") >= WIDE_OWNERS) | (F.col("repositories") >= WIDE_REPOSITORIES)
    return counted.withColumn("held", F.when(copied, "copied").when(F.col("owners") == 1, "owned").otherwise("shared"))


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, key, base and spans (arrays of rank, s, e, digest), n_owned, n_copied.

    ``spans`` are the base spans and those the ownership counts add, by start and kind; ``digest`` is the SHA-256 of
    the value.  ``n_owned`` counts base spans and candidates whose value is "owned" (see ``ownership``), ``n_copied``
    those whose value is "copied".  By default the owner is ``source`` and its repositories are its languages.  A null text is empty; null owners count as one owner;
    repeated rows give repeated results; an empty table gives no rows.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.col("lang") if repository is None else repository
    scanned = cut_lineage(scan(docs, id_col, text_col, owner, repository))
    held = cut_lineage(ownership(scanned))
    places = scanned.select("key", F.explode(F.concat(F.transform("base", _marked(True)), F.transform("other", _marked(False)))).alias("at"))
    judged = places.distinct().select("key", "at.*").join(held.select("digest", "held"), "digest")
    judged = judged.groupBy("key").agg(
        F.collect_list(
            F.when(~F.col("is_base") & (F.col("held") == "owned"), F.struct("rank", "s", "e", "digest"))
        ).alias("added"),
        F.count_if(F.col("held") == "owned").alias("n_owned"),
        F.count_if(F.col("held") == "copied").alias("n_copied"),
    )
    none = F.array().cast(f"array<{SPAN}>")
    merged = by_place(F.concat(F.col("base"), F.coalesce("added", none)))
    return scanned.join(judged, "key", "left").select(
        "id", "key", "base", merged.alias("spans"),
        F.coalesce("n_owned", F.lit(0).cast("long")).alias("n_owned"),
        F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"),
    )


def _marked(is_base: bool):
    return lambda x: F.struct(
        x["rank"].alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["digest"].alias("digest"), F.lit(is_base).alias("is_base")
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        before = F.substring(text, state["at"] + 1, F.greatest(x["s"] - state["at"], F.lit(0)))
        shown = F.concat(state["out"], before, F.lit(mark))
        return F.struct(
            F.greatest(state["at"], x["e"]).alias("at"),
            F.when(x["s"] < state["at"], state["out"]).otherwise(shown).alias("out"),
        )

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every finding replaced, and n_chars to match; texts without one stay as they are."""
    found = find_secrets(docs).where(F.size("spans") > 0).select("key", "spans")
    found = cut_lineage(found.dropDuplicates(["key"]))
    keyed = packed(docs).withColumn("key", F.md5(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")))
    clear = redacted(F.col("row.text"), F.col("spans"))
    changed = F.col("row").withField("text", clear)
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.char_length(clear).cast(docs.schema["n_chars"].dataType))
    rows = keyed.join(found.hint("merge"), "key", "left").select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(changed).alias("row"))
    return rows.select("row.*")
