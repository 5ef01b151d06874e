"""Registered queries over the given tables, and their SQL twins."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recut.llm import audit, chat, classifier, lexical, nearest, packing, quality_rules, secrets, suffixes, tokens, urls
from recut.llm.common import table
from recut.llm.decontamination import decontaminate
from recut.llm.simhash import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def op1_rule_ensemble(spark: SparkSession, root: str) -> DataFrame:
    scored = classifier.classify(table(spark, root, "documents"), table(spark, root, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_snapshot_collapse(spark: SparkSession, root: str) -> DataFrame:
    return chat.collapse(table(spark, root, "conversations")).withColumnRenamed("conv", "conv_id")


OP2_SQL = f"""
WITH turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
whole AS (SELECT conv_id, count(*) AS n, list({{'r': role, 't': text}} ORDER BY position) AS said FROM turns GROUP BY conv_id),
inner_prefixes AS (
  SELECT DISTINCT k, CAST(said[1 : k] AS VARCHAR) AS prefix FROM (SELECT said, unnest(range(1, n)) AS k FROM whole)),
kept AS (
  SELECT n, conv_id FROM (SELECT n, CAST(said AS VARCHAR) AS prefix, min(conv_id) AS conv_id FROM whole GROUP BY ALL) w
  WHERE NOT exists (SELECT 1 FROM inner_prefixes i WHERE i.k = w.n AND i.prefix = w.prefix))
SELECT conv_id, (position - 1) // {chat.PART} AS part, any_value(n) AS n_turns, count(*) AS turns,
       string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY position) AS text
FROM turns JOIN kept USING (conv_id) GROUP BY conv_id, part
"""


def op3_owned_secrets(spark: SparkSession, root: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, root, "documents"))
    of_kind = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        "n_owned",
        "n_copied",
    )


OP3_KINDS = r"""
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
    (1, 'access', 'AKIA[A-Z0-9]+', 16), (2, 'hex', '[0-9a-f]+', 32), (3, 'owned', '[A-Za-z0-9+/_=-]{20,}', 20)"""


def _op3_kind(rank: int, group: int) -> str:
    return f"""
  SELECT doc_id, owner, repository, rank, kind, least, unnest(regexp_extract_all(t, pattern, 0)) AS whole,
         unnest(regexp_extract_all(t, pattern, {group})) AS value,
         unnest(list_slice(string_split_regex(t, pattern), 1, len(regexp_extract_all(t, pattern, 0)))) AS gap,
         unnest(range(len(regexp_extract_all(t, pattern, 0)))) AS j
  FROM texts, (SELECT * FROM kinds WHERE rank = {rank})"""


OP3_SQL = f"""
WITH kinds(rank, kind, pattern, least) AS (VALUES {OP3_KINDS}),
texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS repository FROM documents),
parts AS ({" UNION ALL ".join(_op3_kind(r, 2 if r == 0 else 0) for r in range(4))}),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, rank ORDER BY j) AS BIGINT) AS e FROM parts),
spans AS (SELECT *, e - length(whole) AS s FROM placed WHERE length(value) >= least),
candidates AS (
  SELECT * FROM spans WHERE rank < 3
  UNION ALL
  SELECT o.* FROM spans o WHERE rank = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND len(list_distinct(string_split(value, ''))) >= {secrets.VARIETY}
    AND NOT regexp_matches(lower(value), '{secrets.PLACEHOLDERS.removeprefix("(?i)")}')
    AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = o.doc_id AND b.rank < 3 AND b.s < o.e AND o.s < b.e)),
counted AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM candidates GROUP BY value),
held AS (SELECT value, CASE WHEN owners >= {secrets.WIDE_OWNERS} OR repositories >= {secrets.WIDE_REPOSITORIES} THEN 'copied' WHEN owners = 1 THEN 'owned' END AS held FROM counted),
listed AS (
  SELECT doc_id,
         count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3 OR held = 'owned') AS spans,
         count(*) FILTER (held = 'owned') AS n_owned, count(*) FILTER (held = 'copied') AS n_copied
  FROM candidates JOIN held USING (value) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied
FROM documents LEFT JOIN listed USING (doc_id)
"""


def op5_whole_token_counts(spark: SparkSession, root: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, root, "documents"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op6_repeated_strings(spark: SparkSession, root: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, root, "documents")).withColumnRenamed("id", "doc_id")


def op7_complement_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents")).withColumnRenamed("id", "doc_id")


def op8_controlled_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, root, "documents"), table(spark, root, "labels"))
    return judged.select(
        F.col("id").alias("doc_id"),
        *(F.col("m")[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "base_failed",
        "kept",
    )


_RATIOS = {
    "symbols_per_word": "n_symbols / n_words",
    "capital_runs_per_word": "n_capital_runs / n_words",
    "repeated_share": "n_repeat_words / n_words",
    "duplicate_line_share": "n_dup_lines / n_lines",
    "chars_per_word": "word_chars / n_words",
}
_GRID = ", ".join(f"('{name}', {i}, CAST({cut} AS DOUBLE))" for name, cuts in quality_rules.RULES.items() for i, cut in enumerate(cuts))
OP8_SQL = rf"""
WITH grid(rule, place, cut) AS (VALUES {_GRID}),
texts AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM texts),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM windows WHERE c > 1) GROUP BY doc_id),
counts AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(regexp_extract_all(t, '[A-Z]{{2,}}')) AS n_capital_runs
  FROM split LEFT JOIN repeated USING (doc_id)),
stats AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
ratios AS (
  {" UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{n}' AS rule, coalesce({r}, 0) AS ratio FROM (SELECT * REPLACE (nullif(n_words, 0) AS n_words, nullif(n_lines, 0) AS n_lines) FROM stats)" for n, r in _RATIOS.items())}),
good AS (SELECT r.* FROM ratios r WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tried AS (SELECT stratum, rule, place, cut, count(*) AS n, count(*) FILTER (ratio > cut) AS k FROM good JOIN grid USING (rule) GROUP BY ALL),
tails AS (
  SELECT stratum, rule, place, cut, any_value(n) AS n, CASE WHEN any_value(k) >= any_value(n) * {quality_rules.RISK} THEN 1.0 ELSE
    sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.RISK}) + (n - i) * ln(1 - {quality_rules.RISK}))) END AS tail
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM tried) GROUP BY stratum, rule, place, cut),
shown AS (
  SELECT *, bool_and(tail <= {quality_rules.ERROR} / {len(quality_rules.RULES)} / (SELECT count(DISTINCT stratum) FROM good))
         OVER (PARTITION BY stratum, rule ORDER BY place) AS holds FROM tails),
cutoffs AS (SELECT stratum, rule, min(cut) AS cut FROM shown WHERE holds GROUP BY ALL),
rejected AS (SELECT DISTINCT doc_id FROM ratios JOIN cutoffs USING (stratum, rule) WHERE ratio > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM stats
"""


def op4_winnowed_benchmark(spark: SparkSession, root: str) -> DataFrame:
    found = decontaminate(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, d.n, item_id FROM doc_windows d JOIN item_windows t ON d.win = t.win AND d.n = t.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def op9_url_filter(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "pages")
    judged = urls.judge_urls(pages, urls.labelled_sample(pages))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op10_golay_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    found = near_duplicates(table(spark, root, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_pruned_graph_neighbours(spark: SparkSession, root: str) -> DataFrame:
    found = nearest.nearest(table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op12_automaton_search(spark: SparkSession, root: str) -> DataFrame:
    found = lexical.ranked(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select(F.col("item").cast("long").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH texts AS (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(w) AS n FROM texts WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM texts) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term),
gains AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))) AS gain
  FROM held JOIN weights USING (term) JOIN sizes USING (doc_id), total),
scores AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM wanted JOIN gains USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {lexical.BEST}
"""


def op13_filter_diagrams(spark: SparkSession, root: str) -> DataFrame:
    return audit.audit(table(spark, root, "documents"), table(spark, root, "labels"))


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in itertools.permutations(audit.FILTERS))
OP13_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         min(doc_id) OVER (PARTITION BY t) AS first
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
         + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(doc_id > first AS INT) AS mask
  FROM texts LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
orders(filter_order) AS (VALUES {_ORDERS}),
steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit FROM orders, (SELECT unnest(range(1, 6)) AS step)),
placed AS (SELECT *, sum(bit) OVER (PARTITION BY filter_order ORDER BY step) - bit AS before FROM steps),
told AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(docs) FILTER (mask & CAST(before + bit AS INT) = 0), 0) AS kept,
         coalesce(sum(docs) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) = 0), 0) AS removed,
         coalesce(sum(docs) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) <> 0), 0) AS redundant,
         coalesce(sum(docs) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) = 0), 0) AS toxic_lost
  FROM counts, placed GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told
"""


def queries() -> dict[str, Query]:
    return {
        "op1_rule_ensemble": op1_rule_ensemble,
        "op2_snapshot_collapse": op2_snapshot_collapse,
        "op3_owned_secrets": op3_owned_secrets,
        "op8_controlled_quality_rules": op8_controlled_quality_rules,
        "op4_winnowed_benchmark": op4_winnowed_benchmark,
        "op5_whole_token_counts": op5_whole_token_counts,
        "op6_repeated_strings": op6_repeated_strings,
        "op7_complement_packing": op7_complement_packing,
        "op9_url_filter": op9_url_filter,
        "op10_golay_near_duplicates": op10_golay_near_duplicates,
        "op11_pruned_graph_neighbours": op11_pruned_graph_neighbours,
        "op12_automaton_search": op12_automaton_search,
        "op13_filter_diagrams": op13_filter_diagrams,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_snapshot_collapse": OP2_SQL,
        "op3_owned_secrets": OP3_SQL,
        "op4_winnowed_benchmark": OP4_SQL,
        "op8_controlled_quality_rules": OP8_SQL,
        "op12_automaton_search": OP12_SQL,
        "op13_filter_diagrams": OP13_SQL,
    }
