"""Small tables for the operators of recut.llm."""

from __future__ import annotations

import random

#: Columns that operators use for themselves.
CLASHING = ("id", "key", "row", "text_", "words", "stratum", "m", "spans", "uid", "fp", "value", "rank", "label")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def documents(spark, rows, extra: bool = True):
    """Rows (doc_id, text), or with lang and source, as a documents table with columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
    names = CLASHING if extra else ()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    schema += "".join(f", {n} string" for n in names)
    return spark.createDataFrame([r + ("x",) * len(names) for r in full], schema)


def by_id(df, name="id"):
    return {r[name]: r for r in df.collect()}
