"""Token counts with a whole-token shortcut, and token ids of whole texts.

Counting (sentencepiece).  The vocabulary is examined once: where no piece holds a space mark after another
character, merges never cross from a word to the next space, so a text may be cut before each run of spaces and
counted part by part.  Every piece that begins with the mark and that the library itself encodes alone as one token
is entered in a table.  Parts found there count one; only the rest are merged by the library, and short ones are
remembered for a while.

Ids (tokenizers).  The same vocabulary is also given as ranks for a quicker library; texts of Latin letters, digits,
ASCII signs and spaces, for which both libraries part words alike, go that way, all others through the named one.
So do texts with a very long run of blanks, on which the quicker library runs out of stack.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNT_MODEL = "piece_bpe_32k.model"
ID_MODEL = "byte_bpe_50k.json"
ID_RANKS = "byte_bpe_50k.tiktoken"
SPACE = "▁"
#: Parts remembered by a worker at once, and the longest that is.
REMEMBERED = 400_000
LONGEST = 48
#: Texts for which both libraries give the same ids.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ſ¡¿«»]*")
#: A run of blanks too long for the quicker library; only starts of runs are tried.
LONG_RUN = re.compile("(?<![\\t\\n\\r ])[\\t\\n\\r ]{10000}")


def whole_tokens(processor) -> frozenset[str] | None:
    """Words that are one token after a space; None where this vocabulary does not allow to count part by part.

    Proved on the library itself: each word of the table is encoded alone, and cutting is allowed only where no piece
    has a space mark behind another character, spaces are kept as they are and the text begins with a space mark.
    """
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    crossing = any(SPACE in p.lstrip(SPACE) for p in pieces)
    spaced = processor.encode("a  \tb\n", out_type=str)
    if crossing or "".join(spaced).count(SPACE) != 3 or spaced[0][:1] != SPACE or "<0x0A>" not in spaced:
        return None
    words = [p[1:] for p in pieces if len(p) > 1 and p[0] == SPACE and SPACE not in p[1:]]
    return frozenset(w for w, ids in zip(words, processor.encode(words), strict=True) if len(ids) == 1)


class Parts(dict):
    """Token counts of words after one space, merged by the library where the table has none."""

    def __init__(self, processor, whole: frozenset[str]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.processor, self.whole = processor, whole

    def __missing__(self, word: str) -> int:
        n = len(self.processor.encode(word))
        if len(word) <= LONGEST:
            if len(self) > REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[word] = n
        return n


def counter(path: str) -> Callable[[str], int]:
    """A function that counts the tokens of a text as the library does."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = whole_tokens(processor)
    if whole is None:
        return lambda text: len(processor.encode(text))
    parts = Parts(processor, whole)
    runs = re.compile(" ( *[^ ]*)")
    # A part without letters is a lone space; the library drops it when encoded alone.
    lone = len(processor.encode("a ")) - len(processor.encode("a"))
    count = parts.__getitem__

    def tokens(text: str) -> int:
        if not text:
            return 0
        if SPACE in text:
            return len(processor.encode(text))
        words = text.split(" ")
        if "" in words:
            words = runs.findall(" " + text)
            return sum(map(count, filter(None, words))) + lone * words.count("")
        return sum(map(count, words))

    return tokens


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = COUNT_MODEL, path: str | None = None
) -> DataFrame:
    """(id, n_bytes, n_tokens): one row per row of ``docs``.  A null or empty text has no bytes and no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path or public_tokenizers.path(model))
        for batch in batches:
            counts = pa.array([tokens(t or "") for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return picked.mapInArrow(run, "id long, n_bytes long, n_tokens long")


def encoder() -> Callable[[str], array]:
    """A function that gives the ids of a text as 32-bit numbers, as the library named by ID_MODEL gives them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ID_MODEL), encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(public_tokenizers.path(ID_RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cache
    def named() -> Tokenizer:  # loaded where a text asks for it
        return Tokenizer.from_file(public_tokenizers.path(ID_MODEL))

    def ids(text: str) -> array:
        if PLAIN.fullmatch(text) and not (len(text) >= 10_000 and LONG_RUN.search(text)) and not any(s in text for s in special):
            return array("I", quick.encode_ordinary(text))
        return array("I", named().encode(text, add_special_tokens=False).ids)

    return ids
