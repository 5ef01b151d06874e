"""Token ids of texts with very long runs of blanks."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recut.llm import packing, tokens
from tests.llm.fixtures import documents


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\r", " \n"])
def test_long_runs(blank):
    ids, named = tokens.encoder(), Tokenizer.from_file(public_tokenizers.path(tokens.ID_MODEL))
    for n in (9_999, 10_000, 1_000_000):
        text = "a" + (blank * n)[:n] + "b"
        assert ids(text).tolist() == named.encode(text, add_special_tokens=False).ids


def test_packing_long_runs(spark):
    rows = packing.pack(documents(spark, [(1, "a" + " " * 1_000_000 + "b"), (2, "a" + "\n" * 1_000_000 + "b"), (3, "a b")])).collect()
    assert {r.id for r in rows} == {1, 2, 3}
