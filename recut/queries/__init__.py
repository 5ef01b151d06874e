"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("intervals", "runs", "shots", "similarity", "alignment", "narration", "audio", "timeline", "texts", "files", "transcripts")


def load():
    from recut.queries.registry import REGISTRY

    for name in MODULES:
        importlib.import_module(f"recut.queries.{name}")
    return REGISTRY
