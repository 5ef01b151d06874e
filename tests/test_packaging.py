"""Queries with Python kernels run from a process that was started in another folder."""

from __future__ import annotations

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {repo!r})
from recut.session import local_session
from __spark_entry__ import queries
spark = local_session(2, 2)
for name in ("tfidf_retrieve", "select_cuts"):
    queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("ran")
"""


def test_kernels_reach_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("ran"), done.stderr[-2000:]
