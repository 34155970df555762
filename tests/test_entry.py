"""The entry file without the training-data package."""

import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import sys
for name in {hidden!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert names >= set(entry.oracle_sql()) and "hybrid_search" in names and len(names) > 100
assert not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names
"""


@pytest.mark.parametrize("hidden", [["tidemark.llm"], ["corpus_pipeline"], ["tidemark.llm", "corpus_pipeline"], ["tiktoken"]])
def test_core_queries_are_there_without_the_package(hidden):
    root = Path(__file__).resolve().parent.parent
    run = subprocess.run([sys.executable, "-c", CODE.format(hidden=hidden)], cwd=root, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
