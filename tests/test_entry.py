"""The driver's contract holds without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_queries_without_the_corpus_operators(tmp_path, pipeline_stays):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.md", "*.json", *(() if pipeline_stays else ("corpus_pipeline.py",))))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), len(set(e.oracle_sql()) - set(q)), *[n for n in q if n[:2] == 'op' or n == 'pipeline'])"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, unknown, *corpus = said.stdout.split()
    assert int(n) >= 48 and unknown == "0" and corpus == []
