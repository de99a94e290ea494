"""The driver's entry points on a copy of the library without the corpus folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


@pytest.mark.parametrize("more", [(), ("corpus_pipeline.py",)])
def test_queries_without_the_corpus_folders(tmp_path, more):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *more))
    got = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    n, pipeline, first = got.stdout.split()
    assert int(n) >= 40 and (pipeline, first) == ("False", "False")
