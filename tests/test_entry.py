"""The driver contract without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_the_rest_stands_without_the_corpus_folders(tmp_path, pipeline_too):
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    if pipeline_too:
        (there / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [k for k in q if k == 'pipeline' or k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=there, check=True, env={"PYTHONPATH": str(there), "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
