"""The engine without its training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_works_without_the_subpackage(tmp_path, pipeline):
    """pipeline: whether corpus_pipeline.py is left behind."""
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q); assert not [n for n in q if n.startswith('op1') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
