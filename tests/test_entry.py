"""The entry module with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, not set(s) - set(q))"


def _counts(folder) -> list[str]:
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_training_data_folders(tmp_path):
    bare = tmp_path / "repo"
    shutil.copytree(REPO, bare, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    n, m, pipeline, named = _counts(bare)
    assert int(n) >= int(m) > 50 and (pipeline, named) == ("False", "True")
    (bare / "corpus_pipeline.py").unlink()
    assert _counts(bare) == [n, m, "False", "True"]


def test_basenames_of_test_files_are_unique():
    names = [p.name for p in (REPO / "tests").rglob("test_*.py")]
    assert len(names) == len(set(names))
