"""The rest of the library without the folders of the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("assayer/llm",), ("assayer/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without(tmp_path, gone):
    shutil.copytree(HERE, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "*.json"))
    for name in gone:
        path = tmp_path / "repo" / name
        if path.is_dir():
            shutil.rmtree(path)
            path.mkdir()  # an empty folder counts as none
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'agg01_score' in q, 'pipeline' in q, set(o) <= set(q))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, check=True)
    n, there, pipeline, covered = said.stdout.split()
    assert int(n) > 150 and (there, pipeline, covered) == ("True", "False", "True")
