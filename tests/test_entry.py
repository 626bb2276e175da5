"""The entry point with, without and with half of the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def run(folder, code=COUNT):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)}, timeout=120)


@pytest.fixture
def copy(tmp_path):
    keep = shutil.ignore_patterns(".git", "__pycache__", "*.json", "tests")
    return shutil.copytree(ROOT, tmp_path / "repo", ignore=keep)


def test_without_the_training_data_operators_the_rest_is_there(copy):
    from lakeloom.plans.queries import ORACLES, QUERIES

    shutil.rmtree(copy / "lakeloom" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run(copy).stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
    (copy / "lakeloom" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion of sources may leave
    assert run(copy).stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


def test_a_missing_library_is_told(copy):
    llm = copy / "lakeloom" / "llm"
    llm.mkdir(exist_ok=True)
    (llm / "__init__.py").write_text("")
    (llm / "queries.py").write_text("import no_such_library\n")
    made = run(copy)
    assert made.returncode and "no_such_library" in made.stderr
