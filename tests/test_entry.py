"""The entry loads the queries of the rest whatever is left of the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

from checks.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def loaded(folder, before=""):
    done = subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True, check=True)
    return [int(n) for n in done.stdout.split()]


@pytest.mark.parametrize("left_over", [None, "coursepath/llm/__pycache__"])
def test_without_the_subpackage_or_with_what_a_checkout_leaves(tmp_path, left_over):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json", "*.txt")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    if left_over:
        (tmp_path / "repo" / left_over).mkdir(parents=True)
    assert loaded(tmp_path / "repo") == [len(QUERIES)] * 2


@pytest.mark.parametrize("package", ["xxhash", "tokenizers", "public_tokenizers", "numpy"])
def test_a_missing_package_costs_no_other_query(package):
    assert loaded(ROOT, f"import sys; sys.modules[{package!r}] = None; ")[0] >= len(QUERIES)
