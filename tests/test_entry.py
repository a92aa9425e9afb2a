"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(folder):
    done = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [set(x.split()) for x in done.stdout.splitlines()[-2:]]


def test_names_without_a_session():
    queries, statements = names(ROOT)
    assert statements <= queries and len(statements) > 150


def test_without_the_optional_parts(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py"))
    queries, statements = names(copy)
    assert statements <= queries and not any(q.startswith("op") or q == "pipeline" for q in queries)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["id", "doc_id", "score", "similarity", "found_by", "place"]
