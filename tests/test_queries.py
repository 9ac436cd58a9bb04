"""Every registered query against its DuckDB statement, on the smallest tables."""

import pytest

from checks import compare, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    ok, note = compare.compare(spark, duck, SF, registry.QUERIES[name], registry.ORACLE.get(name))
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_operators(tmp_path):
    """The library, its queries and the entry stand without the subpackage and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    left_out = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse", "*.parquet")
    copy = tmp_path / "repo"
    shutil.copytree(repo, copy, ignore=left_out)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, check=True)
    assert said.stdout.split() == sorted(registry.QUERIES)
