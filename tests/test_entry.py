import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "knn_l2" in queries
    assert entry.entry(spark).count() == 10


def test_imports_without_the_training_data_operators(tmp_path):
    """As after the deletion of their folders and of the pipeline."""
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "vectide", tmp_path / "vectide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_l2' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    others = ["tests/test_distances.py", "tests/test_search.py::test_top_k", "tests/test_entry.py::test_contract"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *others], cwd=tmp_path, check=True)
