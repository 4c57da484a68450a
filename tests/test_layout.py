"""The engine doesn't need the training-data subpackage, and nothing of it is imported elsewhere."""

import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "codeloom", tmp_path / "codeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_is_imported_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'hybrid_search' in q and set(o) <= set(q); from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)


def test_no_import_of_the_subpackage():
    for path in (ROOT / "codeloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "codeloom").parts:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", path.read_text(), re.M), path


def test_lineage_is_never_cut_on_local_disks():
    for path in (ROOT / "codeloom").rglob("*.py"):
        assert "localCheckpoint(" not in path.read_text(), path
