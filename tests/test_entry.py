"""The driver's entry point without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = """
import __spark_entry__ as e
q, sql = e.queries(), e.oracle_sql()
assert len(q) > 100 and set(sql) <= set(q)
assert not [k for k in q if k.startswith("op") and k[2].isdigit()] and "pipeline" not in q
import pairmill.plans.catalog, pairmill.streaming.incremental, bench
"""


def _copy(tmp_path, *gone):
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.md")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: set(skip(d, names)) | {n for n in names if os.path.relpath(os.path.join(d, n), ROOT) in gone})
    return tmp_path / "copy"


def test_entry_without_the_subpackage(tmp_path):
    at = _copy(tmp_path, "pairmill/llm", "tests/llm")
    subprocess.run([sys.executable, "-c", CHECK], cwd=at, check=True, env={**os.environ, "PYTHONPATH": str(at)})


def test_entry_without_the_pipeline_too(tmp_path):
    at = _copy(tmp_path, "pairmill/llm", "tests/llm", "corpus_pipeline.py")
    subprocess.run([sys.executable, "-c", CHECK], cwd=at, check=True, env={**os.environ, "PYTHONPATH": str(at)})
