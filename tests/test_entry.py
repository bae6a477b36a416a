"""The driver contract, with and without the folder of training-corpus operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_llm_folder(tmp_path):
    shutil.copytree(ROOT / "proseframe", tmp_path / "proseframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver tables")
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r.rule_id for r in rows} >= {"ste/sentence-length", "wrap/hard-wrap"}
