"""The entry point without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [False, True])
def test_queries_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT / "basketlake", tmp_path / "basketlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
            "assert set(o) <= set(q) and len(q) > 150 and not any(n.startswith('op') or n == 'pipeline' for n in q)")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
