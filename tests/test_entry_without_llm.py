"""The entry imports, and the other queries stay, where the training-data operators are left out."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_imports_without_llm(tmp_path, with_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if with_pipeline else ["corpus_pipeline.py"])))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    total, extra, known = out.stdout.split()
    assert int(total) > 100 and int(extra) == 0 and known == "True"
