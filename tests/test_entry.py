"""The driver's entry works without the optional package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_training_data_operators(tmp_path):
    """A copy without both ``llm`` folders, with and without the pipeline's file, has the reports' queries and oracles."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(o) and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; print(len(q))"
    for name in (None, "corpus_pipeline.py"):
        if name:
            (copy / name).unlink(missing_ok=True)
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
        assert out.returncode == 0, out.stderr
        assert int(out.stdout) >= 100
