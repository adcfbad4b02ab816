"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "lodestrata", tmp_path / "lodestrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2:3].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 100


def test_nothing_else_imports_it():
    for p in (ROOT / "lodestrata").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            text = p.read_text()
            assert "llm" not in text or p.name == "__init__.py", p
