"""Without the training-data operators everything else works."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "sievelight", tmp_path / "sievelight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'extract_pages' in q and set(o) <= set(q) and not any(n.startswith('op') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_nothing_imports_llm():
    for file in (ROOT / "sievelight").rglob("*.py"):
        if "llm" not in file.parts:
            assert ".llm" not in file.read_text() and "import llm" not in file.read_text(), file
