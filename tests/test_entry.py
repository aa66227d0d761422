"""The entry points with and without the optional operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert s.keys() <= q.keys(); print(*q)"


def _names(folder: Path) -> set[str]:
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


def test_entry_works_without_the_optional_part(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tagloom", tmp_path / "tagloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    without = _names(tmp_path)
    assert "customer_profile" in without and not [n for n in without if n.startswith("op") or n == "pipeline"]
    assert without <= _names(ROOT)
