"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "moderation_summary" in entry.queries()


def test_nothing_else_imports_the_subpackage():
    for path in [*(ROOT / "modengine").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert "modengine.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_entry_works_without_the_subpackage(tmp_path):
    (tmp_path / "modengine").mkdir()
    for path in (ROOT / "modengine").iterdir():
        if path.name not in ("llm", "__pycache__"):
            (tmp_path / "modengine" / path.name).symlink_to(path)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'moderation_summary' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    # the file's own folder, not its target's, is the one to import from
    code = f"import sys; sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p not in ('', {str(ROOT)!r})]; " + code
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
