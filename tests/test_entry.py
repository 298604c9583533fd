"""The driver's entry, with and without the folders that may be deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def registered(root: Path) -> tuple[int, str]:
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len([n for n in q if n.startswith('op')]))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)
    return done.returncode, done.stdout if not done.returncode else done.stderr


def copy(to: Path) -> Path:
    shutil.copytree(ROOT / "larder", to / "larder", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", to)
    return to


def test_without_the_corpus_operators(tmp_path):
    code, out = registered(copy(tmp_path))
    assert code == 0 and out.split()[1] == "0" and int(out.split()[0]) > 150


def test_a_fault_inside_them_is_not_hidden(tmp_path):
    root = copy(tmp_path)
    (root / "larder/llm").mkdir()
    (root / "larder/llm/__init__.py").write_text("")
    (root / "larder/llm/queries.py").write_text("import no_such_dependency\n")
    code, out = registered(root)
    assert code != 0 and "no_such_dependency" in out
