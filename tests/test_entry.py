import ast
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e

ROOT = Path(e.__file__).resolve().parent
SMALL = "/root/testdata/sf0.001"


def test_queries_and_sql_have_the_same_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len([n for n in e.queries() if n.startswith("q_")]) >= 45


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_package():
    for f in (ROOT / "gleaner").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                assert not any("llm" in n.split(".") for n in names), f


def test_entry_without_the_training_data_package(tmp_path):
    for name in ("__spark_entry__.py", "gleaner"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else os.makedirs(tmp_path / name)
    for child in (ROOT / "gleaner").iterdir():
        if child.name not in ("llm", "__pycache__"):
            os.symlink(child, tmp_path / "gleaner" / child.name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not [n for n in q if n.startswith('op')] and len(q) >= 45"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
