"""The driver's entry works with or without the optional operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_optional_operators(tmp_path):
    for name in ("__spark_entry__.py", "quarrykit"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name == 'corpus_pipeline' or name.startswith('quarrykit.llm'):\n            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).returncode == 0


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).columns == ["u", "i", "prediction"]
