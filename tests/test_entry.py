"""The entry module works with and without the optional corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_without_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "barflow", tmp_path / "barflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'ind_all' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
