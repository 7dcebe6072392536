"""The engine without the training-data subpackage: in a copy of the repository that lacks its folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[1]


def test_entry_without_the_training_data_subpackage(tmp_path):
    for name in ("vesper", "__spark_entry__.py", "corpus_pipeline.py"):
        source = TOP / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True, timeout=120)
    n, m, extra = said.stdout.split()
    assert int(n) > 50 and int(m) > 50 and extra == "False"
