"""The entry imports with and without the operators on training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def imported(folder):
    """Names of the queries of a copy, by a Python that sees only that."""
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return [set(line.split()) for line in done.stdout.splitlines()]


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_without_the_llm_folders(tmp_path, left):
    """Also with a leftover pipeline, or a leftover folder of compiled files."""
    shutil.copytree(ROOT / "mailbench", tmp_path / "mailbench", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    if left:
        (tmp_path / "mailbench" / "llm" / "__pycache__").mkdir(parents=True)
    queries, sql = imported(tmp_path)
    assert "model_metrics" in queries and queries == sql
    assert not any(name.startswith("op") and name[2].isdigit() for name in queries) and "pipeline" not in queries


def test_as_it_is():
    queries, _ = imported(ROOT)
    if (ROOT / "mailbench" / "llm" / "queries.py").exists():
        assert {int(name[2:].partition("_")[0]) for name in queries if name.startswith("op") and name[2].isdigit()} >= set(range(1, 14))
