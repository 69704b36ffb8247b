"""The entry module with and without the add-on for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def names(folder, before=""):
    code = f"{before}\nimport __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
    queries, oracles = out.stdout.splitlines()[-2:]
    return set(queries.split()), set(oracles.split())


@pytest.mark.parametrize("gone", [("wardlight/llm",), ("wardlight/llm", "corpus_pipeline.py"), ()])
def test_imports_without_the_add_on(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "wardlight", copy / "wardlight", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if gone else [])))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and name not in gone:
            shutil.copy(ROOT / name, copy)
    # Without the folders, or with a package missing that only the add-on needs.
    queries, oracles = names(copy, "" if gone else "import sys; sys.modules['xxhash'] = None")
    assert "hospital_features" in queries and oracles <= queries
    assert not any(n == "pipeline" or n.startswith("op") and n[2].isdigit() for n in queries)
