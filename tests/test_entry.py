"""The registered queries with and without the subpackage for training data."""

import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

SHOW = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, with_pipeline):
    """Only the queries of that subpackage go; whether its pipeline file stays does not matter."""
    skipped = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    done = subprocess.run(
        [sys.executable, "-c", SHOW], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr
    queries, oracles = map(eval, done.stdout.splitlines())
    assert "build_draft_vocab" in queries and queries == oracles
    assert not any(name.startswith("op") and name[2].isdigit() for name in queries) and "pipeline" not in queries
