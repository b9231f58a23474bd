import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_training_data_part(tmp_path, pipeline):
    """With both of its folders deleted, and with corpus_pipeline.py left or deleted as well, all other queries remain."""
    at = tmp_path / "copy"
    shutil.copytree(TOP, at, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; from strandline import queries as q; assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.ORACLES); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) >= 60, out.stderr
