"""The registry with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def _elsewhere() -> list[str]:
    """The import path of this process without the folders that hold the package itself."""
    return [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not Path(p, "threadloom").exists()]


@pytest.mark.parametrize("left", ["all", "nothing", "empty folder", "no pipeline"])
def test_registry(tmp_path, left):
    shutil.copytree(ROOT / "threadloom", tmp_path / "threadloom", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    pipeline = (ROOT / "corpus_pipeline.py").exists() and left in ("all", "empty folder")
    if pipeline:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    operators = (ROOT / "threadloom/llm/queries.py").exists() and left in ("all", "no pipeline")
    if not operators:
        shutil.rmtree(tmp_path / "threadloom/llm", ignore_errors=True)
    if left == "empty folder":
        (tmp_path / "threadloom/llm").mkdir()
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(_elsewhere())}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, check=True, env=clean).stdout.split()
    assert (int(out[1]) > 0, out[2], out[3]) == (operators, str(operators and pipeline), "True")


def test_flagship(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "topic_id"
