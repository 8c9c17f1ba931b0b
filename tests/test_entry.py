"""The driver's entry points with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("left", ["nothing", "the pipeline", "an empty folder"])
def test_the_rest_lives_without_them(tmp_path, left):
    gone = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if left == "the pipeline" else ["corpus_pipeline.py"]))
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=gone)
    if left == "an empty folder":
        (copy / "prosestat" / "llm").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, sql, dealt, pipeline = said.stdout.split()
    assert int(n) > 80 and int(sql) > 60 and (dealt, pipeline) == ("False", "False")
