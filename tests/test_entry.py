"""The entry module, with the optional subpackage and without it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q), set(o) <= set(q))"


def told(folder):
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)}, check=True)
    return run.stdout.split()


def test_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "tessella"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "tessella" / "llm", ignore_errors=True)
    whole = told(tmp_path)
    assert int(whole[0]) > 60 and whole[2:] == ["False", "False", "True"]
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):  # only the folders are gone
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        assert told(tmp_path) == whole
