"""The entry points, with the folders of the numbered operators and without."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, set(s) <= set(q))"


def shown(folder):
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_entry_with_and_without_the_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    shutil.rmtree(copy / "segloom" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    n, numbered, pipeline, known = shown(copy)  # corpus_pipeline.py is still there
    assert int(n) > 100 and (numbered, pipeline, known) == ("0", "False", "True")
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert shown(copy) == [n, "0", "False", "True"]
    if (ROOT / "segloom" / "llm").is_dir() and (ROOT / "corpus_pipeline.py").is_file():
        assert shown(ROOT)[1:] == ["13", "True", "True"]
