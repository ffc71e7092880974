"""The driver's entry with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q, any(k.startswith('op1_') for k in q))"


@pytest.mark.parametrize(("gone", "said"), [(("docloom/llm", "tests/llm"), "False False"), (("docloom/llm", "tests/llm", "corpus_pipeline.py"), "False False")])
def test_entry_without_the_corpus_parts(tmp_path, gone, said):
    home = tmp_path / "copy"
    shutil.copytree(ROOT, home, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = home / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=home, capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert " ".join(out[2:]) == said and int(out[0]) >= int(out[1]) > 90


def test_the_library_never_imports_the_corpus_parts():
    for path in (ROOT / "docloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "docloom.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
