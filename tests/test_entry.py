import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_stands_without_training_data(tmp_path):
    """Both folders and the pipeline, or the folders alone, can go."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    shutil.rmtree(copy / "locusforge" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'core_plus' in q and not any(k[:2] == 'op' and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"})
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "locusforge").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
