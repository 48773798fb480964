"""The rest of the repository without the llm subpackage, its tests and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_llm(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e, sys; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) > 80; assert not any('llm' in m for m in sys.modules if m.startswith('turnmill'))"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, timeout=120)
    # the other tests can be collected, and those that need no session run
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=to, check=True, timeout=300, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_text.py", "-q", "-k", "country or listed_emoticons"], cwd=to, check=True, timeout=300, stdout=subprocess.DEVNULL)


def test_each_without_the_other(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); print(sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"
    every = [f"op{n}_" for n in range(1, 14)]
    for name, gone, ops, whole in (("a", "corpus_pipeline.py", every, False), ("b", "llm", [], False), ("c", "none", every, True)):
        shutil.copytree(ROOT, tmp_path / name, ignore=shutil.ignore_patterns(".git", "tests", gone, "__pycache__", "spark-warehouse"))
        if not (ROOT / "corpus_pipeline.py").exists() or not (ROOT / "turnmill/llm").exists():
            return  # they are gone already
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / name, check=True, timeout=120, stdout=subprocess.PIPE, text=True).stdout
        assert all(k in out for k in ops) and bool(ops) == ("op1" in out) and whole == ("pipeline" in out), name


def test_nothing_else_imports_llm():
    for p in (ROOT / "turnmill").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "turnmill.llm" not in p.read_text(encoding="utf-8"), p
