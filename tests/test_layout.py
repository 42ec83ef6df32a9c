"""Nothing in the core rests on the text operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_core_does_not_import_the_text_operators():
    for f in (ROOT / "pulsegrid").rglob("*.py"):
        if "llm" not in f.parts:
            assert "pulsegrid.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f


@pytest.mark.parametrize("gone", ["pulsegrid.llm", "pulsegrid.llm.queries", "ahocorasick"])
def test_entry_without_the_text_operators(gone):
    """Also where the folder is there and something that it needs isn't."""
    code = f"""
import sys
sys.modules[{gone!r}] = None
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert q and set(o) <= set(q) and not any(n.startswith("op") or n == "pipeline" for n in q)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_the_pipeline_imports_without_the_text_operators():
    if not (ROOT / "corpus_pipeline.py").exists():
        pytest.skip("no pipeline here")
    code = """
import sys
sys.modules["pulsegrid.llm"] = None
import corpus_pipeline
assert [n for n, _ in corpus_pipeline.STAGES]
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
