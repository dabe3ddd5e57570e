"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test data")
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    code = "import sys; sys.modules['driftloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p6_found' not in q; print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 50


def test_nothing_but_the_entry_imports_the_subpackage():
    for path in (ROOT / "driftloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "driftloom.llm" not in path.read_text()
