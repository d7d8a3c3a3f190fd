import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]


def test_core_does_not_import_the_llm_folder():
    for p in (ROOT / "sievelake").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "sievelake.llm" not in p.read_text()
    code = "import sys; sys.modules['sievelake.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 150


def test_families_import():
    from sievelake import plans

    for f in plans.FAMILIES:
        assert importlib.import_module(f"sievelake.plans.{f}").QUERIES
