"""The driver's contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    from sigloom.plans.program import REQUIRED
    from sigloom.queries import queries

    assert len(queries()) >= 90 and len(REQUIRED) >= 90


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["user_id", "t", "low", "mid", "up"] and rows.count() > 0


def test_without_the_llm_folders(tmp_path):
    for name in ("sigloom", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "sigloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 90 and 'bollinger' in e.oracle_sql(); assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
