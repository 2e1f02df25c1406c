"""Every registered query with SQL gives the SQL's rows; the library works without its optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lettermill import queries_more, queries_sources, queries_training  # noqa: F401
from lettermill.queries import ORACLES, QUERIES
from tests.oracle import differences, run_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    assert not differences(QUERIES[name](spark, SF).toPandas(), run_sql(ORACLES[name], SF))


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "records", "redacted_records", "redactions"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_training_data_part():
    root = Path(entry.__file__).parent
    code = "import sys; sys.modules['lettermill.llm'] = None; import __spark_entry__ as e; assert 'pii_audit' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for path in (root / "lettermill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lettermill.llm" not in path.read_text(), path
