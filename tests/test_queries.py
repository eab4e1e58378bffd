"""Every query against its SQL oracle, and the rest for rows."""

import pytest
from helpers import SF_DIR, differences

from vacantia.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, name):
    assert differences(spark, registry.queries()[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - ORACLES.keys()))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, SF_DIR).limit(1).count() == 1


def test_entry():
    import __spark_entry__

    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= found.keys()
    assert registry.queries().keys() <= found.keys()


def test_imports_without_a_session():
    """Lists of queries and of SQL can be read before any session is there."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True).returncode == 0
