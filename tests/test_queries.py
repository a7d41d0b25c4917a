import subprocess
import sys

import pytest

from logweave.plans import queries as own
from logweave.plans import source_queries as others
from tests import oracle
from tests.conftest import DATA, ROOT

SF = f"{DATA}/sf0.001"
QUERIES, SQL = own.queries() | others.queries(), own.oracle_sql() | others.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, con, name):
    oracle.compare(spark, con, SF, QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:2] == ["bin", "count"] and df.count() == 24
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """The other queries stay when the training-data folders are gone."""
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "logweave", tmp_path / "logweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[-2:] == [str(len(QUERIES))] * 2, said.stderr
