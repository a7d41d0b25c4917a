import pytest

from logweave.llm import queries as Q
from tests import oracle
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_equals_sql(spark, name):
    oracle.compare(spark, oracle.connect(SF), SF, Q.queries()[name], Q.oracle_sql()[name])


def test_registered():
    import __spark_entry__ as entry

    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 11)]
    assert {*Q.queries(), "pipeline"} <= set(entry.queries())
