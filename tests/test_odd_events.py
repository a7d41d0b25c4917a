"""Registered queries against their SQL on events that the given tables do not hold or hold rarely."""

from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from logweave.plans import source_queries as S
from tests import oracle


def compare(spark, folder, name, stamps, users):
    """Compare on events with all of these times and users, each of them at all remainders of its number by four."""
    pairs = [(t, u) for t in stamps for u in users for _ in range(4)]
    n = len(pairs)
    kinds = ["error", "signup", "purchase", "click", "view"]
    columns = {"event_id": range(n), "ts": [t for t, _ in pairs], "user_id": [u for _, u in pairs], "event_type": [kinds[i % 5] for i in range(n)], "value": [0.5] * n, "props": ['{"k": 1}'] * n}
    types = [("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())]
    pq.write_table(pa.table({c: list(columns[c]) for c, _ in types}, pa.schema(types)), f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    oracle.compare(spark, con, str(folder), S.queries()[name], S.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in S.MALFORMED if n != "regex"])
def test_only_the_year_of_a_malformed_time_is_broken(spark, tmp_path, name):
    """A fraction of a second that holds the digits of the year stays whole, as do other years."""
    stamps = [datetime(2024, 1, 1, 0, 0, 11, 202435), datetime(2024, 1, 1, 20, 24, 20, 120240), datetime(2031, 12, 31, 23, 59, 59, 999999)]
    compare(spark, tmp_path, f"fmt_{name}_malformed", stamps, [7])


def test_a_user_like_the_year_is_kept(spark, tmp_path):
    compare(spark, tmp_path, "fmt_regex_malformed", [datetime(2024, 1, 1, 0, 0, 11, 202435)], [7, 2024, 120245])


def test_any_year_is_broken_beside_any_user(spark, tmp_path):
    """Users that hold the digits of their event's year, and years other than that of the given tables."""
    stamps = [datetime(1969, 12, 31, 23, 59, 59, 196919), datetime(2024, 2, 29, 20, 24, 20), datetime(2031, 12, 31, 20, 31, 20, 203100)]
    compare(spark, tmp_path, "fmt_regex_malformed", stamps, [0, 1969, 2024, 12031, 202420312024])
