import tracemalloc

from pyspark.sql import functions as F

from logweave.plans import source_queries as S
from logweave.sources import files
from tests.conftest import DATA


def test_rotated_file_is_not_held_on_the_driver(spark):
    df = S.rotated_file(spark, f"{DATA}/sf0.001")
    assert df.inputFiles() and df.count() == 1000


def test_spooled_rows_are_not_held(spark):
    """40 MB of lines in pieces: the driver's Python holds a row group, whose texts Arrow has."""
    n = 200_000
    tracemalloc.start()
    try:
        df = files.spooled_rows(spark, ((i, f"{i:0200d}") for i in range(n)), source_id=3, piece=500)
        assert tracemalloc.get_traced_memory()[1] < 8_000_000
    finally:
        tracemalloc.stop()
    assert df.agg(F.count(F.lit(1)), F.count_if((F.col("source_id") == 3) & (F.col("raw").cast("long") == F.col("seq")) & (F.length("raw") == 200)), F.min("seq"), F.max("seq")).first()[:] == (n, n, 0, n - 1)
    assert len(df.inputFiles()) == 1


def test_spooled_rows_of_several_files_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(files, "SPOOL_FILE", 2000)
    monkeypatch.setattr(files, "SPOOL_GROUP", 500)
    texts = ["", "a\nb", "c\r", "\0", "é\U0001f600", "x" * 5000] * 50
    df = files.spooled_rows(spark, enumerate(texts), piece=7)
    assert len(df.inputFiles()) > 10
    assert sorted(map(tuple, df.collect())) == [(0, i, x) for i, x in enumerate(texts)]
    broken = b"a\xffb".decode("utf-8", "surrogateescape")
    assert [r["raw"][0] + r["raw"][-1] for r in files.spooled_rows(spark, enumerate([broken] * 3), piece=2).collect()] == ["ab"] * 3
    assert files.spooled_rows(spark, enumerate(["a", "b"]), piece=2).count() == 2
    assert files.spooled_rows(spark, iter(()), piece=2).count() == 0


def test_standard_input_takes_no_job_a_piece(spark):
    """Two thousand pieces make one file, not files and a job a piece."""
    df = files.spooled_lines(spark, (x for i in range(20_000) for x in (f"line {i}\r\n", "\n")), piece=10)
    made = df.inputFiles()
    assert len(made) == 1 and sorted((r["seq"], r["raw"]) for r in df.collect()) == [(i, f"line {i}") for i in range(20_000)]
    assert len(S.stdin_lines(spark, f"{DATA}/sf0.001").inputFiles()) == 1
