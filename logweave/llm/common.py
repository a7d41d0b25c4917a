"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.sources.shared import shared_folder


#: Rows of one cell of a ranking, about.
CELL_ROWS = 1 << 18


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``write_table`` made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that no model learns from: crc32 of the id as text, mod 3, is 1 (null id: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], spread: Column, out: str, rows: int) -> DataFrame:
    """Add ``out``: 0-based rank of each row among the rows of its key, ordered by ``spread`` then ``order``.

    ``spread`` is a hex digest. Rows are numbered inside (key, first digits of the digest) and
    the sizes of the earlier digest groups are added, so a key with a third of all rows is
    numbered by many tasks. ``rows`` (about how many rows there are) sets the number of digits, so that a
    cell holds about ``CELL_ROWS`` rows at most; ranks do not depend on it.
    """
    digits = max(2, math.ceil(math.log(max(rows, 1) / CELL_ROWS, 16)))
    cell, local, base = f"__{out}_cell", f"__{out}_local", f"__{out}_base"
    placed = df.withColumn(f"__{out}_h", spread).withColumn(cell, F.substring(f"__{out}_h", 1, digits))
    group = [*keys, cell]
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*(F.col(k).alias(f"__b_{k}") for k in group), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(base))
    w = Window.partitionBy(*group).orderBy(f"__{out}_h", *order)
    numbered = placed.withColumn(local, F.row_number().over(w) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in group]
    joined = numbered.join(bases, on, "inner")
    return joined.withColumn(out, (F.col(base) + F.col(local)).cast("long")).drop(f"__{out}_h", cell, local, base, *(f"__b_{k}" for k in group))


def salted_left_join(rows: DataFrame, facts: DataFrame, key: str, salt_by: Column, salts: int = 16) -> DataFrame:
    """Left join of ``rows`` with ``facts`` (at most one row a key): a key's rows are dealt over ``salts`` tasks, its fact copied to each."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], "left").drop("__salt")


def text_batches(batches: Iterator[pa.RecordBatch], rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``rows`` rows and about ``size`` bytes of column ``text``; a longer text has a slice of its own."""
    for b in batches:
        at = b.schema.get_field_index("text")
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy()) if at >= 0 else np.zeros(b.num_rows)
        start = 0
        while start < b.num_rows:
            before = upto[start - 1] if start else 0
            end = max(start + 1, min(start + rows, int(np.searchsorted(upto, before + size, side="right"))))
            yield b.slice(start, end - start)
            start = end


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, each: Callable[[object, list[pa.RecordBatch]], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Call ``each(key, slices)`` for every run of equal keys in a partition sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    current: object = None
    for b in batches:
        col = b.column(b.schema.get_field_index(key)).to_pylist()
        start = 0
        for i, k in enumerate(col):
            if held or i > start:
                if k != current:
                    if i > start:
                        held.append(b.slice(start, i - start))
                    if (made := each(current, held)) is not None:
                        yield made
                    held, start = [], i
            current = k
        if len(col) > start:
            held.append(b.slice(start, len(col) - start))
    if held and (made := each(current, held)) is not None:
        yield made
