"""Running values and dense numbers in order, without one task for all rows.

A window without a partition key would send every row to one task. Here rows are cut into
chunks by their number, each chunk is one window group, and chunk totals (one row a chunk) are
carried over: two levels instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.record import UNTIMED_ORDER

CHUNK_ROWS = 1 << 16
RANGES = 256
#: Most splits whose starts (a path and three numbers each) are broadcast; 128 MB a split make this 64 TB.
BROADCAST_SPLITS = 500_000


def running(df: DataFrame, value: Column, how: str, out: str, key: str = "source_id", seq: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out``: running ``max`` or ``sum`` of ``value`` in order of the dense number ``seq`` of each ``key``."""
    fold = {"max": F.max, "sum": F.sum}[how]
    rows = df.withColumn("__chunk", F.expr(f"{seq} div {chunk_rows}")).withColumn("__value", value)
    totals = rows.groupBy(key, "__chunk").agg(fold("__value").alias("__total"))
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(key).alias("__key"), F.col("__chunk").alias("__c"), fold("__total").over(before).alias("__carry"))
    upto = Window.partitionBy(key, "__chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("__local", fold("__value").over(upto))
    met = local.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__c")))
    both = F.greatest("__local", "__carry") if how == "max" else F.coalesce(F.col("__carry"), F.lit(0)) + F.coalesce(F.col("__local"), F.lit(0))
    return met.withColumn(out, both).drop("__chunk", "__value", "__key", "__c", "__carry", "__local")


def numbered_lines(lines: DataFrame, out: str = "seq", most_splits: int | None = None) -> DataFrame:
    """Add ``out``: 0-based numbers in order of file name and place. ``lines`` carries ``_path`` and ``_block`` (file and split start).

    Rows of a split keep their order; the number of rows in earlier splits (one row a split) is added.
    ``most_splits``: how many there may be. Up to ``BROADCAST_SPLITS`` their starts are broadcast and no text is shuffled;
    beyond, or where the number is not known, the planner picks the join.
    """
    rows = lines.withColumn("__id", F.monotonically_increasing_id())
    splits = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(F.col("_path").alias("__p"), F.col("_block").alias("__b"), "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    if most_splits is not None and most_splits <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    met = rows.join(starts, (F.col("_path") == F.col("__p")) & (F.col("_block") == F.col("__b")))
    return met.withColumn(out, (F.col("__start") + F.col("__id") - F.col("__first")).cast("long")).drop("__id", "__p", "__b", "__first", "__start", "_path", "_block")


def dense_ids(df: DataFrame, first: str, rest: tuple[str, str], out: str = "line_id", ranges: int = RANGES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out``: 0-based numbers in order of (``first``, source, number in source).

    Rows go to value ranges of ``first`` (approximate quantiles); a range of one value is cut further by source and
    number, as that is its order. Counts of these cells (few rows) give each cell's start.
    """
    source, seq = rest
    wanted = [i / ranges for i in range(1, ranges)]
    n, marks = df.agg(F.count(F.lit(1)), F.percentile_approx(first, wanted, 20 * ranges)).first()
    # Ranges of fewer rows than a chunk are joined; a value that fills a range is kept apart.
    some = max(1, -(-ranges * chunk_rows // max(n, 1)))
    cuts = sorted({c for i, c in enumerate(marks or []) if (i + 1) % some == 0 or i and marks[i - 1] == c})
    # A cut value begins one range and the value after it the next, so a frequent value has a range of its own.
    edges = sorted({x for c in cuts for x in (c, c + 1)})
    step = max(1, int(len(edges) ** 0.5))
    coarse, groups = edges[::step], [edges[i : i + step] for i in range(0, len(edges), step)]
    if edges:
        top = 2**63 - 1
        at = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda x: x <= F.col(first)))
        fine = F.element_at(F.array(*(F.array(*map(F.lit, [*g, *[top] * (step - len(g))])) for g in groups)), F.greatest(at, F.lit(1)))
        cell = F.when(at == 0, 0).otherwise((at - 1) * step + F.size(F.filter(fine, lambda x: (x <= F.col(first)) & (x < top))))
    else:
        cell = F.lit(0)
    single = F.lit(False) if not cuts else F.col(first).isin(*cuts) if len(cuts) < 50 else F.array_contains(F.array(*map(F.lit, cuts)), F.col(first))
    rows = df.withColumn("__cell", cell).withColumn("__src", F.when(single, F.col(source)).otherwise(-1)).withColumn("__part", F.when(single, F.expr(f"{seq} div {chunk_rows}")).otherwise(-1))
    cells = rows.groupBy("__cell", "__src", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__cell", "__src", "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col("__cell").alias("__c"), F.col("__src").alias("__s"), F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__cell", "__src", "__part").orderBy(first, source, seq)
    met = rows.withColumn("__k", F.row_number().over(within) - 1).join(starts, (F.col("__cell") == F.col("__c")) & (F.col("__src") == F.col("__s")) & (F.col("__part") == F.col("__p")))
    return met.withColumn(out, (F.col("__start") + F.col("__k")).cast("long")).drop("__cell", "__src", "__part", "__c", "__s", "__p", "__k", "__start")


def merge_by_time(records: DataFrame) -> DataFrame:
    """K-way merge of the sources in ``records`` (source_id, seq, ts_micros, …): line_id is the place in the merged stream.

    Each source keeps its own order: the head with the smallest time goes first, untimed heads at once, ties by source.
    A record therefore leaves when the largest time up to it in its source comes up.
    """
    ready = running(records, F.coalesce("ts_micros", F.lit(UNTIMED_ORDER)), "max", "__ready")
    return dense_ids(ready, "__ready", ("source_id", "seq")).drop("__ready")


def fold_lines(lines: DataFrame, continues: Column) -> DataFrame:
    """Join continuation lines to the record before them with ``\\n``; the first line of a source is always a head.

    ``lines``: source_id, seq, raw. The result's seq is dense again.
    """
    head = ~F.coalesce(continues, F.lit(False)) | (F.col("seq") == 0)
    marked = running(lines, F.when(head, 1).otherwise(0), "sum", "__record")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "raw"))), lambda x: x["raw"]), "\n")
    return marked.groupBy("source_id", "__record").agg(joined.alias("raw")).select("source_id", (F.col("__record") - 1).cast("long").alias("seq"), "raw")
