"""Histograms, summary statistics, top values and schema inference over a view of the record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.record import NAMES

COUNTERS = ["unknown", *NAMES[1:]]
SCHEMA_ROWS = 10_000
DISTINCT = 1024
BANDS = {"err": ("error", "fatal"), "warn": ("warn",), "info": ("info",), "dbg": ("debug", "trace")}
BAND_HEIGHT = 7


def time_bounds(view: DataFrame) -> tuple[int, int] | None:
    """Least and largest time of the timed rows."""
    low, high = view.agg(F.min("ts_micros"), F.max("ts_micros")).first()
    return None if low is None else (low, high)


def histogram(view: DataFrame, bins: int, window: tuple[int, int] | None = None) -> DataFrame:
    """bin, count and a count a severity for each of ``bins`` equal bins, empty ones included.

    Without ``window`` the bins span the view's times. With it (inclusive micros) rows outside are left
    out. No timed row, no bins or an empty window: no rows. One partial aggregation of at most
    ``bins`` rows a task; bin numbers are exact beyond 64 bits.
    """
    if window is None and bins > 0:
        # Bounds come from a one-row aggregate that meets the rows in the same plan.
        edges = view.agg(F.min("ts_micros").alias("lo"), (F.max("ts_micros") + 1).alias("upper"))
        spans = view.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        rows = view.where(F.col("ts_micros").isNotNull()).join(F.broadcast(edges), F.lit(True))
        spans = spans.join(F.broadcast(edges.where(F.col("lo").isNotNull())), F.lit(True)).select("bin")
    elif bins > 0 and window[1] >= window[0]:
        rows = view.where(F.col("ts_micros").between(*window))
        spans = view.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    else:
        return view.sparkSession.createDataFrame([], "bin int, count bigint, " + ", ".join(f"{c} bigint" for c in COUNTERS))
    place = F.least(F.expr(f"CAST((CAST(ts_micros AS DECIMAL(38,0)) - {'lo' if window is None else window[0]}) * {bins} div ({'upper - lo' if window is None else window[1] + 1 - window[0]}) AS INT)"), F.lit(bins - 1)).alias("bin")
    counted = rows.groupBy(place).agg(F.count(F.lit(1)).alias("count"), *(F.count_if(F.col("severity") == k).alias(c) for k, c in enumerate(COUNTERS)))
    return spans.join(counted, "bin", "left").na.fill(0)


def untimed(view: DataFrame) -> DataFrame:
    """One row: untimed."""
    return view.agg(F.count_if(F.col("ts_micros").isNull()).alias("untimed"))


def dominant_severity(bins: DataFrame) -> DataFrame:
    """bin and the gravest severity code present in it (0 if none but unknown)."""
    return bins.select("bin", F.greatest(*(F.when(F.col(c) > 0, k).otherwise(0) for k, c in enumerate(COUNTERS))).alias("dominant"))


def peak(bins: DataFrame) -> DataFrame:
    """One row: the largest bin count."""
    return bins.agg(F.coalesce(F.max("count"), F.lit(0)).alias("peak"))


def bands(bins: DataFrame, height: int = BAND_HEIGHT) -> DataFrame:
    """bin and the bar height of each severity band, scaled to the band's own peak."""
    sums = bins.select("bin", *(sum((F.col(c) for c in parts[1:]), F.col(parts[0])).alias(b) for b, parts in BANDS.items()))
    tops = sums.agg(*(F.greatest(F.max(b), F.lit(1)).alias(f"top_{b}") for b in BANDS))
    return sums.join(F.broadcast(tops), F.lit(True)).select("bin", *(F.expr(f"{b} * {height} div top_{b}").alias(b) for b in BANDS))


def summary(view: DataFrame) -> DataFrame:
    """One row: total, timed, untimed, t_min, t_max and a count a severity."""
    return view.agg(F.count(F.lit(1)).alias("total"), F.count("ts_micros").alias("timed"), F.count_if(F.col("ts_micros").isNull()).alias("untimed"), F.min("ts_micros").alias("t_min"), F.max("ts_micros").alias("t_max"), *(F.count_if(F.col("severity") == k).alias(c) for k, c in enumerate(COUNTERS)))


def top_values(view: DataFrame, value: Column, n: int, distinct: int = DISTINCT) -> DataFrame:
    """value, count, high_card: the ``n`` most frequent of the first ``distinct`` different values in line order.

    Ties go to the smaller value; rows without a value do not count; high_card tells that there were more values.
    """
    counted = view.select(value.alias("value"), "line_id").where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("count"), F.min("line_id").alias("first"))
    # One value more than are counted shows whether there were more; no task holds all values.
    first = counted.orderBy("first").limit(distinct + 1)
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")))
    more = F.max(F.col("k") > distinct).over(Window.partitionBy(F.lit(0)))
    return ranked.withColumn("high_card", more).where(F.col("k") <= distinct).orderBy(F.desc("count"), "value").limit(n).select("value", "count", "high_card")


def schema_scan(view: DataFrame, first: int = 0, rows: int = SCHEMA_ROWS) -> DataFrame:
    """field, presence, all_strings of the top-level JSON keys of the lines numbered ``first`` up to ``first + rows``."""
    some = view.where(F.col("line_id").between(first, first + rows - 1))
    return schema_of(some)


def schema_of(some: DataFrame) -> DataFrame:
    """``schema_scan`` of all given rows; repeated keys of a record count once."""
    shaped = F.when(F.col("raw").rlike(r"(?s)^\s*\{.*\}\s*$"), F.col("raw"))
    parsed = some.select(F.from_json(shaped, "map<string,string>").alias("text"), F.json_object_keys(shaped).alias("keys"), "raw").where(F.col("keys").isNotNull())
    typed = parsed.select(F.explode(F.array_distinct("keys")).alias("field"), F.expr("try_parse_json(raw)").alias("v"))
    kind = F.when(F.col("v").isNull(), "STRING").otherwise(F.expr("schema_of_variant(try_variant_get(v, concat('$[\"', field, '\"]'), 'variant'))"))
    return typed.groupBy("field").agg(F.count(F.lit(1)).alias("presence"), F.bool_and(F.coalesce(kind == "STRING", F.lit(False))).alias("all_strings"))


def middle_schema(view: DataFrame, rows: int = SCHEMA_ROWS) -> DataFrame:
    """Schema of the middle ``rows`` rows of a filtered view, in line order."""
    n = view.count()
    w = min(n, rows)
    middle = view.orderBy("line_id").offset((n - w) // 2).limit(w) if n else view
    return schema_of(middle)


def auto_columns(schema: DataFrame, most: int) -> list[str]:
    """Field names by presence, then name, without ``ts`` and ``level``; at most ``most``."""
    chosen = schema.where(~F.col("field").isin("ts", "level")).orderBy(F.desc("presence"), "field").limit(most)
    return [r["field"] for r in chosen.select("field").collect()]


def majority_flags(view: DataFrame) -> DataFrame:
    """One row: has_timestamps and has_severity, each true for more than half of the rows."""
    n = F.count(F.lit(1))
    return view.agg((F.count("ts_micros") * 2 > n).alias("has_timestamps"), (F.count_if(F.col("severity") > 0) * 2 > n).alias("has_severity"))
