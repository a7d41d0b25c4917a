"""Mixing sources to target weights by Pfair scheduling, with built-in functions only.

A source's share a_i of D = sum of all shares is its target weight a_i / D. Its rows, in the
order of the md5 of their ids, are its blocks (one row a block). Time is cut into frames in
which every source that still has rows contributes its share; a source whose rows run out
contributes what is left and the others go on with their shares. In a frame of L slots to
which source i contributes c blocks, block r is released at floor(r L / c) and due at
ceil((r + 1) L / c); in each slot the released block with the earliest deadline runs (ties: source
name). Pfair scheduling then keeps every source within less than one block of its fluid share
at every slot. Only the few different frames (at most two a source, and one) are scheduled; all
rows take their slot from their frame's schedule by an equi-join, so nothing is ordered in one task.

Tables whose size is bounded by the number of sources: counts, frames and schedules (at most
2 x sources + 1 frames of D slots). A schedule takes time in proportion to slots x sources.

Defined cases: a null source is the source ``<null>``; unlisted sources have share
``default_share``; shares below 1 are refused; rows that repeat keep one slot each; an empty table
gives an empty result; no row is ever dropped; columns with the operator's own names are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import rank_within

NULL_SOURCE = "<null>"
OWN = ["source_name", "block", "frame", "slot", "released", "due"]


def _frames(counts: DataFrame) -> DataFrame:
    """One row a different frame: first frame number, the next one's, slots before it, its length and its (source, blocks) list."""
    every = counts.agg(F.sort_array(F.collect_list(F.struct("source_name", "n", "share", "q"))).alias("every"))
    cuts = every.withColumn("cuts", F.array_sort(F.array_distinct(F.flatten(F.transform("every", lambda x: F.array(F.lit(0).cast("long"), x["q"], x["q"] + 1))))))
    each = cuts.select("every", "cuts", F.posexplode("cuts").alias("pos", "first")).withColumn("after", F.coalesce(F.get("cuts", F.col("pos") + 1), F.col("first") + 1))
    held = F.filter("every", lambda x: F.col("first") * x["share"] < x["n"])
    parts = F.transform(held, lambda x: F.struct(x["source_name"].alias("source_name"), F.least(x["share"], x["n"] - F.col("first") * x["share"]).cast("int").alias("c")))
    spans = each.withColumn("parts", parts).where(F.size("parts") > 0).withColumn("length", F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["c"])).select("first", "after", "parts", "length")
    w = Window.partitionBy(F.lit(0)).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("base", F.coalesce(F.sum((F.col("after") - F.col("first")) * F.col("length")).over(w), F.lit(0)))


def _schedules(frames: DataFrame) -> DataFrame:
    """Earliest deadline first over the released blocks of each frame: (first, source_name, r) -> slot in the frame."""
    run = """aggregate(
        sequence(0, cast(length as int) - 1),
        named_struct('done', transform(parts, p -> 0), 'order', cast(array() as array<int>)),
        (s, t) -> transform(array(array_min(filter(
            transform(parts, (p, i) -> if(s.done[i] < p.c and s.done[i] * length div p.c <= t,
                named_struct('due', ((s.done[i] + 1) * length + p.c - 1) div p.c, 'i', i), null)),
            x -> x is not null)).i), i -> named_struct(
            'done', transform(s.done, (d, j) -> if(j = i, d + 1, d)), 'order', concat(s.order, array(i))))[0],
        s -> s.order)"""
    slots = frames.withColumn("order", F.expr(run)).select("first", "length", "base", "after", "parts", F.posexplode("order").alias("at", "i"))
    w = Window.partitionBy("first", "i").orderBy("at")
    part = F.expr("parts[i]")
    return slots.select("first", "length", "base", "after", "at", part["source_name"].alias("source_name"), part["c"].alias("c"), (F.row_number().over(w) - 1).alias("r"))


def mix(docs: DataFrame, shares: Mapping[str, int], default_share: int = 1) -> DataFrame:
    """``docs`` with source_name, block (of its source), frame, slot (0-based), released and due (slots of its window)."""
    if min([default_share, *shares.values()]) < 1 or any(int(x) != x for x in shares.values()):
        raise ValueError("shares are whole numbers of at least 1")
    share = F.lit(int(default_share))
    for name, s in shares.items():
        share = F.when(F.col("source_name") == name, int(s)).otherwise(share)
    rows = docs.drop(*OWN).withColumn("source_name", F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE)))
    counts = rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("n")).withColumn("share", share.cast("long")).withColumn("q", F.expr("n div share"))
    frames = _frames(counts)
    plan = _schedules(frames)
    starts = [r["first"] for r in frames.select("first").orderBy("first").collect()] or [0]
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    numbered = rank_within(rows, ["source_name"], [F.col("doc_id")], digest, "block", rows.count()).withColumn("__share", share.cast("long"))
    placed = numbered.withColumn("frame", F.expr("block div __share")).withColumn("__r", (F.col("block") % F.col("__share")).cast("int"))
    placed = placed.withColumn("__first", F.array_max(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col("frame"))))
    slot = (F.col("base") + (F.col("frame") - F.col("first")) * F.col("length")).cast("long")
    met = placed.join(plan.withColumnRenamed("source_name", "p_source"), (F.col("__first") == F.col("first")) & (F.col("source_name") == F.col("p_source")) & (F.col("__r") == F.col("r")))
    out = met.withColumn("slot", slot + F.col("at")).withColumn("released", slot + F.expr("__r * length div c")).withColumn("due", slot + F.expr("((__r + 1) * length + c - 1) div c"))
    return out.select(*[c for c in docs.columns if c not in OWN], *OWN)


def in_order(docs: DataFrame, shares: Mapping[str, int], default_share: int = 1) -> DataFrame:
    """``docs``, its columns unchanged, dealt by ranges of slots and sorted by slot in each."""
    whole = docs.select(F.struct("*").alias("__row"), "doc_id", "source")
    return mix(whole, shares, default_share).repartitionByRange("slot").sortWithinPartitions("slot").select("__row.*")
