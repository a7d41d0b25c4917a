"""Best-fit packing of tokenised documents by the linear grouping scheme.

A document is its token ids and an end id. Documents longer than ``capacity`` are cut into
full pieces and one shorter first piece; full pieces are sequences by themselves. For the rest:

1. Lengths above a part of the capacity are large (a half, a third or a quarter: whichever plan is
   expected to need the fewest sequences). In descending order they are split into ``GROUPS`` groups of equal
   cardinality and rounded up to their group's largest length.
2. The few rounded sizes are packed by a configuration linear program (column generation, the
   columns priced by an unbounded knapsack over the capacity); its solution is rounded down
   and the few items left over are placed by first-fit decreasing.
3. Actual documents take the places of rounded ones, so a sequence gets room back.
4. Small lengths then go, longest first, each into the sequences with the least room that still
   fits (best fit), and into new ones when none is left.

With an order of the rows (``order``: a slot for each, as mixing gives) pieces of a length or group
rank by slot, the plan's configurations and moves are dealt over ``STEPS`` steps so that early
slots meet early sequences, and sequences are numbered by the mean slot of their tokens; the
number of sequences is the same.

There are at most ``capacity`` different lengths, so planning works on counts of lengths, whose
number no input can exceed; documents meet the plan through their rank among the documents of
their length (or length group), which many tasks compute. Plan arrays are broadcast: step 2's
size depends on GROUPS only, step 4's on the capacity only.

Defined cases: null text counts as empty, an empty document is its end id; repeated rows are
packed each; an empty table gives an empty result; very long texts are tokenised whole, one
at a time; other columns are not read.

Ids: those of ``tokenizers`` for the byte-level file. ``tiktoken`` over the same vocabulary and pattern gives the same ids
(tested) about four times as fast and is asked first; a text that it cannot read (its pattern matcher gives up
on a run of about a million blanks) goes to ``tokenizers`` itself. The end-of-text string in a
text is its special id in both.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import rank_within, text_batches, write_table

CAPACITY = 1024
#: Parts of the capacity above which a length may count as large.
CUTOFFS = (2, 3, 4)
GROUPS = 64
#: Steps that the plan is dealt over when rows have an order.
STEPS = 64
END_ID = 2
SPECIAL = {"<|endoftext|>": 50256}


class Vocabulary(NamedTuple):
    """Files of one vocabulary: as ``tokenizers`` reads it, and as base64 byte strings and ranks with the pattern that cuts words."""

    tokenizer: str
    ranks: str
    pattern: str


class Encoder:
    """Ids of texts; the two libraries are opened when they are first needed."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        self.vocabulary, self.whole = vocabulary, None
        with open(vocabulary.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("packing", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def plain(self, text: str) -> list[int]:
        """Ids by ``tokenizers``."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary.tokenizer)
        return self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:  # the matcher's stack is exceeded
            return self.plain(text)


_ENCODERS: dict[Vocabulary, Encoder] = {}


def pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, end_id: int = END_ID, source: bool = False) -> DataFrame:
    """doc_id, row, (source,) piece, start, length, ids_crc32 of every piece of every document."""
    also = ["source"] if source else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(vocabulary)
        encode = _ENCODERS[vocabulary]
        for b in text_batches(batches, 1000):
            rows: list[tuple] = []
            for doc, row, *of, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc, row, *of, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            types = (pa.int64(), pa.int64(), *(pa.string() for _ in also), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "row", *also, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), *(F.col(c).cast("string").alias(c) for c in also), "text")
    return rows.mapInArrow(cut, f"doc_id long, row long, {'source string, ' * source}piece int, start long, length long, ids_crc32 long")


def _best_column(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, list[int]]:
    """Unbounded knapsack: the configuration of most value."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    by = np.array(sizes)
    for room in range(1, capacity + 1):
        fits = np.nonzero(by <= room)[0]
        worth = best[room - by[fits]] + values[fits]
        best[room] = best[room - 1]
        if len(fits) and worth.max() > best[room] + 1e-12:
            best[room], pick[room] = worth.max(), fits[worth.argmax()]
    column, room = [0] * len(sizes), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            column[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), column


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[list[int], int]]:
    """(configuration, times) that hold exactly ``demand`` items of ``sizes``: column generation, rounded down, then first-fit decreasing.

    At most 64 sizes need a few hundred rounds; ``rounds`` ends an exchange of columns that goes in circles. Every basis
    gives a plan that holds all items, so an early end costs sequences at most.
    """
    left = np.array(demand)
    chosen: list[tuple[list[int], int]] = []
    if sizes:
        basis = [[capacity // s if i == j else 0 for j in range(len(sizes))] for i, s in enumerate(sizes)]
        for _ in range(rounds):
            m = np.array(basis, float).T
            x = np.linalg.solve(m, np.array(demand, float))
            duals = np.linalg.solve(m.T, np.ones(len(sizes)))
            value, column = _best_column(np.maximum(duals, 0), sizes, capacity)
            if value <= 1 + 1e-7:
                break
            d = np.linalg.solve(m, np.array(column, float))
            ratios = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
            basis[int(ratios.argmin())] = column
        x = np.linalg.solve(np.array(basis, float).T, np.array(demand, float))
        for column, times in sorted(zip(basis, x, strict=True), key=lambda p: -p[1]):
            held = np.array(column)
            k = min([int(times + 1e-6), *(left[held > 0] // held[held > 0])])
            if k > 0:
                chosen.append((column, int(k)))
                left = left - held * k
    while left.sum():  # every round uses up at least one size, as often as it goes
        column, room = np.zeros(len(sizes), int), capacity
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            column[i] = min(left[i], room // sizes[i])
            room -= column[i] * sizes[i]
        times = int((left[column > 0] // column[column > 0]).min())
        chosen.append((column.tolist(), times))
        left = left - column * times
    return chosen


def group_lengths(counts: dict[int, int], groups: int) -> list[tuple[int, list[int]]]:
    """Linear grouping: (largest length, lengths) of groups of about equal cardinality, longest first; a length stays whole."""
    goal = max(1, -(-sum(counts.values()) // groups))
    out: list[tuple[int, list[int]]] = []
    held = 0
    for length in sorted(counts, reverse=True):
        if not out or held >= goal:
            out.append((length, []))
            held = 0
        out[-1][1].append(length)
        held += counts[length]
    return out


def best_fit(rooms: dict[int, int], counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit of small lengths, longest first, on counts.

    ``rooms``: room left -> number of sequences. Returns moves (length, first rank, number, class,
    first place) and the number of new sequences. A class is a room of ``rooms`` (its sequences
    by rank), or -1 for the new sequences.
    """
    free: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in rooms.items() if r > 0 and n}
    moves, new = [], 0
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            fits = [r for r in free if r >= length]
            if not fits:
                each = capacity // length
                opened = -(-todo // each)
                free.setdefault(capacity, []).append((-1, new, opened))
                new += opened
                continue
            room = min(fits)
            cls, at, n = free[room].pop()
            if not free[room]:
                del free[room]
            take = min(n, todo)
            moves.append((length, rank, take, cls, at))
            if room > length:
                free.setdefault(room - length, []).append((cls, at, take))
            if take < n:
                free.setdefault(room, []).append((cls, at + take, n - take))
            rank, todo = rank + take, todo - take
    return moves, new


def in_steps(plan: list[tuple[list[int], int]], steps: int) -> list[tuple[list[int], int]]:
    """The plan with the times of each configuration dealt evenly over ``steps``."""
    return [(column, n) for k in range(steps) for column, times in plan if (n := times * (k + 1) // steps - times * k // steps)]


def moves_in_steps(moves: list[tuple[int, int, int, int, int]], sizes: Mapping[int, int], steps: int) -> list[tuple[int, int, int, int, int]]:
    """The same places for each length as in ``moves``, met in the order of their part of their class (``sizes``: places of each)."""
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, _, take, cls, at in moves:
        n = sizes[cls]
        for k in range(at * steps // n, (at + take - 1) * steps // n + 1):
            low, high = max(at, -(-n * k // steps)), min(at + take, -(-n * (k + 1) // steps))
            if high > low:
                places.setdefault(length, []).append((k, cls, low, high - low))
    out = []
    for length, parts in places.items():
        rank = 0
        for _, cls, low, n in sorted(parts):
            out.append((length, rank, n, cls, low))
            rank += n
    return out


def expected_sequences(plan: list[tuple[list[int], int]], grouped: list[tuple[int, list[int]]], counts: dict[int, int], small: dict[int, int], capacity: int) -> int:
    """How many sequences a plan needs if lengths fall to the places of their group at random: on all counts, whatever their size.

    The room of a configuration is distributed as the convolution of its groups' lengths; rooms in expected numbers then take the small lengths.
    """
    shares = []
    for _, lengths in grouped:
        p = np.zeros(capacity + 1)
        p[lengths] = [counts[x] for x in lengths]
        shares.append(p / p.sum())
    rooms = np.zeros(capacity + 1)
    for column, times in plan:
        filled = np.ones(1)
        for i, a in enumerate(column):
            for _ in range(a):
                filled = np.convolve(filled, shares[i])[: capacity + 1]
        rooms[capacity - np.arange(len(filled))] += times * filled
    # Rounded so that running totals stay right.
    whole = np.diff(np.rint(np.cumsum(rooms)), prepend=0).astype(np.int64)
    _, new = best_fit({r: int(n) for r, n in enumerate(whole) if n}, small, capacity)
    return sum(times for _, times in plan) + new


def plan_lengths(counts: dict[int, int], capacity: int, groups: int = GROUPS, cutoffs: tuple[int, ...] = CUTOFFS) -> tuple[list[tuple[int, list[int]]], list[tuple[list[int], int]], int]:
    """Groups of large lengths, configurations of these, and the longest small length, by the best of the cutoffs."""
    best = None
    for cutoff in cutoffs:
        most = capacity // cutoff
        large = {k: v for k, v in counts.items() if k > most}
        grouped = group_lengths(large, groups)
        plan = configurations([g[0] for g in grouped], [sum(large[x] for x in g[1]) for g in grouped], capacity)
        needs = expected_sequences(plan, grouped, counts, {k: v for k, v in counts.items() if k <= most}, capacity)
        if best is None or needs < best[0]:
            best = (needs, grouped, plan, most)
    return best[1:]


def pack(parts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, order: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add sequence_id and offset to the table of ``pieces``; ``order`` adds a slot to (row, doc_id, source) of documents."""
    spark = parts.sparkSession
    parts, _ = write_table(parts, "pieces")
    scaled = lambda at, n: F.lpad(F.hex((at * (2.0**32 / (n + 1))).cast("long")), 8, "0")  # noqa: E731  ascends with ``at`` of 0 to n
    slots = 0
    if order:
        slot = order(parts.where(F.col("piece") == 0).select("row", "doc_id", "source")).select("row", "slot")
        parts, _ = write_table(parts.drop("source").join(slot, "row"), "slotted")
        slots = parts.agg(F.max("slot")).first()[0] or 0
    # At most ``capacity`` rows. A full piece is a sequence by itself: it needs no rank, only a number of its own (below 0).
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = counts.pop(capacity, 0)
    grouped, plan, small_most = plan_lengths(counts, capacity, groups)
    plan = in_steps(plan, STEPS) if order else plan
    small = {k: v for k, v in counts.items() if k <= small_most}
    sizes = [g[0] for g in grouped]
    group_of = np.full(capacity + 1, -1)
    for i, (_, lengths) in enumerate(grouped):
        group_of[lengths] = i
    # For each group, where the run of ranks of each configuration begins, how many places it has there, and its first sequence.
    runs: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    used, sequences = [0] * len(sizes), 0
    for column, times in plan:
        for i, a in enumerate(column):
            if a:
                runs[i].append((used[i], a, sequences))
                used[i] += a * times
        sequences += times
    large_runs = [np.array(r) for r in runs]

    # A piece's class for ranking: its group (large) or its length (small).
    kind = F.element_at(F.array(*(F.lit(int(group_of[k]) + 2 * capacity if group_of[k] >= 0 else k) for k in range(1, capacity + 1))), F.col("length").cast("int"))
    digest = scaled(F.col("slot"), slots) if order else F.md5(F.concat_ws(":", "doc_id", "row", "piece").cast("binary"))
    also = ["slot"] if order else []
    partial = parts.where(F.col("length") < capacity).withColumn("kind", kind)
    ranked = rank_within(partial, ["kind"], [F.col(c) for c in (*also, "doc_id", "row", "piece")], digest, "place", sum(counts.values()))
    ranked, _ = write_table(ranked, "ranked")
    fields = f"doc_id long, row long, piece int, start long, length long, ids_crc32 long, {'slot long, ' * len(also)}sequence_id long"
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", *also, "sequence_id"]

    def columns(b: pa.RecordBatch) -> list[pa.Array]:
        return [b.column(b.schema.get_field_index(c)) for c in names[:-1]]

    def place_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("place")).to_numpy()
            seq = np.zeros(len(rank), np.int64)
            for g in np.unique(group_of[length]):
                own = group_of[length] == g
                begin, a, first = large_runs[g].T
                at = np.searchsorted(begin, rank[own], side="right") - 1
                seq[own] = first[at] + (rank[own] - begin[at]) // a[at]
            yield pa.RecordBatch.from_arrays([*columns(b), pa.array(seq, pa.int64())], names)

    big, _ = write_table(ranked.where(F.col("length") > small_most).mapInArrow(place_large, fields), "large")
    room = big.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    spread = scaled(F.col("sequence_id"), sequences) if order else F.md5(F.col("sequence_id").cast("string").cast("binary"))
    room = rank_within(room, ["room"], [F.col("sequence_id")], spread, "place", sequences)
    rooms, _ = write_table(room, "rooms")
    # At most ``capacity`` rows again.
    room_counts = {r["room"]: r["n"] for r in rooms.groupBy("room").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves, new = best_fit(room_counts, small, capacity)
    if order:
        moves = moves_in_steps(moves, {**room_counts, -1: new}, STEPS)
    by_length: dict[int, np.ndarray] = {}
    for m in moves:
        by_length.setdefault(m[0], []).append(m[1:])
    by_length = {k: np.array(v) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(by_length)

    def place_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("place")).to_numpy()
            cls, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = length == k
                first, _, c, place = shared.value[int(k)].T
                i = np.searchsorted(first, rank[own], side="right") - 1
                cls[own], at[own] = c[i], place[i] + rank[own] - first[i]
            yield pa.RecordBatch.from_arrays([*columns(b), pa.array(cls), pa.array(at)], [*names[:-1], "cls", "at"])

    little = ranked.where(F.col("length") <= small_most).mapInArrow(place_small, fields.replace("sequence_id long", "cls long, at long"))
    where = rooms.select(F.col("room"), F.col("place").alias("room_place"), "sequence_id")
    little = little.join(where, (F.col("cls") == F.col("room")) & (F.col("at") == F.col("room_place")), "left")
    little = little.withColumn("sequence_id", F.when(F.col("cls") < 0, F.lit(sequences) + F.col("at")).otherwise(F.col("sequence_id"))).select(*names)
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "row", "piece").rowsBetween(Window.unboundedPreceding, -1)
    alone = parts.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).select(*names)
    packed = big.unionByName(little).unionByName(alone)
    if order:
        packed, _ = write_table(packed, "packed")
        middle, _ = write_table(packed.groupBy("sequence_id").agg((F.sum(F.col("slot") * F.col("length")) / F.sum("length")).alias("at")), "middle")
        numbers = rank_within(middle, [], [F.col("at"), F.col("sequence_id")], scaled(F.col("at"), slots), "number", sequences + new + full).select("sequence_id", "number")
        packed = packed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("number")).select(*names)
    return packed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, order: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Tokenise, cut and pack (by the slots of ``order``): doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    out = pack(pieces(docs, vocabulary, capacity, source=order is not None), capacity, order=order)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
