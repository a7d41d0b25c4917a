"""MinHash near-duplicates: many universal hash minima, banding, signature verification, connected components.

1. Every text becomes its set of distinct word 5-shingles (64-bit digests of whole shingles); a
   digest of the sorted set finds equal sets, of which one stands for all from here on.
2. ``HASHES`` universal hash functions give minima: one byte of each is the signature, and ``BANDS`` bands of
   ``ROWS`` minima are keys. At Jaccard 0.85 a pair agrees on some band with probability
   1 - (1 - 0.85 ** 8) ** 40 > 0.999996.
3. Signatures are verified: of the sets that share a band key each is compared with the key's smallest, and those
   unlike it with all others of the key. Pairs whose estimate (share of equal bytes, less chance) is below the threshold by
   more than ``MARGIN`` go: a pair at the threshold is lost with probability below 1e-7 (0.85) or 1e-6 (0.8).
4. The components of the pairs left are clusters. They are cut by a hash into blocks of bounded total size, pairs of
   blocks are tasks' groups, and in each the exact intersection of every two full sets is computed from a
   sparse product. A group emits a spanning forest of its links, so rows stay in proportion to sets, not pairs.
5. Connected components of the links, by alternating large-star and small-star.

Components are those of all links that the full sets confirm; only steps 2 and 3 are approximate, with the probabilities named.
Joins on keys that may be hot are salted or left to AQE's skew join; tables between steps are
written to the shared folder.

Defined cases: null text and text without words have the empty set and are linked with nothing;
fewer than five words form one shingle; repeated rows give repeated results, and of an id with several texts one is compared; a row without an id joins the component
of an equal set that has one, stands for none, and ``keep_one`` keeps it; an empty
table gives an empty result; other columns are not read (``keep_one`` keeps all columns).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import drop_table, salted_left_join, sorted_groups, text_batches, write_table

WIDTH = 5
BANDS, ROWS = 40, 8
HASHES = BANDS * ROWS
THRESHOLD = 85
#: About how many shingles and sets a block holds; a larger set has a block to itself.
BLOCK, BLOCK_SETS = 100_000, 512
#: How far below the threshold a signature's estimate may be.
MARGIN = 0.12
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_MIXERS = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size, _U(p), np.uint64))]) for p in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit digests of the text's word 5-shingles."""
    raw = _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.nonzero(inside[1:] != inside[:-1])[0]
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(raw) + 1)
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)])
    word = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    k = min(WIDTH, len(word))
    n = len(word) - k + 1
    out = np.full(n, _U(k), np.uint64)
    for j in range(k):
        out = out * _U(_STEP) + word[j : j + n]
    return np.unique(_mix(out))


def signature(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One 64-bit key a band from the minima of the hash functions over the set, and one byte of each minimum."""
    least = np.full(HASHES, _U(2**64 - 1))
    for at in range(0, len(s), 2048):
        least = np.minimum(least, (_A[:, None] * s[None, at : at + 2048] + _B[:, None]).min(1))
    mixed = _mix(least)
    key = (mixed.reshape(BANDS, ROWS) * _MIXERS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return _mix(key).view(np.int64), mixed.astype(np.uint8).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), bands and minima (bytes) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1000):
            sizes, digests, keys, minima = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                band, least = signature(s) if len(s) else (None, None)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band)
                minima.append(least)
            made = [b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(minima, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_shingles", "digest", "bands", "minima"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>, minima binary")


def least_equal(percent: int) -> int:
    """How many bytes of two signatures must be equal: the threshold less ``MARGIN``, and one in 256 of the others by chance."""
    wanted = percent / 100 - MARGIN
    return math.ceil(HASHES * (wanted + (1 - wanted) / 256))


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), HASHES)


def candidate_links(reps: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs that connect all sets that share a band and whose signatures are alike; ``reps``: doc_id, bands, minima."""
    spark, need = reps.sparkSession, least_equal(percent)
    keys, keys_path = write_table(reps.select("doc_id", F.explode("bands").alias("key")), "bands")
    hubs = keys.groupBy("key").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars, stars_path = write_table(keys.join(hubs.hint("merge"), "key").select("key", F.col("doc_id").alias("u"), "v", "n"), "stars")
    drop_table(spark, keys_path)
    own = reps.select(F.col("doc_id").alias("id"), "minima")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                yield some.select(["u", "v"]).filter(pa.array((_bytes(some.column(2)) == _bytes(some.column(3))).sum(1) >= need))

    # A hub may have a third of all rows, so its signature goes to several tasks.
    pairs = stars.where("u <> v").select("u", "v").distinct()
    spokes = pairs.join(own.hint("merge"), F.col("u") == F.col("id")).select("u", "v", "minima")
    centres = own.join(stars.select(F.col("v").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("v"), F.col("minima").alias("centre"))
    met = salted_left_join(spokes, centres, "v", F.col("u"), 8).select("u", "v", "minima", "centre")
    near, near_path = write_table(met.mapInArrow(alike, "u long, v long"), "near")

    # Sets unlike their hub meet all sets of the key. Keys that hold the same sets are looked at once.
    unlike = stars.where("n > 2 and u <> v").join(near, ["u", "v"], "left_anti").select("key", "u", F.lit(True).alias("out"))
    open_keys = unlike.groupBy("key").agg(F.count(F.lit(1)).alias("outs"))
    held = stars.join(open_keys.hint("merge"), "key").join(unlike.hint("merge"), ["key", "u"], "left").select("key", "u", "n", "outs", F.coalesce("out", F.lit(False)).alias("out"))
    mark = F.xxhash64("u", "out")
    same = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("s"))
    once = same.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key")
    held = held.join(once.hint("merge"), "key", "left_semi").join(own.hint("merge"), F.col("u") == F.col("id"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_SETS).cast("int")
    place = lambda n: F.pmod(F.xxhash64("u"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    asked = held.where("out").select("key", "u", "minima", F.lit(True).alias("asks"), place("outs").alias("a"), "n").withColumn("b", every("n"))
    given = held.select("key", "u", "minima", F.lit(False).alias("asks"), place("n").alias("b"), "outs").withColumn("a", every("outs"))
    columns = [F.concat_ws(":", "key", "a", "b").alias("group"), "asks", "u", "minima"]
    dealt = asked.select(*columns).unionByName(given.select(*columns))

    def each(_: object, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts)
        asks, ids, rows = t["asks"].to_numpy(), t["u"].to_numpy(), _bytes(t["minima"].combine_chunks())
        base, base_ids = rows[~asks], ids[~asks]
        root = {int(i): int(i) for i in ids}
        us, vs = [], []
        for i, row in zip(ids[asks], rows[asks], strict=True):
            for j in base_ids[(base == row).sum(1) >= need]:
                a, b = _root(root, int(i)), _root(root, int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    us.append(int(i))
                    vs.append(int(j))
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"]) if us else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sorted_groups(batches, "group", each)

    others, _ = write_table(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "u long, v long"), "others")
    drop_table(spark, stars_path)
    return near.unionByName(others)


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def connected_components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component): smallest node reachable, for every node of the edge table (u, v), by alternating large-star and small-star."""
    spark = edges.sparkSession
    ordered = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = write_table(ordered(edges), name)
    mark = None
    while True:
        # Large-star: every larger neighbour of a node goes to the smallest of the node and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # A hub's edges are dealt over several tasks.
        large = salted_left_join(both.where("v > u"), least, "u", F.col("v"), 8).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small-star: a node and its smaller neighbours go to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(low, large["u"] == low["c"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after, new_path = write_table(small, name)
        new_mark = after.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_table(spark, path)
        now, path = after, new_path
        if new_mark == mark or not new_mark[0]:
            break
        mark = new_mark
    # At the fixed point every edge leads to its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _forest(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, same: bool, percent: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links between two blocks (or within one): exact intersections, 100 * both >= percent * either."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    cut = np.nonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))[0]
    often = np.diff(np.concatenate([cut, [len(flat)]]))
    column = np.repeat(np.arange(len(cut)), often)
    keep = np.repeat(often > 1, often)
    _, column = np.unique(column[keep], return_inverse=True)
    owner = owner[keep]
    both = np.zeros((n, n), np.float32)
    width = max(256, 4_000_000 // n)
    by = np.concatenate([[0], np.searchsorted(column, np.arange(width, (column[-1] if len(column) else 0) + width + 1, width))])
    for k in range(len(by) - 1):
        part = np.zeros((n, width), np.float32)
        part[owner[by[k] : by[k + 1]], column[by[k] : by[k + 1]] - k * width] = 1
        both += part @ part.T
    inter = both.astype(np.int64)
    link = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    if not same:
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    parent = {i: i for i in range(n)}
    us, vs = [], []
    for i, j in zip(*np.nonzero(np.triu(link)), strict=True):
        a, b = _root(parent, int(i)), _root(parent, int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            us.append(int(ids[i]))
            vs.append(int(ids[j]))
    return us, vs


def verified_links(docs: DataFrame, clusters: DataFrame, percent: int = THRESHOLD, block: int = BLOCK, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(u, v): a spanning forest of the true links in every cluster; ``clusters``: node, component, n_shingles."""
    sizes = clusters.groupBy("component").agg(F.ceil(F.greatest(F.sum("n_shingles") / block, F.count(F.lit(1)) / block_sets)).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A merge at every size: members of clusters grow with the input, so they are never broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(placed.hint("merge"), F.col("doc_id") == F.col("node")).select("doc_id", "component", "blocks", "own", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 500):
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([shingles(t.as_py()).tobytes() for t in b.column(4)], pa.binary())], ["doc_id", "component", "blocks", "own", "set"])

    sets = texts.mapInArrow(cut, "doc_id long, component long, blocks int, own int, set binary")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("a"), F.greatest(k, F.col("own")).alias("b"))))
    dealt = sets.withColumn("p", pair).select(F.concat_ws(":", "component", "p.a", "p.b").alias("group"), F.col("p.a").alias("a"), F.col("p.b").alias("b"), "own", "doc_id", "set")

    def each(_: object, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        ids, first = np.unique(t["doc_id"].to_numpy(), return_index=True)
        raw = t["set"]
        sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in first]
        own = t["own"].to_numpy()[first]
        us, vs = _forest(ids, sets, own, t["a"][0].as_py() == t["b"][0].as_py(), percent) if len(ids) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"]) if us else None

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sorted_groups(batches, "group", each)

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed, _ = write_table(signatures(docs), "signatures")
    sets = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = signed.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    reps = reps.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "digest", "bands", "minima")).alias("r")).select("doc_id", "r.n_shingles", "r.bands", "r.minima")
    clusters = connected_components(candidate_links(reps, percent), "clusters")
    clusters, _ = write_table(clusters.join(reps.select(F.col("doc_id").alias("node"), "n_shingles"), "node"), "clusters")
    components = connected_components(verified_links(docs, clusters, percent))
    # Representatives of sets that are repeated or linked; all others are their own component.
    facts = sets.join(components, F.col("rep") == F.col("node"), "left").where("n > 1 or component is not null").select("digest", F.coalesce("component", "rep").alias("component"))
    met = salted_left_join(signed.drop("bands", "minima"), facts, "digest", F.col("doc_id"))
    found = F.coalesce("component", "doc_id")
    return met.select("doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are near copies of a kept row (the smallest id of each component stays)."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
