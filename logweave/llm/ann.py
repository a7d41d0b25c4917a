"""Approximate nearest neighbours by multi-index hashing.

Codes are learned: ``rotations`` independent iterative-quantisation rotations of the centred
vectors each give one bit a dimension. A code is split into 8-bit substrings and every
substring has its own index. A query probes, for every substring, the buckets within
floor(radius / number of substrings); by the pigeonhole principle that reaches every code within
the Hamming radius. The codes found are checked over all bits, and the vectors of those within
the radius are ranked by their exact inner product. One radius does not suit every query: where a
block has fewer than ``SPARE`` x k codes within it, the query's radius there grows to the least one
that holds so many (every code if there are fewer), so no query is left with fewer than k neighbours.

Rotations, centre and radius are fitted on at most ``SAMPLE`` vectors (those with the
smallest md5 of their id), the radius as the smallest that finds ``TARGET`` of the sample's own
true neighbours. A larger table holds closer neighbours on average, but recall is not guaranteed: tests measure it
against brute force on tables of ten times the sample and more.
Every row is indexed. Index and queries meet block by block: index rows are dealt by a
hash to blocks of about ``BLOCK`` rows, queries to blocks of ``QUERY_BLOCK``; a pair of
blocks is a group that emits only the best ``k`` rows a query, and tasks take several groups. A row is
dealt once for every block of queries: the queries grow with the table, so the work does with its square.

Defined cases: a vector that is null, empty, all zero, holds null or a non-finite number, has a
null id or differs in length from the commonest length takes no part; rows that repeat an
id count once (the smallest vector); fewer than ``k`` candidates: all of them; ties go to
the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import sorted_groups, write_table

SAMPLE = 2000
SAMPLE_QUERIES = 200
TARGET = 0.97
ROTATIONS = 2
BLOCK = 16_384
QUERY_BLOCK = 32_768
#: Rows that a task is dealt, about; at least one group.
TASK_ROWS = 16_384
#: A query's radius in a block grows until it holds this many times k codes.
SPARE = 10
ROUNDS = 30
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


class Codes:
    """Learned rotated binary codes and the Hamming radius to search."""

    def __init__(self, sample: np.ndarray, k: int, rotations: int = ROTATIONS, target: float = TARGET):
        self.centre = sample.mean(0)
        z = sample - self.centre
        n = z.shape[1]
        _, axes = np.linalg.eigh(z.T @ z)
        v = z @ axes
        rng = np.random.default_rng(7)
        maps = []
        for _ in range(rotations):
            r, _ = np.linalg.qr(rng.standard_normal((n, n)))
            for _ in range(ROUNDS):
                left, _, right = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (left @ right).T
            maps.append(axes @ r)
        self.map = np.concatenate(maps, 1)
        codes = self.encode(sample)
        self.substrings = codes.shape[1]
        self.bits = self.map.shape[1]
        some = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))
        if len(sample) < 2:
            self.radius = self.bits
            return
        like = sample[some] @ sample.T
        like[np.arange(len(some)), some] = -np.inf
        best = np.argsort(-like, axis=1)[:, : min(k, len(sample) - 1)]
        far = np.bitwise_count(codes[some][:, None, :] ^ codes[best]).sum(2)
        self.radius = int(np.quantile(far, target, method="higher"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.map > 0, axis=1)


class Index:
    """One block: for every substring, its rows in order of the substring's value and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.begin = [np.searchsorted(codes[:, j][r], np.arange(257)) for j, r in enumerate(self.rows)]

    def _probe(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose code is within ``radius`` bits and how far they are: substring buckets by the pigeonhole rule, then all bits."""
        most = radius // len(self.rows)
        met = np.zeros(len(self.codes), bool)
        for j, (rows, begin) in enumerate(zip(self.rows, self.begin, strict=True)):
            for value in np.nonzero(_NEAR[code[j]] <= most)[0]:
                met[rows[begin[value] : begin[value + 1]]] = True
        found = np.nonzero(met)[0]
        far = np.bitwise_count(self.codes[found] ^ code).sum(1)
        return found[far <= radius], far[far <= radius]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` bits."""
        return self._probe(code, radius)[0]

    def reach(self, code: np.ndarray, radius: int, need: int) -> np.ndarray:
        """Rows within ``radius`` bits or, where these are fewer than ``need``, within the least radius that holds ``need`` (all rows if there are fewer)."""
        found, far = self._probe(code, radius)
        if len(found) >= need:
            return found
        parts = len(self.rows)
        while len(found) < min(need, len(self.codes)):
            radius = (radius // parts + 2) * parts - 1  # the largest that probes buckets one bit further
            found, far = self._probe(code, radius)
        return found[far <= np.partition(far, need - 1)[need - 1]] if len(found) > need else found


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part, one row an id."""
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = x.where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    )
    return fine.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` nearest of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    table, _ = write_table(usable(rows), "vectors")
    lengths = table.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, width = lengths[0]["n"], lengths[0]["d"]
    table = table.where(F.size("embedding") == width)
    picked = table.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(SAMPLE).toArrow()
    codes = Codes(picked["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, width), k)
    shared = spark.sparkContext.broadcast(codes)
    blocks, query_blocks = -(-n // BLOCK), -(-(n // every + 1) // QUERY_BLOCK)
    by = F.xxhash64("vec_id")
    grid = lambda a, b: (a.cast("long") * query_blocks + b).alias("pair")
    indexed = table.select(F.lit(False).alias("asks"), "vec_id", "embedding", F.pmod(by, F.lit(blocks)).alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = table.where(F.col("vec_id") % every == 0).select(F.lit(True).alias("asks"), "vec_id", "embedding", F.pmod(by, F.lit(query_blocks)).alias("b")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = indexed.select(grid(F.col("a"), F.col("b")), "asks", "vec_id", "embedding").unionByName(asked.select(grid(F.col("a"), F.col("b")), "asks", "vec_id", "embedding"))

    def each(_: object, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        asks, ids = t["asks"].to_numpy(), t["vec_id"].to_numpy()
        x = t["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        base, base_ids = x[~asks], ids[~asks]
        if not asks.any() or not len(base):
            return None
        index = Index(shared.value.encode(base))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, qid, code in zip(x[asks], ids[asks], shared.value.encode(x[asks]), strict=True):
            found = index.reach(code, shared.value.radius, SPARE * k + 1)  # the query itself may be one
            found = found[base_ids[found] != qid]
            score = (base[found] * q).sum(1)
            if len(found) > k:
                keep = score >= np.partition(score, len(found) - k)[len(found) - k]
                found, score = found[keep], score[keep]
            top = np.lexsort((base_ids[found], -score))[:k]
            out.append((np.full(len(top), qid), base_ids[found[top]], score[top]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sorted_groups(batches, "pair", each)

    tasks = min(blocks * query_blocks, -(-(n * query_blocks + -(-n // every) * blocks) // TASK_ROWS))
    hits = both.repartition(max(tasks, 1), "pair").sortWithinPartitions("pair").mapInArrow(search, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
