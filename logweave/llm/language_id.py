"""Language identification by prediction by partial matching (PPM).

Training counts give one byte context tree a language: for every context of 0 to ``order``
bytes, which bytes followed and how often. The statistics are then frozen. A text's code
length under a language is the sum, byte by byte, of the code for the longest known
context: an escape (method C, count = number of distinct followers) for every context that
never had this byte, with the followers of longer contexts excluded, then the byte itself;
below order 0 the bytes not yet seen are equally likely. The shortest code wins; ``score``
is its posterior probability under equal priors.

Learning uses at most ``docs_per_lang`` texts of each language (the documented bound: those
with the smallest md5 of their id) and whole texts. Prediction reads every whole text.

Defined cases: null text or text without a letter gives ``und`` and score 0; with no row to
learn from, every row is ``und``; very long texts are scored in chunks that carry the
context over; repeated rows give repeated results; columns other than the named ones are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import held_out, text_batches

ORDER = 4
DOCS_PER_LANG = 600
CHUNK = 1 << 20
#: Costs (of a byte in context under a language) that a task keeps before it begins anew.
CACHE = 6_000_000


def byte_keys(parts: list[tuple[bytes, bytes]], order: int = ORDER) -> np.ndarray:
    """For every byte of each (context, chunk): the ``order`` bytes before it and itself, packed; missing ones are 0."""
    joined = np.frombuffer(b"".join(c.rjust(order, b"\0")[-order:] + t for c, t in parts), np.uint8).astype(np.int64)
    keys = joined.copy()
    for back in range(1, order + 1):
        keys[back:] |= joined[:-back] << (8 * back)
    real = np.ones(len(joined), bool)
    at = 0
    for _, t in parts:
        real[at : at + order] = False
        at += order + len(t)
    return keys[real]


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value is in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


class ContextTree:
    """Frozen counts of one language: for each length of context, its bytes in context, and each context's total and different followers."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        self.keys, self.count, self.contexts, self.total, self.distinct = [], [], [], [], []
        #: What a context leaves of the next shorter one: followers that it does not have itself.
        self.under_total: list[np.ndarray | None] = [None]
        self.under_distinct: list[np.ndarray | None] = [None]
        for j in range(order + 1):
            own, inverse = np.unique(grams & ((1 << 8 * (j + 1)) - 1), return_inverse=True)
            c = np.bincount(inverse, counts, len(own))
            ctx, at = np.unique(own >> 8, return_inverse=True)
            n, d = np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx)).astype(float)
            if j:
                lower = np.searchsorted(self.keys[j - 1], own & ((1 << 8 * j) - 1))
                gone = np.bincount(at, self.count[j - 1][lower], len(ctx))
                parent = np.searchsorted(self.contexts[j - 1], ctx & ((1 << 8 * (j - 1)) - 1))
                self.under_total.append(self.total[j - 1][parent] - gone)
                self.under_distinct.append(self.distinct[j - 1][parent] - d)
            for kept, new in ((self.keys, own), (self.count, c), (self.contexts, ctx), (self.total, n), (self.distinct, d)):
                kept.append(new)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits that each packed byte takes."""
        bits = np.zeros(len(keys))
        still = np.ones(len(keys), bool)
        above, above_at = None, None
        for j in range(self.order, -1, -1):
            gram = keys & ((1 << 8 * (j + 1)) - 1)
            at, seen = _find(self.contexts[j], gram >> 8)
            at_gram, has = _find(self.keys[j], gram)
            count = np.where(has, self.count[j][at_gram], 0)
            n, d = self.total[j][at], self.distinct[j][at]
            if above is not None:
                n = np.where(above, self.under_total[j + 1][above_at], n)
                d = np.where(above, self.under_distinct[j + 1][above_at], d)
            live = still & seen & (n + d > 0)
            hit = live & (count > 0)
            part = np.where(hit, count, np.where(live, d, 1)) / np.where(live, n + d, 1)
            bits -= np.log2(np.where(live, np.maximum(part, 1e-300), 1))
            still &= ~hit
            above, above_at = seen, at
        return bits + np.where(still, np.log2(max(256 - self.distinct[0][0], 1)), 0)


class PPMModel:
    """The context trees of all languages, each as large as its own counts, however many languages there are."""

    def __init__(self, langs: list[str], grams: np.ndarray, lang_of: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.langs, self.order = langs, order
        self.trees = [ContextTree(grams[lang_of == i], counts[lang_of == i], order) for i in range(len(langs))]

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits that each packed byte takes under each language."""
        return np.stack([t.cost(keys) for t in self.trees], 1)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Total bits of each text under each language, by bounded chunks; costs of frequent bytes-in-context are kept."""
        out = np.zeros((len(texts), len(self.langs)))
        parts: list[tuple[bytes, bytes]] = []
        owners: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), CHUNK):
                parts.append((t[max(0, at - self.order) : at], t[at : at + CHUNK]))
                owners.append(i)
                size += len(parts[-1][1])
                if size >= CHUNK:
                    self._add(parts, owners, out)
                    parts, owners, size = [], [], 0
        if parts:
            self._add(parts, owners, out)
        return out

    def _add(self, parts: list[tuple[bytes, bytes]], owners: list[int], out: np.ndarray) -> None:
        keys, inverse = np.unique(byte_keys(parts, self.order), return_inverse=True)
        known = getattr(self, "_known", None)
        if known is None or known[1].size > CACHE:
            known = self._known = (np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32))
        cost = np.empty((len(keys), len(self.langs)), np.float32)
        at, there = _find(known[0], keys) if len(known[0]) else (None, np.zeros(len(keys), bool))
        if at is not None:
            cost[there] = known[1][at[there]]
        if not there.all():
            cost[~there] = self.cost(keys[~there])
            if (~there).sum() > 0.05 * len(keys):
                merged = np.concatenate([known[0], keys[~there]])
                by = np.argsort(merged)
                self._known = (merged[by], np.concatenate([known[1], cost[~there]])[by])
        starts = np.cumsum([0, *(len(t) for _, t in parts)])[:-1]
        np.add.at(out, owners, np.add.reduceat(cost[inverse], starts, axis=0, dtype=np.float64))


def train(docs: DataFrame, order: int = ORDER, docs_per_lang: int = DOCS_PER_LANG) -> PPMModel | None:
    """Learn from the rows that are not held out; the counting runs on the executors and only counts come back."""
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    ids = rows.withColumn("h", F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 12), 16, 10).cast("long"))
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # The smallest digests are wanted. Rows below this share of all digests are a few more than wanted (by six standard
    # deviations, and all of a small language), so no task ranks all rows of a language.
    share = (docs_per_lang + 6 * docs_per_lang**0.5 + 20) / F.col("n")
    near = ids.drop("text").join(F.broadcast(sizes), "lang").where(F.col("h") < 2.0**48 * share)
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= docs_per_lang).select("doc_id", "lang").distinct()
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 500):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.encode("utf-8", "replace"))
            for lang, texts in by.items():
                keys, n = np.unique(byte_keys([(b"", t) for t in texts], order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    if not got.num_rows:
        return None
    langs = sorted(set(got["lang"].to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    codes = got["lang"].combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    lang_of = np.array([place[x] for x in codes.dictionary.to_pylist()])[codes.indices.to_numpy()]
    return PPMModel(langs, got["gram"].to_numpy(), lang_of, got["n"].to_numpy(), order)


def predict(docs: DataFrame, model: PPMModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in text_batches(batches, 2000):
            texts = b.column(2).to_pylist()
            real = [i for i, t in enumerate(texts) if m is not None and t and any(map(str.isalpha, t))]
            langs, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            if real:
                raw = [texts[i].encode("utf-8", "replace") for i in real]
                bits = m.code_lengths(raw)
                best = bits.argmin(1)
                post = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                for k, i in enumerate(real):
                    langs[i], scores[i], rates[i] = m.langs[best[k]], round(float(post[k]), 9), round(float(bits[k, best[k]]) / len(raw[k]), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def identify_language(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """Train on ``learn_from`` (default: ``docs``) and predict every row of ``docs``."""
    return predict(docs, train(docs if learn_from is None else learn_from))
