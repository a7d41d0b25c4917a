"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's potential is linear in features of the line (length,
character classes, word statistics, repetition within the document) and of its two
neighbours; a 2x2 matrix scores adjacent labels. Training maximises the conditional
likelihood of the lines of labelled documents (all lines of a document carry its label) by
gradient ascent on exact forward-backward expectations. A document's score is the mean of its
lines' marginal probabilities of good, weighted by line length; a logistic calibration on
the training documents maps it to a probability.

Learning reads at most ``MAX_DOCS`` labelled documents that are not held out (those with the
smallest md5 of their id, of at most ``MAX_DOC_LINES`` lines each and ``MAX_LINES`` in all, which bounds
the driver). Learning, calibration and scoring all read whole texts. A text of many lines is scored in
blocks: what is held besides the text is a few numbers a line (lines that repeat are told by a 64-bit hash).

Defined cases: null or empty text has one empty line; without anything to learn from every
score is 0.5; labels other than 0 and 1 and null labels are not learned from; a document with
several labels counts with the smallest; of rows that repeat an id the least text is learned from;
repeated rows give repeated results; columns other than doc_id and text are not inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import held_out, text_batches

MAX_DOCS = 3000
#: Labelled documents with more lines than this are not learned from, nor those that come after this many lines in all.
MAX_DOC_LINES = 5000
MAX_LINES = 400_000
STEPS = 150
#: Texts with more lines than this are scored by themselves, block by block.
LONG_LINES = 2000
#: Lines that are scored at once, and characters of one block of a long text, about.
BATCH_LINES = 50_000
BLOCK_CHARS = 1 << 20


def _classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 lower case or caseless letter, 2 upper case, 3 digit, 4 white space, 5 sentence mark."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x3000):
        s = chr(c)
        table[c] = 4 if s.isspace() else 3 if s.isdigit() else 2 if s.isupper() else 1 if s.isalpha() else 5 if s in ".,;:?'\"()-" else 0
    table[0x3000:0xE000] = 1
    table[0x3000] = 4
    return table


_TABLE: list[np.ndarray] = []


def own_features(lines: list[str], repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line by itself and line lengths; ``repeated`` marks lines that occur again in their text."""
    if not _TABLE:
        _TABLE.append(_classes())
    distinct, runs = np.ones(len(lines)), np.zeros(len(lines))
    for i, x in enumerate(lines):
        if w := x.split():
            distinct[i] = len(set(w)) / len(w)
            runs[i] = sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w)
    size = np.array([len(x) for x in lines])
    joined = "\n".join(lines) + "\n"
    cls = _TABLE[0][np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    total = lambda m: np.add.reduceat(m, starts, dtype=np.float64)
    lower, upper, digit, space, mark, other = (total(cls == k) for k in (1, 2, 3, 4, 5, 0))
    space -= 1  # the line end
    body = np.maximum(size, 1)
    ends = np.zeros(len(cls), bool)
    ends[:-1] = (cls[:-1] != 4) & (cls[1:] == 4)
    words = np.maximum(total(ends), 1)
    odd_ends = total(ends & ((cls == 0) | (cls == 3))) / words
    solid = np.maximum(body - space, 1)
    own = np.stack([
        np.ones(len(lines)), np.log1p(size) / 5, (lower + upper) / solid, upper / np.maximum(lower + upper, 1), digit / solid, mark / solid, other / solid * 3,
        np.minimum(solid / words, 20) / 10, distinct, runs, odd_ends, repeated.astype(float), (size < 20).astype(float),
    ], 1)
    return own, size


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with its neighbours', line lengths, and lines of each text."""
    lines: list[str] = []
    counts, repeated = [], []
    for t in texts:
        split = t.split("\n")
        seen = Counter(split)
        repeated += [seen[x] > 1 and len(x) > 0 for x in split]
        lines += split
        counts.append(len(split))
    own, size = own_features(lines, np.array(repeated))
    n = np.array(counts)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    before, after = np.zeros_like(own[:, 1:]), np.zeros_like(own[:, 1:])
    before[1:], after[:-1] = own[:-1, 1:], own[1:, 1:]
    before[first] = 0
    after[first + n - 1] = 0
    return np.concatenate([own, before, after], 1), size, n


def line_blocks(text: str, chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """The lines of ``text`` in order, in lists of about ``chars`` characters (a longer line is whole)."""
    rest = ""
    for at in range(0, len(text), chars):
        lines = (rest + text[at : at + chars]).split("\n")
        rest = lines.pop()
        if lines:
            yield lines
    yield [rest]


def chain_marginals(score: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """``marginals`` of one chain of any length: forward-backward on ratios of good over bad, a few numbers a line."""
    (m00, m01), (m10, m11) = np.exp(pair - pair.max()).tolist()
    odds = np.exp(np.clip(score, -300, 300))
    fore, back = np.empty_like(odds), np.empty_like(odds)
    step = 1 << 16
    r = None
    for at in range(0, len(odds), step):
        out = []
        for e in odds[at : at + step].tolist():
            r = e if r is None else e * (m01 + r * m11) / (m00 + r * m10)
            out.append(r)
        fore[at : at + step] = out
    q = 1.0
    for end in range(len(odds), 0, -step):
        out = []
        for e in odds[max(0, end - step) : end][::-1].tolist():
            out.append(q)
            q = (m10 + m11 * e * q) / (m00 + m01 * e * q)
        back[max(0, end - step) : end] = out[::-1]
    both = fore * back
    return both / (1 + both)


def marginals(score: np.ndarray, pair: np.ndarray, n: np.ndarray, expect: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(good) of every line by forward-backward over chains of ``n`` lines, and the expected pairs of labels if wanted.

    ``score``: potential of good over bad; ``pair``: 2x2 log potentials of neighbours. All chains advance together.
    """
    order = np.argsort(-n, kind="stable")
    first = np.concatenate([[0], np.cumsum(n)[:-1]])[order]
    left = n[order]
    local = np.stack([np.zeros(len(score)), score], 1)
    local = np.exp(local - local.max(1, keepdims=True))
    m = np.exp(pair - pair.max())
    fore, back = np.empty_like(local), np.empty_like(local)
    alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    for t, k in enumerate(alive):
        at = first[:k] + t
        f = local[at] if t == 0 else (fore[at - 1] @ m) * local[at]
        fore[at] = f / f.sum(1, keepdims=True)
    back[first + left - 1] = 0.5
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        b = (back[at + 1] * local[at + 1]) @ m.T
        back[at] = b / b.sum(1, keepdims=True)
    both = fore * back
    good = both[:, 1] / both.sum(1)
    if not expect:
        return good, None
    inner = np.ones(len(score), bool)
    inner[first] = False
    at = np.nonzero(inner)[0]
    p = fore[at - 1][:, :, None] * m[None] * (local[at] * back[at])[:, None, :]
    p /= p.sum((1, 2), keepdims=True)
    return good, p.sum(0)


class LineCRF:
    """Weights of the features (standardised), label pairs and the calibration."""

    def __init__(self, x: np.ndarray, size: np.ndarray, n: np.ndarray, labels: np.ndarray, steps: int = STEPS):
        self.mean, self.scale = x.mean(0), x.std(0)
        self.mean[0], self.scale[self.scale < 1e-9] = 0, 1
        z = (x - self.mean) / self.scale
        y = np.repeat(labels, n).astype(float)
        inner = np.ones(len(y), bool)
        inner[np.concatenate([[0], np.cumsum(n)[:-1]])] = False
        wanted = np.zeros((2, 2))
        wanted[0, 0], wanted[1, 1] = (inner & (y == 0)).sum(), (inner & (y == 1)).sum()
        self.w, self.pair = np.zeros(x.shape[1]), np.zeros((2, 2))
        m1, m2, p1, p2 = (np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros((2, 2)))
        for t in range(1, steps + 1):
            good, pairs = marginals(z @ self.w, self.pair, n, True)
            g = z.T @ (y - good) / len(y) - 1e-4 * self.w
            gp = (wanted - pairs) / len(y) - 1e-2 * self.pair
            for value, grad, a, b in ((self.w, g, m1, m2), (self.pair, gp, p1, p2)):
                a += 0.1 * (grad - a)
                b += 0.01 * (grad**2 - b)
                value += 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        s = self.raw(x, size, n)
        self.slope, self.shift = 1.0, 0.0
        for _ in range(200):  # Newton steps of a two-parameter logistic regression on the logit of the raw score
            p = 1 / (1 + np.exp(-np.clip(self.slope * s + self.shift, -30, 30)))
            d, v = labels - p, p * (1 - p) + 1e-9
            h = np.array([[(v * s * s).sum() + 1, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([(d * s).sum() - self.slope, d.sum()]))
            self.slope, self.shift = max(1e-3, self.slope + step[0]), self.shift + step[1]
            if np.abs(step).max() < 1e-9:
                break

    def raw(self, x: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Logit of the length-weighted mean marginal of each document."""
        good, _ = marginals(((x - self.mean) / self.scale) @ self.w, self.pair, n)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        weight = size + 1.0
        mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        return np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6)))

    def raw_long(self, text: str) -> float:
        """``raw`` of one text of many lines, whose features are never held all at once."""
        marks = np.concatenate([np.array([hash(x) for x in lines], np.int64) for lines in line_blocks(text)])
        _, kind, times = np.unique(marks, return_inverse=True, return_counts=True)
        repeated = times[kind] > 1
        del marks, kind, times
        v = self.w / self.scale
        k = (len(v) + 2) // 3  # a line's own features; each neighbour has all but the constant
        sizes, own, as_before, as_after = [], [], [], []
        at = 0
        for lines in line_blocks(text):
            size = np.array([len(x) for x in lines])
            x, size = own_features(lines, repeated[at : at + len(lines)] & (size > 0))
            at += len(lines)
            sizes.append(size)
            own.append(x @ v[:k])
            as_before.append(x[:, 1:] @ v[k : 2 * k - 1])
            as_after.append(x[:, 1:] @ v[2 * k - 1 :])
        score = np.concatenate(own) - self.mean @ v
        score[1:] += np.concatenate(as_before)[:-1]
        score[:-1] += np.concatenate(as_after)[1:]
        weight = np.concatenate(sizes) + 1.0
        mean = np.clip((chain_marginals(score, self.pair) * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        return float(np.log(mean / (1 - mean)))

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated scores; texts of many lines go by themselves, the rest some ``BATCH_LINES`` lines at a time."""
        s = np.zeros(len(texts))
        held: list[int] = []
        lines = 0

        def flush() -> None:
            if held:
                s[held] = self.raw(*line_features([texts[i] for i in held]))

        for i, t in enumerate(texts):
            n = t.count("\n") + 1
            if n > LONG_LINES:
                s[i] = self.raw_long(t)
                continue
            if lines + n > BATCH_LINES:
                flush()
                held, lines = [], 0
            held.append(i)
            lines += n
        flush()
        return 1 / (1 + np.exp(-np.clip(self.slope * s + self.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> LineCRF | None:
    """Learn from the labelled rows that are not held out; features are made on the executors."""
    marks = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    own = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    # At most max_docs rows, so one window may hold them.
    so_far = Window.partitionBy(F.lit(0)).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    short = own.withColumn("lines", lines).where(F.col("lines") <= MAX_DOC_LINES)
    fit = short.withColumn("upto", F.sum("lines").over(so_far)).where(F.col("upto") <= MAX_LINES)
    sample = fit.select("doc_id", "quality", "text").repartition(16, "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 500):
            x, size, n = line_features(b.column(2).to_pylist())
            cut = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[i:j].ravel().astype(np.float32) for i, j in zip(cut, cut[1:], strict=False)], pa.list_(pa.float32())), pa.array([size[i:j] for i, j in zip(cut, cut[1:], strict=False)], pa.list_(pa.int64()))], ["doc_id", "quality", "x", "size"])

    got = sample.mapInArrow(features, "doc_id long, quality int, x array<float>, size array<long>").orderBy("doc_id").toArrow()
    y = got["quality"].to_numpy() if got.num_rows else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return None
    n = np.array([len(v) for v in got["size"].to_pylist()])
    x = got["x"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(n.sum(), -1)
    return LineCRF(x, got["size"].combine_chunks().flatten().to_numpy(), n, y)


def score_quality(docs: DataFrame, model: LineCRF | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1000):
            texts = b.column(2).to_pylist()
            s = np.full(len(texts), 0.5) if shared.value is None else shared.value.score(texts).round(9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: LineCRF | None) -> DataFrame:
    """The rows of ``docs``, unchanged, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1000):
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            s = np.full(len(texts), 0.5) if shared.value is None else shared.value.score(texts).round(9)
            yield b.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
