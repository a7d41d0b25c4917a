import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.conftest import DATA

from logweave.llm import packing, queries
from tests.llm.conftest import ODD


def check(rows, capacity=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_doc, by_seq


def test_same_ids_as_tokenizers():
    ours = packing.Encoder(queries.vocabulary())
    r = random.Random(2)
    texts = ["", " ", "\n\n  \t x", "a<|endoftext|>b", "it's we'll 12345 ", "é😀 \u200b\u00a0ß" * 20, "a" * 3000, " " * 500 + "x", "\r\n\r\n", "日本語テキスト"] + ["".join(chr(r.choice([32, 10, 39, 65, 97, 48, 233, 0x4E00, 0x1F600, 0x301]) + r.randint(0, 20)) for _ in range(300)) for _ in range(200)]
    assert [ours(x) for x in texts] == [ours.plain(x) for x in texts]


@pytest.mark.parametrize("text", [" " * 2_000_000, "x" + "\n" * 2_000_000 + "y", "a" * 2_000_000, "words and" + "\t " * 600_000 + "!" * 600_000])
def test_very_long_runs(text):
    ours = packing.Encoder(queries.vocabulary())
    assert ours(text) == ours.plain(text)


def test_a_text_of_blanks_is_packed(docs):
    by_doc, _ = check(packing.pack_documents(docs([(1, " " * 1_100_000, "en", "s"), (2, "short", "en", "s")]), queries.vocabulary()).collect())
    assert sum(r["length"] for r in by_doc[1]) == len(packing.Encoder(queries.vocabulary()).plain(" " * 1_100_000)) + 1


def test_whole_documents_come_back(spark, docs):
    rows = packing.pack_documents(docs(ODD), queries.vocabulary()).collect()
    by_doc, _ = check(rows)
    encode = packing.Encoder(queries.vocabulary()).plain
    for doc, text, *_ in ODD:
        ids = np.array([*encode(text or ""), 2], "<u4")
        parts = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc])
        copies = sum(x[0] == doc for x in ODD)
        assert len(parts) % copies == 0
        parts = parts[::copies]
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert sum(p[2] for p in parts) == len(ids) and all(p[2] == 1024 for p in parts[1:]) and (len(ids) > 1024 or len(parts) == 1)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for _, s, n, crc in parts)
    assert packing.pack_documents(docs([]), queries.vocabulary()).count() == 0


def test_few_sequences(spark):
    rows = queries.op5_packing(spark, f"{DATA}/sf0.01").collect()
    _, by_seq = check(rows)
    assert len(by_seq) <= 1.005 * -(-sum(r["length"] for r in rows) // 1024)


def test_the_best_cutoff_is_taken():
    # Three of a length fill a sequence: best fit alone would put two of the longest together.
    counts = {341: 300, 500: 100, 24: 100}
    grouped, plan, most = packing.plan_lengths(counts, 1024)
    assert packing.expected_sequences(plan, grouped, counts, {k: v for k, v in counts.items() if k <= most}, 1024) == pytest.approx(150, abs=2)
    for only in packing.CUTOFFS:
        g, p, m = packing.plan_lengths(counts, 1024, cutoffs=(only,))
        assert packing.expected_sequences(plan, grouped, counts, {k: v for k, v in counts.items() if k <= most}, 1024) <= packing.expected_sequences(p, g, counts, {k: v for k, v in counts.items() if k <= m}, 1024)
    assert packing.plan_lengths({}, 1024) == ([], [], 512)


@pytest.mark.parametrize("seed", range(5))
def test_plans_place_every_item_once(seed):
    r = random.Random(seed)
    counts = {length: r.randint(1, 50) for length in r.sample(range(20, 101), r.randint(1, 60))}
    grouped = packing.group_lengths(counts, 8)
    assert sorted(x for g in grouped for x in g[1]) == sorted(counts) and all(g[0] == max(g[1]) for g in grouped)
    sizes, demand = [g[0] for g in grouped], [sum(counts[x] for x in g[1]) for g in grouped]
    plan = packing.configurations(sizes, demand, 100)
    assert all(sum(a * s for a, s in zip(c, sizes, strict=True)) <= 100 for c, _ in plan)
    assert [sum(c[i] * t for c, t in plan) for i in range(len(sizes))] == demand
    small, rooms = {k: r.randint(1, 80) for k in range(1, 20)}, {k: r.randint(1, 9) for k in r.sample(range(1, 60), 20)}
    moves, new = packing.best_fit(rooms, small, 100)
    filled = defaultdict(int)
    for length, _, n, cls, at in moves:
        for i in range(at, at + n):
            filled[cls, i] += length
    assert all(v <= (100 if c < 0 else c) and (i < new if c < 0 else i < rooms[c]) for (c, i), v in filled.items())
    for length, n in small.items():
        ranks = sorted((m[1], m[2]) for m in moves if m[0] == length)
        assert sum(k for _, k in ranks) == n and all(a + k == b for (a, k), (b, _) in zip(ranks, ranks[1:], strict=False))
