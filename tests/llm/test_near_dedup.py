import random
import re

import pytest

from logweave.llm import near_dedup as N
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def mutated(words, r, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(words)
    return " ".join(w)


@pytest.mark.parametrize("block", [10_000, 400])
def test_equals_brute_force(docs, words, monkeypatch, block):
    r = random.Random(block)
    rows, at = [], 0
    for _ in range(12):
        base = " ".join(r.choice(words) for _ in range(r.randint(3, 160)))
        for k in range(r.randint(1, 14)):
            rows.append((at, mutated(words, r, base, r.choice([0, 0, 1, 2, 3, 5, 9]) if k else 0)))
            at += 1
    r.shuffle(rows)
    monkeypatch.setattr(N.verified_links, "__defaults__", (N.THRESHOLD, block, 7))
    got = N.near_duplicates(docs([(d, t, "en", "s") for d, t in rows])).collect()
    assert {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in got} == brute(rows)
    assert all(g["kept"] == (g["doc_id"] == g["component_id"]) for g in got) and len(got) == len(rows)


def test_sets_of_odd_texts():
    for text in [None, "", " \t", "a", "A b C", "x y z u v w", "ÄB äb \x0b\x0c q", "a b c", "one " * 50, "w%d " * 3000 % tuple(range(3000))]:
        assert len(N.shingles(text)) == len(shingle_set(text))
    assert (N.shingles("A b c D e f") == N.shingles("a  B\tc\nd e F ")).all()
    assert (N.shingles("Ä b") != N.shingles("ä b")).all()


def test_odd_rows_and_empty_table(docs):
    got = {}
    for g in N.near_duplicates(docs(ODD)).collect():
        got.setdefault(g["doc_id"], []).append(g)
    assert sum(map(len, got.values())) == len(ODD)
    assert all(got[i][0]["n_shingles"] == 0 and got[i][0]["component_id"] == i for i in (1, 2, 3))
    assert [g["component_id"] for g in got[7]] == [7, 7]
    assert N.near_duplicates(docs([])).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + i) for i in range(1, 40)] + [(300, 301), (301, 302), (302, 300), (5, 5)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = N.connected_components(spark.createDataFrame(edges * 2, "u long, v long")).collect()
    want = {(x, find(x)) for x in root if x != 5 or True}
    loops = {x for x in root if all(x not in e or e[0] == e[1] for e in edges)}
    assert {(g["node"], g["component"]) for g in got} == {w for w in want if w[0] not in loops}
    assert len(got) == len({g["node"] for g in got})


def test_keep_one_keeps_columns(docs, words):
    base = " ".join(words[:120])
    d = docs([(1, base, "en", "s"), (2, base, "en", "s"), (3, base + " tail", "en", "s"), (4, "other " + " ".join(words[200:300]), "en", "s"), (5, None, "en", "s")])
    out = N.keep_one(d)
    assert out.columns == d.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, 5]


@pytest.mark.parametrize("block", [512, 3])
def test_sets_unlike_their_hub_meet_each_other(spark, monkeypatch, block):
    """Ids 1 to 9 share bands with 0, the smallest; 1 to 4 are alike, so are 5 to 9, none is like 0."""
    monkeypatch.setattr(N, "BLOCK_SETS", block)
    r = random.Random(0)
    kinds = [bytes(r.randrange(256) for _ in range(N.HASHES)) for _ in range(3)]
    kind = lambda i: 0 if i == 0 else 1 if i < 5 else 2
    rows = [(i, [7, 8, 1000 + i], bytearray(kinds[kind(i)][:-10] + bytes([i] * 10))) for i in range(10)] + [(20, [9], bytearray(kinds[0])), (21, [9], bytearray(kinds[0]))]
    links = N.candidate_links(spark.createDataFrame(rows, "doc_id long, bands array<long>, minima binary"), 85)
    got = {c["node"]: c["component"] for c in N.connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 5), 1), **dict.fromkeys(range(5, 10), 5), 20: 20, 21: 20}


def test_signatures_estimate_similarity(words):
    r = random.Random(4)
    for edits in (0, 5, 20, 80):
        base = " ".join(r.choice(words) for _ in range(600))
        a, b = N.shingles(base), N.shingles(mutated(words, r, base, edits))
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        same = sum(x == y for x, y in zip(N.signature(a)[1], N.signature(b)[1], strict=True)) / N.HASHES
        assert abs((same - 1 / 256) / (1 - 1 / 256) - true) < 0.12
