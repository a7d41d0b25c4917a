import hashlib
import re

import pytest
from pyspark.sql import functions as F

from logweave.llm import fingerprints as P
from tests.llm.conftest import ODD


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def tree(text: str):
    cut = lambda p, s: [m.group(0) for m in re.finditer(p.replace(r"\z", r"\Z"), s)]
    return [[[sha("0" + x) for x in cut(P.LEAF, p)] for p in cut(P.PARAGRAPH, s)] for s in cut(P.SECTION, text)]


def root(t) -> str:
    return sha("3" + "".join(sha("2" + "".join(sha("1" + "".join(p)) for p in s)) for s in t))


def brute(rows):
    out = {}
    for i, (doc, text) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + nxt[:k]
        a, b, c = ({x for s in tree(t) for p in s for x in p} for t in (text, edited, nxt))
        like = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
        out[doc] = (len(text), sha(edited), root(tree(text)), root(tree(edited)), pytest.approx(like(a, b)), pytest.approx(like(a, c)))
    return out


TEXTS = [(i * 7 - 20, t) for i, t in enumerate(["", "abc", "First one. Second one! Third?\nNew line here.\n\nNew section.\n\n\n", "é" * 500 + "😀 tail. ", "\n\n\n", "word " * 3000, "same", "same", "A sentence. " * 40, "x\r\ny"] * 5)]


@pytest.mark.parametrize("rows_in_range", [1024, 3])
def test_equals_brute_force(docs, monkeypatch, rows_in_range):
    monkeypatch.setattr(P.with_next, "__defaults__", (rows_in_range,))
    got = P.fingerprint_edits(docs([(i, t, "en", "s") for i, t in TEXTS])).collect()
    want = brute(TEXTS)
    assert len(got) == len(TEXTS)
    for r in got:
        assert tuple(r[c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want[r["doc_id"]]


def test_ranges_between_quantiles(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_CUTS", 4)
    monkeypatch.setattr(P, "MAX_PARTS", 5)
    ids = [-(2**63), -(2**63) + 1, -5, 0, 1, 2, *range(100, 160), 10**15, 2**62, 2**63 - 2, 2**63 - 1, None]
    d = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string").repartition(3)
    got = {r["text"]: r["next_text"] for r in P.with_next(d, 2).collect()}
    order = [f"text of {i}" for i in [None, *ids[:-1]]]
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


def test_odd_rows(docs):
    got = P.fingerprint_edits(docs(ODD)).collect()
    assert len(got) == len(ODD)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 7}) == 1
    assert P.fingerprint_edits(docs([])).count() == 0
    one = P.fingerprint_edits(docs([(5, "alone in the table", "en", "s")])).first()
    assert one["near_next"] == 1.0


def test_branches_locate_edits(spark):
    a = "Intro one.\nIntro two.\n\nBody one.\nBody two.\nBody three.\n\nEnd.\n"
    b = a.replace("Body two.", "Body 2.")
    d = spark.createDataFrame([(a, b)], "a string, b string").select(P.differing(P.leaf_tree(F.col("a")), P.leaf_tree(F.col("b"))).alias("at"), P.differing(P.leaf_tree(F.col("a")), P.leaf_tree(F.col("a"))).alias("none")).first()
    assert [(x["section"], x["paragraph"]) for x in d["at"]] == [(1, 1)]
    assert d["none"] == []
