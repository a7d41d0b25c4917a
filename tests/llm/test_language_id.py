import zlib
from math import log2

import numpy as np
import pytest
from tests.conftest import DATA

from logweave.llm import language_id as L
from tests.llm.conftest import ODD


def brute_bits(train: list[bytes], text: bytes, order: int) -> float:
    """PPM, method C, with exclusions, straight from its definition."""
    counts: dict[bytes, dict[int, int]] = {}
    for t in train:
        padded = b"\0" * order + t
        for i in range(order, len(padded)):
            for j in range(order + 1):
                c = counts.setdefault(padded[i - j : i] if j else b"", {})
                c[padded[i]] = c.get(padded[i], 0) + 1
    bits, padded = 0.0, b"\0" * order + text
    for i in range(order, len(padded)):
        gone: set[int] = set()
        for j in range(order, -1, -1):
            seen = {s: n for s, n in counts.get(padded[i - j : i] if j else b"", {}).items() if s not in gone}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if padded[i] in seen:
                bits -= log2(seen[padded[i]] / total)
                break
            bits -= log2(len(seen) / total)
            gone |= set(seen)
        else:
            bits += log2(256 - len(gone))
    return bits


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths_equal_the_definition(order):
    train = {"aa": [b"the cat sat on the mat", b"the hat"], "bb": [b"der hut und die katze", b"und der"]}
    parts = [(lang, L.byte_keys([(b"", t) for t in texts], order)) for lang, texts in train.items()]
    keys = np.concatenate([k for _, k in parts])
    model = L.PPMModel(["aa", "bb"], keys, np.repeat([0, 1], [len(k) for _, k in parts]), np.ones(len(keys)), order)
    for text in (b"the cat", b"katze", b"zzz \xff", b"t", b"und the hat der"):
        got = model.code_lengths([text])[0]
        assert got == pytest.approx([brute_bits(train["aa"], text, order), brute_bits(train["bb"], text, order)], rel=1e-5)


def test_chunks_carry_the_context(monkeypatch):
    keys = L.byte_keys([(b"", b"abracadabra" * 20)], 4)
    model = L.PPMModel(["x"], keys, np.zeros(len(keys), int), np.ones(len(keys)), 4)
    whole = model.code_lengths([b"abracadabrac" * 30])
    monkeypatch.setattr(L, "CHUNK", 7)
    assert model.code_lengths([b"abracadabrac" * 30]) == pytest.approx(whole)


def test_odd_rows_and_repeats(docs):
    texts = [(100 + i, f"the {w} and the house of {w}", "en", "s") for i, w in enumerate("abcdefgh" * 4)] + [(200 + i, f"der {w} und das haus von {w}", "de", "s") for i, w in enumerate("abcdefgh" * 4)]
    rows = L.identify_language(docs(texts + ODD)).collect()
    assert len(rows) == len(texts) + len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert {by[i][0]["lang_pred"] for i in (1, 2, 3, 5)} == {"und"}
    assert by[7][0] == by[7][1]
    assert by[None][0]["held_out"] is True
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert all(by[i][0]["lang_pred"] == ("en" if i < 200 else "de") for i in by if i is not None and i >= 100)


def test_nothing_to_learn_from(docs):
    assert [r["lang_pred"] for r in L.identify_language(docs([(1, "hello", None, "s")])).collect()] == ["und"]
    assert L.identify_language(docs([])).count() == 0


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = L.identify_language(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("avg(cast(lang_pred = lang as int))").first()[0]
    assert got > 0.98
