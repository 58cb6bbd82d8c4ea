import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(spark, df, tokenizer, width=1024):
    """The pieces, after a round trip."""
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in df.collect()}
    rows = packing.pack(df, width=width).toPandas()
    for doc_id, own in rows.groupby("doc_id"):
        at = 0
        for r in own.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc_id])
            assert zlib.crc32(ids[doc_id][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[doc_id])
    assert set(rows["doc_id"]) == set(ids)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == np.r_[0, own["length"].cumsum()[:-1]]).all()
        assert own["length"].sum() <= width
    return rows


def test_round_trip_and_padding(spark, docs_of, texts_of, tokenizer):
    rows = check(spark, docs_of(list(texts_of.values())).coalesce(1), tokenizer)
    sizes = rows.groupby("sequence_id")["length"].sum()
    padded = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padded < 0.03 * sizes.sum()


def test_odd_texts(spark, docs_of, tokenizer):
    texts = [None, "", " ", "  a  b ", "a\n b", "x\t y", "<|endoftext|> mid <|endoftext|>", "z" * 6000, "no end " * 900, "é　 ü", "a\0b c", "it's 12 o'clock.\nYes."]
    check(spark, docs_of(texts), tokenizer)
    check(spark, docs_of(texts).coalesce(1), tokenizer, 64)
    assert packing.pack(docs_of([])).count() == 0


def test_stretches_join(spark, docs_of, tokenizer, monkeypatch):
    line = packing.Line(64, 0)
    rng = np.random.default_rng(2)
    docs, out = [], []
    for k in range(200):
        n = int(rng.integers(1, 90))
        docs.append(np.arange(n, dtype=np.uint32))
        line.add(k, docs[-1], np.sort(rng.choice(n, max(1, n // 9), replace=False)).astype(np.int64) + 1)
        if line.held > 500:
            out += line.flush(False)
    out += line.flush(True)
    for k, d in enumerate(docs):
        own = sorted((a, n) for i, a, n, *_ in out if i == k)
        assert sum(n for _, n in own) == len(d) and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_cuts_are_optimal():
    """Against a plain quadratic program; windows of a power of two are not padded wherever they stand."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        places = np.unique(np.r_[0, np.cumsum(rng.integers(1, 20, 60))]).tolist()
        penalty = rng.integers(0, 9, len(places)).astype(float).tolist()
        width = 64

        def cost(i, j):
            n = places[j] - places[i]
            free = packing.SHORT if n & (n - 1) == 0 and n < width else float("inf")
            return min(width - n, free) + penalty[j]

        best = [0.0]
        for j in range(1, len(places)):
            best.append(min(best[i] + cost(i, j) for i in range(j) if places[j] - places[i] <= width))
        cuts = packing.best_cuts(places, penalty, width)
        assert abs(sum(cost(i, j) for i, j in zip(cuts, cuts[1:])) - best[-1]) < 1e-9
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1


@pytest.mark.parametrize("unit", [" ", "\n", "a", "\t ", "é"])
def test_long_runs(spark, docs_of, tokenizer, unit):
    check(spark, docs_of([unit * 1_000_000, "b"]), tokenizer)
