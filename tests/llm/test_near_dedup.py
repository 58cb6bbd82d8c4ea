import random

import numpy as np

from quillspark.llm import near_dedup as nd
from quillspark.llm.components import components
from quillspark.plans.staging import Stage


def sets(text, width):
    w = text.encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, width):
    """Component of each id, by comparing all pairs."""
    s = {i: sets(t or "", width) for i, t in docs}
    comp = {i: i for i in s}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def result(spark, df, width):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_groups(spark, df, width).collect()}


def variants(seed, n_groups, size, words=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(n_groups):
        base = [f"w{rnd.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(words)] = f"x{rnd.randrange(1000)}"
            out.append(" ".join(t))
    rnd.shuffle(out)
    return out


def test_groups_equal_brute_force(spark, docs_of):
    texts = variants(1, 6, 40) + ["", None, "one", "One", "two words", "a b c d", "A\tB\nc  d", "é É"]
    df = docs_of(texts)
    assert result(spark, df, 4) == brute(list(enumerate(texts)), 4)


def test_chain_of_copies_is_one_group(spark, docs_of):
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[:100])]
    for k in range(1, 12):
        words[k * 8] = f"y{k}"
        texts.append(" ".join(words[:100]))
    assert result(spark, docs_of(texts), 4) == brute(list(enumerate(texts)), 4)


def test_repeated_rows_null_ids_and_empty_table(spark, docs_of):
    df = docs_of(["a b c d e", "a b c d e", "a b c d e", "q"], [5, 5, None, None])
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_groups(spark, df).collect()), key=repr)
    assert rows == [(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True)]
    assert nd.near_groups(spark, docs_of([])).count() == 0
    assert [r["doc_id"] for r in nd.without_copies(spark, docs_of(["a b c", "a b c", "z"], [3, 2, 9])).orderBy("doc_id").collect()] == [2, 9]


def test_bounds():
    """The posterior chance that a dropped pair reaches the threshold stays below the stated miss; computed exactly."""
    from fractions import Fraction
    from math import comb

    for n in range(nd.BATCH, nd.HASHES + 1, nd.BATCH):
        t = Fraction(80, 100)
        upto = lambda m: sum(comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))
        m = nd.bound(n, 80, 100)
        # Beta(m, n - m + 2) is that of m - 1 equal minima, which are dropped; m equal ones go on
        assert upto(m - 1) < nd.MISS <= upto(m)


def test_rows_of_one_id_are_judged_by_their_own_texts(spark, docs_of):
    a, b = "a b c d e f g", "p q r s t u v"
    rows = nd.near_groups(spark, docs_of([a, b, a, b, b, a], [5, 5, 3, 9, None, None])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in rows) == [(0, 3), (0, 5), (3, 3), (5, 3), (5, 5), (9, 5)]
    none = nd.near_groups(spark, docs_of([a, a, "", None], [None] * 4)).collect()
    assert [(r["component_id"], r["kept"]) for r in none] == [(None, True)] * 4


def test_blocks_in_chunks_and_texts_by_join(spark, docs_of, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "CHUNK", 3)
    monkeypatch.setattr(nd, "FILTER_BITS", 1 << 10)
    texts = variants(5, 3, 40, 40)
    assert result(spark, docs_of(texts), 4) == brute(list(enumerate(texts)), 4)


def test_a_long_text_and_its_copy(spark, docs_of):
    words = [f"w{k % 7919}x{k % 31}" for k in range(150_000)]
    texts = [" ".join(words), " ".join(words[:140_000]), " ".join(words[:60_000])]
    assert result(spark, docs_of(texts), 4) == brute(list(enumerate(texts)), 4)


def test_without_copies_keeps_columns_of_any_name(spark, docs_of):
    df = docs_of(["a b c", "a b c", "z", None, None], [3, 2, 9, None, 4]).selectExpr("*", "1 as _kept", "2 as _nth", "3 as kept_id", "4 as component_id")
    out = nd.without_copies(spark, df)
    assert out.columns == df.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 2, 4, 9]


def test_signatures_estimate_similarity():
    a = nd.shingles(" ".join(f"w{k}" for k in range(1000)), 5)
    b = nd.shingles(" ".join(f"w{k}" for k in range(100, 1100)), 5)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((nd.signature(a) == nd.signature(b)).mean() - true) < 0.15


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 50), (50, 100), (7, 7), (200, 100)]
    out = components(spark, spark.createDataFrame(edges, "u bigint, v bigint"), Stage(spark, "t"), "c")
    found = {r["id"]: r["comp"] for r in out.collect()}
    assert found == {**{k: 0 for k in range(41)}, 50: 50, 100: 50, 200: 50}
