import time

import numpy as np
import pytest

from quillspark.llm import vector_search as vs


def brute(rows, queries, k, scale=256):
    ok = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = [(i, v) for i, v in ok if i in queries]
    out = []
    for i, v in q:
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return df.selectExpr("*", "'x' as id", "2 as v", "3 as part", "4 as rank", "5L as score", "6L as query_id")


def run(spark, rows, queries, k):
    df = frame(spark, rows)
    out = vs.top_k(spark, df, df.where(df.vec_id.isin(list(queries))), k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(vs, "ROWS", 150)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(0, spread, 12)]) for k in range(400)]
    rows += [(1000 + k, rows[k][1]) for k in range(50)]  # ties
    queries = {0, 5, 399, 1003}
    assert run(spark, rows, queries, 5) == brute(rows, queries, 5)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 0.0]), (7, [3.0]), (8, []), (9, [-1.0, -2.0])]
    assert run(spark, rows, {1, 2, 3, 9}, 5) == brute(rows, {1, 9}, 5)
    assert run(spark, rows[:1], {1}, 5) == []
    assert run(spark, [], {1}, 5) == []
    big = [(1, [3e6, 1.0]), (2, [-3e6, 2.0]), (3, [1.0, 1.0])]
    assert run(spark, big, {1, 3}, 2) == brute(big, {1, 3}, 2)


def test_slices_add_and_walk():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 500, (37, 200))
    block = vs.Block(np.arange(200), values.T.astype(np.int64))
    total = values.sum(axis=0)
    by_power = {}
    for v in values:
        for b in range(9):
            by_power.setdefault(b, []).append(block.packed(v >> b & 1))
    slices = vs.add_slices({p: np.stack(x) for p, x in by_power.items()})
    found = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:200].astype(int) << p) for p, s in enumerate(slices) if s is not None)
    assert (found == total).all()
    value, _ = vs.walk(slices, block.valid, 7)
    assert value == np.sort(total)[-7]
    near = np.unpackbits(block.at_least(slices, int(value) - 100).view(np.uint8), bitorder="little")[:200].astype(bool)
    assert (near == (total >= value - 100)).all()


@pytest.mark.parametrize("power", [20, 31, 45, 60, 100])
def test_wide_values(spark, power):
    # products of two wide values need more than 64 bits, so one of the two stays small
    rng = np.random.default_rng(power)
    rows = [(k, [float(np.float32(x)) for x in (rng.normal() * 2.0**power * (k % 2), rng.normal() * (k % 3), rng.normal())]) for k in range(90)]
    queries = {0, 4, 8, 30, 60}
    if power < 45:
        assert run(spark, rows, queries, 5) == brute(rows, queries, 5)
    # in Python, where no score must fit a long
    ids, v = np.arange(90), vs.whole_numbers(np.array([r[1] for r in rows]), 256)
    assert v.tolist() == [[int(np.floor(256 * x)) if abs(x) < 2**53 else 256 * int(x) for x in r[1]] for r in rows]
    block = vs.Block(ids, v)
    for q in (1, 4, 7, 30, 61):
        best = sorted((-sum(a * b for a, b in zip(v[q].tolist(), w)), j) for j, w in enumerate(v.tolist()) if j != q)[:5]
        assert block.top(q, v[q], 5) == [(j, -s) for s, j in best]


def test_large_vectors_stay(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e14, 0.0]), (3, [0.5, 0.0]), (4, [3e13, 0.0]), (5, [0.0, 0.0])]
    assert run(spark, rows, {1}, 2) == brute(rows, {1}, 2)
    with pytest.raises(Exception, match="too large for a long"):
        run(spark, rows, {4}, 2)


def best_of(ids, values, at, k, rows=150):
    digits, best = vs.Digits(ids[at], values[at]), vs.Best(len(at), k)
    for i in range(0, len(ids), rows):
        vs.meet(vs.Levels(ids[i : i + rows], values[i : i + rows]), digits, best)
    return [[(int(i), int(s)) for i, s in zip(a, b) if np.isfinite(s)] for a, b in zip(best.ids, best.scores)]


def tables():
    rng = np.random.default_rng(5)
    for width in (1, 7, 8, 12, 65):
        yield rng.normal(0, 32, (400, width))
    near = rng.normal(0, 32, (8, 64))[rng.integers(0, 8, 400)]
    yield near + rng.normal(0, 2, near.shape)  # clusters
    yield near  # copies
    yield rng.normal(900, 5, (400, 16))  # far from zero
    yield rng.normal(0, 1, (400, 16)) * 2.0 ** rng.integers(0, 20, (400, 1))  # some rows much longer than others
    yield rng.normal(0, 1, (400, 16)) * 2.0 ** rng.integers(0, 20, 16)  # some components much wider
    yield np.where(rng.random((400, 64)) < 0.03, rng.normal(0, 99, (400, 64)), 0)  # mostly zeros
    yield np.zeros((400, 3))
    yield np.full((400, 3), -7.0)
    yield rng.integers(-1, 2, (400, 5))  # many ties


@pytest.mark.parametrize("number", range(14))
def test_levels_equal_brute_force(number):
    values = np.floor(list(tables())[number]).astype(np.int64)
    ids = np.random.default_rng(number).permutation(400)
    ids[:20] = ids[20:40]  # repeated ids
    at = np.arange(0, 400, 9)
    for k in (1, 5, 500):
        scores = values[at] @ values.T
        want = [sorted((-int(s), int(j)) for s, j in zip(scores[n], ids) if j != ids[q])[:k] for n, q in enumerate(at)]
        assert best_of(ids, values, at, k) == [[(j, -s) for s, j in w] for w in want]


def test_small_and_wide_rows_meet(spark, monkeypatch):
    monkeypatch.setattr(vs, "ROWS", 64)
    monkeypatch.setattr(vs, "TABLE_MB", 0)  # one word of rows at a time
    rng = np.random.default_rng(9)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 2.0**20 if k % 40 == 3 else 1, 12)]) for k in range(300)]
    queries = {0, 3, 43, 44, 299}
    assert run(spark, rows, queries, 5) == brute(rows, queries, 5)
    assert run(spark, [(k, []) for k in range(9)], {2}, 3) == [(2, 1, 0, 0), (2, 2, 1, 0), (2, 3, 3, 0)]


def test_few_scores_are_exact_and_queries_are_added_together(monkeypatch):
    rng = np.random.default_rng(2)
    values = np.floor(rng.normal(0, 32, (20_000, 64))).astype(np.int64)
    ids, at, looked = np.arange(20_000), np.arange(0, 20_000, 100), []
    scores = vs.Levels.scores
    monkeypatch.setattr(vs.Levels, "scores", lambda *a: looked.append(len((out := scores(*a))[0])) or out)
    start = time.thread_time()
    found = best_of(ids, values, at, 5, 4096)
    took = time.thread_time() - start
    assert sum(looked) < 0.2 * len(ids) * len(at)
    # the same by all slices of one query at a time, for some queries and a fifth of the rows
    block = vs.Block(ids[:4096], values[:4096])
    start = time.thread_time()
    for q in at[:20]:
        block.top(q, values[q], 5)
    assert took < (time.thread_time() - start) * len(at) / 20 * len(ids) / 4096 / 3
    exact = values[at] @ values.T
    exact[np.arange(len(at)), at] = -(1 << 60)
    assert [[s for _, s in hits] for hits in found] == (-np.sort(-exact, axis=1)[:, :5]).tolist()


def test_no_copies_are_shuffled(spark):
    df = frame(spark, [(k, [float(k)]) for k in range(9)])
    plan = vs.top_k(spark, df, df)._jdf.queryExecution().executedPlan().toString()
    pair = plan[plan.index("CartesianProduct") :]
    assert "Generate" not in pair and "Join" not in pair
